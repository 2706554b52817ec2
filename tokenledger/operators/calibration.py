"""Calibration from the usage log and from priced turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenledger.functions.text import half_up
from tokenledger.operators.carry import previous
from tokenledger.operators.pricing import is_reasoning, total_usd
from tokenledger.settings import DEFAULTS, Settings


def calibrate_models(log: DataFrame, *more: Column) -> DataFrame:
    """Per model of a log (model, input_tokens, output_tokens, cost_units, reasoning): turns, averages, output to input (null without input), reasoning, and more aggregates."""
    ratio = F.try_divide(F.sum("output_tokens").cast("double"), F.sum("input_tokens"))
    out = log.groupBy("model").agg(F.count("*").alias("turns"), F.avg("input_tokens").alias("avg_input"), F.avg("output_tokens").alias("avg_output"), (total_usd("cost_units") / F.count("*")).alias("avg_cost"), ratio.alias("out_in_ratio"), F.bool_or("reasoning").alias("reasoning"), *more)
    return out.orderBy(F.desc("turns"), "model")


def baseline_ratio(log: DataFrame) -> DataFrame:
    """One row, baseline: output to input of the turns without reasoning, null without input."""
    rows = log.where(~F.col("reasoning"))
    return rows.agg(F.try_divide(F.sum("output_tokens").cast("double"), F.sum("input_tokens")).alias("baseline"))


def duplicate_rate(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.avg(F.col("duplicate").cast("int")), F.lit(0.0)).alias("duplicate_rate"))


def context_growth(log: DataFrame) -> DataFrame:
    """(session_id, seq, turn_index, growth): input against the turn before, none for a session's first turn."""
    rows = previous(log, ["session_id"], "turn_index", F.col("input_tokens"), "before_", ties=("seq",))
    return rows.withColumn("growth", F.col("input_tokens") - F.col("before_")).where("growth IS NOT NULL").select("session_id", "seq", "turn_index", "growth")


def nearest_rank(df: DataFrame, column: str, tenths: int = 9) -> DataFrame:
    """One row: n, and value, the element at rank floor(n * tenths / 10) + 1 (n at most), null without rows.

    The window runs over the histogram of the column, not over its rows.
    """
    h = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("k"))
    upto, every = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    h = h.select(column, F.sum("k").over(upto).alias("seen"), F.sum("k").over(every).alias("n"))
    rank = F.least(F.col("n"), F.expr(f"({tenths} * n) div 10 + 1"))
    return h.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.min(F.when(F.col("seen") >= rank, F.col(column))).alias("value"))


def snowball_p90(log: DataFrame) -> DataFrame:
    """One row: growths (positive ones) and their nearest-rank p90."""
    return nearest_rank(context_growth(log).where("growth > 0"), "growth").select(F.col("n").alias("growths"), F.col("value").alias("p90"))


def snowball_threshold(log: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row, threshold: the log's p90, the setting where the log has too few turns or no growth."""
    n = log.agg(F.count("*").alias("all_turns"))
    return snowball_p90(log).join(n, how="cross").select(F.when((F.col("all_turns") >= s.min_turns) & F.col("p90").isNotNull(), F.col("p90")).otherwise(F.lit(s.snowball_tokens).cast("long")).alias("threshold"))


def calibration(log: DataFrame, priced: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Per model of the priced turns as calibrate_models, with baseline (the log's where the turns have none), p90 and duplicate_rate of the log."""
    real = priced.withColumn("reasoning", is_reasoning(F.col("model"), s))
    base = baseline_ratio(real).join(baseline_ratio(log).withColumnRenamed("baseline", "logged"), how="cross").select(F.coalesce("baseline", "logged").alias("baseline"))
    one = base.join(snowball_p90(log).select("p90"), how="cross").join(duplicate_rate(log), how="cross")
    return calibrate_models(real).join(F.broadcast(one), how="cross")


def calibrated_multiplier(models: DataFrame, calibrated: DataFrame, baseline: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(model, multiplier): the ratio of the fitting model of the most turns over the baseline, 2 places, 1 to 5; null with too few turns.

    Models fit if one name holds the other; both sides are a row for each model.
    """
    name = F.lower(F.coalesce("model", F.lit("")))
    c = calibrated.select(F.lower("model").alias("own"), F.col("turns").alias("n"), F.col("out_in_ratio").alias("ratio"))
    rows = models.select("model", name.alias("name")).distinct().join(F.broadcast(c), F.col("name").contains(F.col("own")) | F.col("own").contains(F.col("name")), "left")
    best = rows.groupBy("model").agg(F.min_by(F.struct("n", "ratio"), F.struct(-F.col("n"), F.col("own"))).alias("c"))
    best = best.join(F.broadcast(baseline), how="cross")
    value = F.greatest(F.lit(1.0), F.least(F.lit(5.0), half_up(F.col("c.ratio") / F.col("baseline"), 2)))
    return best.select("model", F.when((F.col("c.n") >= s.min_turns) & (F.col("c.ratio") > 0) & (F.col("baseline") > 0), value).alias("multiplier"))
