"""Usage roll-ups of priced turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenledger.operators.pricing import total_usd, usd


def totals() -> list[Column]:
    return [F.count("*").alias("turns"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), total_usd("cost_units").alias("cost")]


def usage_by(priced: DataFrame, *keys: str) -> DataFrame:
    """Turns, tokens and cost by keys, the dearest first; by day, in order of days, undated turns left out."""
    rows = priced.where("day IS NOT NULL") if "day" in keys else priced
    out = rows.groupBy(*keys).agg(*totals())
    return out.orderBy("day", *[k for k in keys if k != "day"]) if "day" in keys else out.orderBy(F.desc("cost"), *keys)


def usage_by_project(priced: DataFrame) -> DataFrame:
    return usage_by(priced.withColumn("project", F.coalesce(F.nullif("project", F.lit("")), F.lit("unknown"))), "project")


def usage_cells(priced: DataFrame) -> DataFrame:
    """The cube: (day, model, project), turns, tokens, exact sums of units. Day is null for undated turns."""
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("input_units", "output_units", "cost_units")]
    return priced.groupBy("day", "model", "project").agg(F.count("*").alias("turns"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), *exact)


def usage_grouping_sets(cells: DataFrame) -> DataFrame:
    """By model, project, day, all three and in all, from the cube: one row of cells is expanded, not each turn."""
    rows = cells.withColumn("set", F.explode(F.array(*[F.lit(x) for x in ("model", "project", "day", "cell", "all")])))
    keep = lambda c: F.when(F.col("set").isin(c, "cell"), F.col(c))
    rows = rows.select("set", *[keep(c).alias(c) for c in ("model", "project", "day")], "turns", "input_tokens", "output_tokens", "cost_units")
    out = rows.groupBy("set", "model", "project", "day").agg(*[F.sum(c).alias(c) for c in ("turns", "input_tokens", "output_tokens")], total_usd("cost_units").alias("cost"))
    flags = [F.when(F.col("set").isin(c, "cell"), 0).otherwise(1).alias(f"no_{c}") for c in ("model", "project", "day")]
    return out.select("model", "project", "day", *flags, "turns", "input_tokens", "output_tokens", "cost")


def usage_totals(priced: DataFrame) -> DataFrame:
    """One row: turns, tokens, cost, active_days, projects, sessions."""
    return priced.agg(*totals(), F.count_distinct("day").alias("active_days"), F.count_distinct("project").alias("projects"), F.count_distinct("session_id").alias("sessions"))


def usage_sessions(priced: DataFrame, turns: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Sessions: turns, tokens, cost_units, first_day (of its first dated turn), title.

    Titles (project, session_id, title) come first, then the first prompt's
    snippet before repeated responses are removed, then '(untitled)'.
    """
    key = ["project", "session_id"]
    out = priced.groupBy(*key).agg(F.count("*").alias("turns"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("cost_units").cast("decimal(38,0)")).alias("cost_units"), F.min_by("day", F.when(F.col("day").isNotNull(), F.col("seq"))).alias("first_day"))
    out = out.join(turns.groupBy(*key).agg(F.min_by("snippet", "seq").alias("first_snippet")), key, "left")
    out = out.join(titles.select(*key, "title"), key, "left") if titles is not None else out.withColumn("title", F.lit(None).cast("string"))
    return out.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.nullif("first_snippet", F.lit("")), F.lit("(untitled)"))).drop("first_snippet")


def session_peak_turn(priced: DataFrame) -> DataFrame:
    """The turn of the largest input of each session, the first of equals; none where all are 0."""
    best = priced.where("input_tokens > 0").groupBy("project", "session_id").agg(F.max_by(F.struct("model", "snippet", "file", "input_tokens"), F.struct("input_tokens", -F.col("seq"))).alias("p"))
    return best.select("project", "session_id", "p.*")


def session_detail(priced: DataFrame, cap: int = 200) -> DataFrame:
    """detail: the first cap turns of each session in order, as structs; the cap holds before they are gathered."""
    place = F.row_number().over(Window.partitionBy("project", "session_id").orderBy("seq"))
    rows = priced.withColumn("place", place).where(F.col("place") <= cap)
    turn = F.struct("place", F.col("day").cast("string").alias("day"), "model", "input_tokens", "output_tokens", usd(F.col("cost_units")).alias("cost"), "snippet", "file")
    return rows.groupBy("project", "session_id").agg(F.array_sort(F.collect_list(turn)).alias("detail"))


def top_sessions(sessions: DataFrame, n: int = 100) -> DataFrame:
    """The n sessions of the most input tokens."""
    return sessions.orderBy(F.desc("input_tokens"), "project", "session_id").limit(n)


def daily_cost(cells: DataFrame) -> DataFrame:
    """(day, turns, cost_units) of dated cells."""
    return cells.where("day IS NOT NULL").groupBy("day").agg(F.sum("turns").alias("turns"), F.sum("cost_units").alias("cost_units"))


def peak_day(daily: DataFrame) -> DataFrame:
    """One row: the dearest day, the earliest of equals; none without days."""
    best = daily.agg(F.max_by(F.struct("day", "cost_units"), F.struct("cost_units", -F.unix_date("day"))).alias("p")).where("p IS NOT NULL")
    return best.select("p.day", "p.cost_units")
