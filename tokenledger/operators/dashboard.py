"""Figures of the dashboard, all from the cube of cells (day, model, project, turns, tokens, units) and from sessions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenledger.functions.text import half_up
from tokenledger.operators.pricing import cheapest_family, price_of, total_usd, usd
from tokenledger.operators.usage import daily_cost, peak_day
from tokenledger.settings import DEFAULTS, Settings


def _between(day: Column, first: str | None, last: str | None) -> Column:
    """Undated always passes."""
    inside = F.lit(True)
    inside = inside & (day >= F.lit(first).cast("date")) if first else inside
    inside = inside & (day <= F.lit(last).cast("date")) if last else inside
    return day.isNull() | inside


def filter_cells(cells: DataFrame, models: Iterable[str] | None = None, projects: Iterable[str] | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Cells of the given models and projects (None: all) between two days; undated cells always pass."""
    out = cells if models is None else cells.where(F.col("model").isin(*models))
    out = out if projects is None else out.where(F.col("project").isin(*projects))
    return out.where(_between(F.col("day"), date_from, date_to))


def _holds(text: Column, query: str) -> Column:
    return F.coalesce(F.lower(text).contains(query), F.lit(False))


def search_sessions(sessions: DataFrame, detail: DataFrame, query: str = "", projects: Iterable[str] | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Sessions of the projects between two days whose title, or the snippet or file of a turn of their detail, holds the query; with those turns as hits.

    An empty query passes all, with all turns as hits. Models play no part.
    """
    q = query.lower().strip()
    rows = sessions if projects is None else sessions.where(F.col("project").isin(*projects))
    rows = rows.where(_between(F.col("first_day"), date_from, date_to)).join(detail, ["project", "session_id"], "left")
    none = F.array().cast(detail.schema["detail"].dataType)
    rows = rows.withColumn("hits", F.coalesce(F.filter("detail", lambda t: _holds(t["snippet"], q) | _holds(t["file"], q)), none))
    return rows.where(_holds(F.col("title"), q) | (F.size("hits") > 0) | F.lit(not q)).drop("detail")


def filter_domains(cells: DataFrame) -> DataFrame:
    """One row: the models and projects there are, sorted, and the first and last day."""
    return cells.agg(F.array_sort(F.collect_set("model")).alias("models"), F.array_sort(F.collect_set("project")).alias("projects"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def cards(cells: DataFrame) -> DataFrame:
    """One row of the dashboard's cards for the (filtered) cells; credits are whole cents."""
    out = cells.agg(total_usd("cost_units").alias("cost"), total_usd("input_units").alias("input_cost"), total_usd("output_units").alias("output_cost"), F.sum("turns").alias("turns"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count_distinct("model").alias("models"))
    zero = F.lit(0.0)
    out = out.withColumns({"input_share": F.coalesce(F.try_divide("input_cost", "cost"), zero), "cost_per_turn": F.coalesce(F.try_divide("cost", "turns"), zero), "credits": half_up(F.col("cost") / 0.01)})
    peak = peak_day(daily_cost(cells)).select(F.col("day").alias("peak_day"), usd(F.col("cost_units")).alias("peak_cost"))
    return out.join(F.broadcast(peak), how="left")


def trend_delta(cells: DataFrame, all_cells: DataFrame) -> DataFrame:
    """One row: cost of the last 7 days and of the 7 before, the change in per cent (null without a prior cost) and its direction, up to the last day of all_cells."""
    last = all_cells.agg(F.max("day").alias("last_"))
    rows = cells.join(F.broadcast(last), how="cross")
    now, was = F.col("day") >= F.date_sub("last_", 6), (F.col("day") < F.date_sub("last_", 6)) & (F.col("day") >= F.date_sub("last_", 13))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("cost_units").cast("decimal(38,0)"))), F.lit(0))
    out = rows.agg(total(now).cast("double").alias("n"), total(was).cast("double").alias("w")).withColumn("change_pct", F.when(F.col("w") > 0, (F.col("n") - F.col("w")) / F.col("w") * 100))
    way = F.when(F.col("change_pct") > 2, "up").when(F.col("change_pct") < -2, "down").when(F.col("change_pct").isNotNull(), "flat")
    return out.select((F.col("n") / 1e13).alias("last_7d"), (F.col("w") / 1e13).alias("prior_7d"), "change_pct", way.alias("direction"))


def attribution(cells: DataFrame, key: str) -> DataFrame:
    """(key, cost, share of all) of model or project, the dearest first; the total is one row, broadcast."""
    per = cells.groupBy(key).agg(F.sum("cost_units").alias("c"))
    total = cells.agg(F.sum("cost_units").cast("double").alias("t"))
    share = F.coalesce(F.try_divide(F.col("c").cast("double"), F.col("t")), F.lit(0.0))
    return per.join(F.broadcast(total), how="cross").select(key, usd(F.col("c")).alias("cost"), share.alias("share")).orderBy(F.desc("cost"), key)


def by_model(cells: DataFrame) -> DataFrame:
    return cells.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("turns", "input_tokens", "output_tokens", "input_units", "output_units", "cost_units")])


def model_efficiency(cells: DataFrame) -> DataFrame:
    """Per model: dollars a turn and a thousand tokens in and out, output to input, the input's part of the cost in per cent; 0 where nothing is."""
    m = by_model(cells)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    cost, ci, co = (usd(F.col(c)) for c in ("cost_units", "input_units", "output_units"))
    n, i, o = F.col("turns"), F.col("input_tokens"), F.col("output_tokens")
    return m.select("model", ratio(cost, n).alias("usd_per_turn"), ratio(ci * 1000, i).alias("usd_per_1k_in"), ratio(co * 1000, o).alias("usd_per_1k_out"), ratio(o.cast("double"), i).alias("out_in_ratio"), ratio(ci * 100, cost).alias("input_cost_pct"))


def savings_whatif(cells: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row: what the cells' tokens would save on the cheapest family, by models of four times its blended price or more; emitted: worth telling."""
    key, a, b = cheapest_family(s)
    m = by_model(cells).withColumn("p", price_of(F.col("model"), s))
    saved = F.col("cost_units") - (F.col("input_tokens").cast("decimal(38,0)") * a + F.col("output_tokens").cast("decimal(38,0)") * b)
    out = m.agg(F.sum(F.when((F.col("p.p_in") + F.col("p.p_out") >= 4 * (a + b)) & (saved > 0), saved).otherwise(0)).cast("double").alias("v"), F.sum("cost_units").cast("double").alias("t")).where("t IS NOT NULL")
    return out.select(F.lit(key).alias("family"), (F.col("v") / 1e13).alias("savings"), ((F.col("v") > 5e10) & (F.col("v") >= 0.05 * F.col("t"))).alias("emitted"))


def insights(cells: DataFrame, sessions: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(insight, subject, share): top driver, input- or output-heavy, priciest session, peak day, cheaper family; none without spend."""
    top = attribution(cells, "model").limit(1).select(F.lit("top_driver").alias("insight"), F.col("model").alias("subject"), "share")
    sums = cells.agg(*[F.sum(c).cast("double").alias(c) for c in ("input_units", "output_units", "cost_units")]).where("cost_units > 0")
    i, o = F.col("input_units") / F.col("cost_units"), F.col("output_units") / F.col("cost_units")
    heavy = sums.select(F.when(i >= 0.65, "input_heavy").when(o >= 0.6, "output_heavy").alias("insight"), F.lit("all").alias("subject"), F.when(i >= 0.65, i).otherwise(o).alias("share")).where("insight IS NOT NULL")
    dear = sessions.where("cost_units > 0").orderBy(F.desc("cost_units"), "project", "session_id").limit(1).select(F.lit("priciest_session").alias("insight"), F.col("session_id").alias("subject"), usd(F.col("cost_units")).alias("share"))
    part = F.col("peak_units") / F.col("cost_units")
    peak = peak_day(daily_cost(cells)).select("day", F.col("cost_units").cast("double").alias("peak_units")).join(sums, how="cross").where(part >= 0.4).select(F.lit("peak_day").alias("insight"), F.col("day").cast("string").alias("subject"), part.alias("share"))
    save = savings_whatif(cells, s).where("emitted").select(F.lit("cheaper_family").alias("insight"), F.col("family").alias("subject"), F.col("savings").alias("share"))
    return top.join(sums.select(), how="cross").unionByName(save).unionByName(heavy).unionByName(dear).unionByName(peak)


def cumulative_cost(daily: DataFrame) -> DataFrame:
    """(day, cumulative): the window runs over one row a day."""
    return daily.select("day", usd(F.sum("cost_units").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))).alias("cumulative"))


def moving_average(daily: DataFrame, rows: int = 7) -> DataFrame:
    """(day, average) over so many days with turns, not calendar days."""
    w = Window.orderBy("day").rowsBetween(1 - rows, 0)
    return daily.select("day", (usd(F.sum("cost_units").over(w)) / F.count("*").over(w)).alias("average"))


def _day_models(cells: DataFrame) -> DataFrame:
    rank = by_model(cells).select("model", F.row_number().over(Window.orderBy(F.desc("cost_units"), "model")).alias("model_rank"))
    per = cells.where("day IS NOT NULL").groupBy("day", "model").agg(F.sum("cost_units").alias("cost_units"))
    return per.join(F.broadcast(rank), "model")


def stacked_layers(cells: DataFrame) -> DataFrame:
    """(day, model, lower, upper): each day's costs on top of each other, the dearest model of all at the bottom."""
    top = F.sum("cost_units").over(Window.partitionBy("day").orderBy("model_rank").rowsBetween(Window.unboundedPreceding, 0))
    return _day_models(cells).withColumn("top", top).select("day", "model", usd(F.col("top") - F.col("cost_units")).alias("lower"), usd(F.col("top")).alias("upper"))


def daily_top_models(cells: DataFrame, k: int = 5) -> DataFrame:
    """The k dearest models of each day, of those that cost something."""
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("cost_units"), "model"))
    return _day_models(cells).where("cost_units > 0").withColumn("place", place).where(F.col("place") <= k).select("day", "model", usd(F.col("cost_units")).alias("cost"), F.col("place").cast("long").alias("place"))


def export_rows(cells: DataFrame) -> DataFrame:
    """Cells as they are exported: date text, costs at 6 places."""
    six = lambda c: half_up(F.col(c).cast("double") / 1e13, 6)
    return cells.select(F.coalesce(F.col("day").cast("string"), F.lit("undated")).alias("date"), "model", "project", "turns", "input_tokens", "output_tokens", six("input_units").alias("input_cost"), six("output_units").alias("output_cost"), six("cost_units").alias("cost"))
