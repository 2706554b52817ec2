"""Prices, credits and costs. Money is counted in units of 1e-13 USD as long: a price in 1e-7 USD a million tokens, times tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.settings import DEFAULTS, Settings

UNITS = 10_000_000


def usd(units: Column) -> Column:
    """Units as double dollars."""
    return units.cast("double") / 1e13


def total_usd(units: str) -> Column:
    """The exact sum of a column of units, as double dollars."""
    return usd(F.sum(F.col(units).cast("decimal(38,0)")))


def in_dollars(df: DataFrame) -> DataFrame:
    """df with every column x_units as x_cost in dollars (cost_units as cost)."""
    return df.select(*[usd(F.col(c)).alias("cost" if c == "cost_units" else c.removesuffix("_units") + "_cost") if c.endswith("_units") else F.col(c) for c in df.columns])


def build_price_book(spark: SparkSession, s: Settings = DEFAULTS) -> DataFrame:
    """(ordinal, price_key, p_in, p_out): the defaults with overrides in their places, then new keys; prices in units a token."""
    return spark.createDataFrame([(i, k, round(a * UNITS), round(b * UNITS)) for i, k, a, b in s.prices()], "ordinal int, price_key string, p_in long, p_out long")


def build_credit_book(spark: SparkSession, s: Settings = DEFAULTS) -> DataFrame:
    return spark.createDataFrame([tuple(x) for x in s.credits()], "ordinal int, credit_key string, multiplier double")


def _longest_first(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: (-len(r[1]), r[0]))


def price_of(model: Column, s: Settings = DEFAULTS) -> Column:
    """struct(price_key, p_in, p_out) of the longest key within the model's name, the first in order of equals; a null key with the fallback."""
    name, pick = F.lower(F.coalesce(model, F.lit(""))), None
    for _, key, a, b in _longest_first(s.prices()):
        value = F.struct(F.lit(key).alias("price_key"), F.lit(round(a * UNITS)).cast("long").alias("p_in"), F.lit(round(b * UNITS)).cast("long").alias("p_out"))
        pick = F.when(name.contains(key), value) if pick is None else pick.when(name.contains(key), value)
    none = F.struct(F.lit(None).cast("string").alias("price_key"), *[F.lit(round(x * UNITS)).cast("long").alias(c) for x, c in zip(s.fallback, ("p_in", "p_out"), strict=True)])
    return none if pick is None else pick.otherwise(none)


def model_prices(models: DataFrame, book: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(model, price_key, input_per_m, output_per_m, matched) of distinct models by a book of any size: the join behind price_of."""
    hit = F.lower(F.coalesce("model", F.lit(""))).contains(F.col("price_key"))
    found = models.select("model").distinct().join(F.broadcast(book), hit, "left")
    best = found.groupBy("model").agg(F.max_by(F.struct("price_key", "p_in", "p_out"), F.struct(F.length("price_key"), -F.col("ordinal"))).alias("p"))
    fall = [round(x * UNITS) for x in s.fallback]
    price = lambda c, f: usd(F.coalesce(F.col(f"p.{c}"), F.lit(f)) * 1_000_000)
    return best.select("model", "p.price_key", price("p_in", fall[0]).alias("input_per_m"), price("p_out", fall[1]).alias("output_per_m"), F.col("p.price_key").isNotNull().alias("matched"))


def credits_of(model: Column, s: Settings = DEFAULTS) -> Column:
    """struct(credit_key, multiplier) by the longest key; a null key and 1 where none fits."""
    name, pick = F.lower(F.coalesce(model, F.lit(""))), None
    for _, key, value in _longest_first(s.credits()):
        c = F.struct(F.lit(key).alias("credit_key"), F.lit(float(value)).alias("multiplier"))
        pick = F.when(name.contains(key), c) if pick is None else pick.when(name.contains(key), c)
    none = F.struct(F.lit(None).cast("string").alias("credit_key"), F.lit(1.0).alias("multiplier"))
    return none if pick is None else pick.otherwise(none)


def has_hint(model: Column, hints: tuple) -> Column:
    name, out = F.lower(F.coalesce(model, F.lit(""))), F.lit(False)
    for hint in hints:
        out = out | name.contains(hint.lower())
    return out


def is_reasoning(model: Column, s: Settings = DEFAULTS) -> Column:
    return has_hint(model, s.reasoning_hints)


def output_multiplier(model: Column, s: Settings = DEFAULTS, calibrated: Column | None = None) -> Column:
    """What a reasoning model's output is multiplied with: what its own history shows, else the setting; 1 for others."""
    own = F.lit(float(s.reasoning_multiplier))
    return F.when(is_reasoning(model, s), own if calibrated is None else F.coalesce(calibrated, own)).otherwise(1.0)


def with_learnt(rows: DataFrame, multipliers: DataFrame | None) -> tuple[DataFrame, Column | None]:
    """rows with learnt, the multiplier (model, multiplier) of their model's history, and that column; rows as they are and None without any."""
    if multipliers is None:
        return rows, None
    return rows.join(F.broadcast(multipliers.select("model", F.col("multiplier").alias("learnt"))), "model", "left"), F.col("learnt")  # a row for each model


def projected_output(context_tokens: Column, multiplier: Column) -> Column:
    """The output expected of a request: three tenths of its context, 2000 at most, times the multiplier, rounded up."""
    return F.ceil(F.least(F.lit(2000.0), F.ceil(context_tokens * 0.3).cast("double")) * multiplier).cast("long")


def _share(s: Settings) -> tuple[float, float]:
    return max(0.0, min(1.0, s.assumed_cache_fraction)), max(0.0, s.cache_read_multiplier)


def input_units(tokens: Column, price: Column, cache_read: Column, s: Settings = DEFAULTS) -> Column:
    """Input cost: cached tokens (clamped to the input) at the cache rate where they are known, else the assumed fraction of all."""
    fraction, rate = _share(s)
    cached = F.greatest(F.lit(0).cast("long"), F.least(cache_read, tokens))
    real = (tokens - cached) * price + F.floor(cached * price * rate + 0.5).cast("long")
    assumed = F.floor(tokens * price * (1 - fraction * (1 - rate)) + 0.5).cast("long") if fraction else tokens * price
    return F.when(cache_read.isNotNull(), real).otherwise(assumed)


def local_day(ts: Column, s: Settings = DEFAULTS) -> Column:
    """The day of a time in the settings' time zone; in the session's where they name none."""
    if s.timezone is None:
        return F.to_date(ts)
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit(s.timezone), ts.cast("timestamp").cast("timestamp_ntz")))


def price_turns(turns: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """turns with day, price_key, p_in, p_out, cached_tokens, input_units, output_units, cost_units."""
    out = turns.withColumn("price", price_of(F.col("model"), s))
    out = out.withColumn("input_units", input_units(F.col("input_tokens"), F.col("price.p_in"), F.col("cache_read_tokens"), s))
    out = out.withColumns({
        "day": local_day(F.col("ts"), s), "price_key": F.col("price.price_key"), "p_in": F.col("price.p_in"), "p_out": F.col("price.p_out"),
        "cached_tokens": F.greatest(F.lit(0).cast("long"), F.least("cache_read_tokens", "input_tokens")), "output_units": F.col("output_tokens") * F.col("price.p_out"),
    })
    return out.withColumn("cost_units", F.col("input_units") + F.col("output_units")).drop("price")


def list_cost(turns: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """turns with cost_usd at list prices, no cache."""
    p = price_of(F.col("model"), s)
    return turns.withColumn("cost_usd", usd(F.col("input_tokens") * p["p_in"] + F.col("output_tokens") * p["p_out"]))


def cheaper_of(model: Column, tokens_in: Column, tokens_out: Column, s: Settings = DEFAULTS) -> Column:
    """struct(model, now, best) of the cheapest key for these tokens, null where it saves less than the floor.

    The book is gone through in order: a key that isn't part of the model's
    name is taken if it costs less than the best so far by a thousandth.
    """
    own = price_of(model, s)
    now = tokens_in * own["p_in"] + tokens_out * own["p_out"]
    book = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(round(a * UNITS)).cast("long").alias("a"), F.lit(round(b * UNITS)).cast("long").alias("b")) for _, k, a, b in s.prices()])
    # arrays of one: their lambdas name what has been worked out, where an expression used twice would be worked out twice
    asked = F.array(F.struct(F.lower(F.coalesce(model, F.lit(""))).alias("name"), tokens_in.alias("tin"), tokens_out.alias("tout"), now.alias("now")))

    def found(q: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            cost = q["tin"] * p["a"] + q["tout"] * p["b"]
            return F.when(~q["name"].contains(p["k"]) & (cost < acc["best"] * 0.999), F.struct(cost.alias("best"), p["k"].alias("model"))).otherwise(acc)

        start = F.struct(q["now"].alias("best"), F.lit(None).cast("string").alias("model"))
        return F.aggregate(book, start, step, lambda acc: F.struct(acc["model"].alias("model"), q["now"].alias("now"), acc["best"].alias("best")))

    return F.get(F.filter(F.transform(asked, found), lambda x: x["model"].isNotNull() & (x["now"] > 0) & ((x["now"] - x["best"]) / x["now"].cast("double") >= s.suggestion_floor)), 0)


def cheapest_family(s: Settings = DEFAULTS) -> tuple[str, int, int]:
    """(key, p_in, p_out) of the lowest mean of input and output price, the first of equals."""
    return min(((k, round(a * UNITS), round(b * UNITS)) for _, k, a, b in s.prices()), key=lambda r: r[1] + r[2])


def turn_receipts(turns: DataFrame, s: Settings = DEFAULTS, multipliers: DataFrame | None = None) -> DataFrame:
    """turns (input_tokens, output_tokens, tool_result_tokens, model) with input_total, billed_output, cost_usd, credits, projected_usd, delta_pct.

    multipliers: (model, multiplier) learnt from history; without it the setting counts for reasoning models.
    """
    turns, own = with_learnt(turns, multipliers)
    p, c, m = price_of(F.col("model"), s), credits_of(F.col("model"), s), output_multiplier(F.col("model"), s, own)
    out = turns.withColumn("p", p).withColumn("c", c).withColumn("m", m)
    out = out.withColumns({"input_total": F.col("input_tokens") + F.col("tool_result_tokens"), "billed_output": F.ceil(F.col("output_tokens") * F.col("m")).cast("long"), "projected": projected_output(F.col("input_tokens"), F.col("m"))})
    out = out.withColumns({"act": F.col("input_total") * F.col("p.p_in") + F.col("billed_output") * F.col("p.p_out"), "est": F.col("input_tokens") * F.col("p.p_in") + F.col("projected") * F.col("p.p_out")})
    out = out.withColumns({
        "cost_usd": usd(F.col("act")), "credits": F.when(F.col("c.credit_key").isNotNull() & (F.col("c.multiplier") > 0), F.col("c.multiplier")), "projected_usd": usd(F.col("est")),
        "delta_pct": F.when(F.col("est") == 0, F.lit(0).cast("long")).otherwise(F.floor((F.col("act") - F.col("est")) * 100.0 / F.col("est") + 0.5).cast("long")),
    })
    return out.drop("p", "c", "m", "act", "est", "learnt")
