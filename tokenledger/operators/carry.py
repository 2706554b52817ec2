"""What earlier rows of a key leave to later ones: sums, last values and places, carried over blocks of the order.

A window over a key puts all of its rows in one task. Here a block of the
order's values is summed up first; what the blocks before it leave is found
over those summaries, and windows run within blocks. A key with a third of
all rows is so spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of the order column that one block spans.
BLOCK = 1 << 16


def _blocks(rows: DataFrame, order: str, width: int) -> DataFrame:
    return rows.withColumn("block_", F.floor(F.col(order) / width))


def _earlier(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)


def _inside(keys: list[str], order: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys, "block_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def sums_before(rows: DataFrame, keys: list[str], order: str, values: dict[str, Column], width: int = BLOCK) -> DataFrame:
    """rows with, for each name, the sum of its value over the earlier rows of the same keys (not null), by order, a unique long."""
    names = list(values)
    rows = _blocks(rows, order, width).withColumns({f"{c}_value_": v for c, v in values.items()})
    sums = rows.groupBy(*keys, "block_").agg(*[F.sum(f"{c}_value_").alias(f"{c}_sum_") for c in names])
    sums = sums.withColumns({f"{c}_base_": F.coalesce(F.sum(f"{c}_sum_").over(_earlier(keys)), F.lit(0)) for c in names}).drop(*[f"{c}_sum_" for c in names])
    out = rows.join(sums, [*keys, "block_"])
    out = out.withColumns({c: (F.col(f"{c}_base_") + F.coalesce(F.sum(f"{c}_value_").over(_inside(keys, (order,))), F.lit(0))).cast("long") for c in names})
    return out.drop("block_", *[f"{c}_value_" for c in names], *[f"{c}_base_" for c in names])


def running_before(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = BLOCK) -> DataFrame:
    """sums_before of one value."""
    return sums_before(rows, keys, order, {name: value}, width)


def last_before(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = BLOCK, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with name: the last value that is not null among the earlier rows of the same keys (not null), by order, a long; ties by further columns."""
    rows = _blocks(rows, order, width).withColumn("value_", value)
    by = (order, *ties)
    ends = rows.where("value_ IS NOT NULL").groupBy(*keys, "block_").agg(F.max_by("value_", F.struct(*by)).alias("end_"))
    # a block without a value hands on what it was given
    ends = rows.select(*keys, "block_").distinct().join(ends, [*keys, "block_"], "left")
    ends = ends.withColumn("base_", F.last("end_", ignorenulls=True).over(_earlier(keys))).drop("end_")
    inside = F.last("value_", ignorenulls=True).over(_inside(keys, by))
    return rows.join(ends, [*keys, "block_"]).withColumn(name, F.coalesce(inside, F.col("base_"))).drop("block_", "value_", "base_")


def previous(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = BLOCK, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with name: the value, null or not, of the row before of the same keys; null for the first."""
    out = last_before(rows, keys, order, F.struct(value.alias("v")), name, width, ties)
    return out.withColumn(name, F.col(name).getField("v"))


def place(rows: DataFrame, keys: list[str], order: str, name: str, width: int = BLOCK) -> DataFrame:
    """rows with name: the place among the rows of the same keys, from 1."""
    return sums_before(rows, keys, order, {name: F.lit(1).cast("long")}, width).withColumn(name, F.col(name) + 1)
