"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenledger.llm.common import WORD, bounded, save, table

#: Documents that one fold takes, about; also the tree's fan-in.
FAN = 64

_FOLD = """
aggregate(
  array_sort(units, (x, y) -> CASE WHEN x.size <> y.size THEN cast(sign(y.size - x.size) AS int)
                                   WHEN x.h <> y.h THEN CASE WHEN x.h < y.h THEN -1 ELSE 1 END ELSE 0 END),
  named_struct('cur', cast(null AS struct<id:struct<d:bigint,t:bigint>,size:bigint,h:bigint,p:double>),
               'done', cast(array() AS array<struct<id:struct<d:bigint,t:bigint>,size:bigint,up:int>>)),
  (a, x) -> CASE WHEN a.cur IS NULL THEN named_struct('cur', x, 'done', a.done)
    ELSE aggregate(array(named_struct('s', a.cur.p + x.p,
                                      'u', pmod(xxhash64({seed}, a.cur.h, x.h), 9007199254740992) / 9007199254740992D)),
      a, (b, t) -> CASE
        WHEN t.s < 1 AND t.u * t.s < b.cur.p THEN
          named_struct('cur', named_struct('id', b.cur.id, 'size', b.cur.size, 'h', b.cur.h, 'p', t.s),
                       'done', concat(b.done, array(named_struct('id', x.id, 'size', x.size, 'up', 0))))
        WHEN t.s < 1 THEN
          named_struct('cur', named_struct('id', x.id, 'size', x.size, 'h', x.h, 'p', t.s),
                       'done', concat(b.done, array(named_struct('id', b.cur.id, 'size', b.cur.size, 'up', 0))))
        WHEN t.u * (2 - t.s) < 1 - x.p THEN
          named_struct('cur', named_struct('id', x.id, 'size', x.size, 'h', x.h, 'p', t.s - 1),
                       'done', concat(b.done, array(named_struct('id', b.cur.id, 'size', b.cur.size, 'up', 1))))
        ELSE
          named_struct('cur', named_struct('id', b.cur.id, 'size', b.cur.size, 'h', b.cur.h, 'p', t.s - 1),
                       'done', concat(b.done, array(named_struct('id', x.id, 'size', x.size, 'up', 1))))
      END)
  END)
"""


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) of sizes (source, size).

    Sources in code point order, null last, take the weights in turn and share
    the total of all sizes; a target stops at cap times its source's size and
    the excess is shared again by weight: the level at which the capped shares
    add up to the total. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("ratio", F.col("source_size") * cap / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap) / F.sum("w").over(rest))
    per = per.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    return per.select("source", "source_size", F.least(F.col("w") * F.col("level"), F.col("source_size") * cap).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple = (5, 2, 1), cap: float = 3.0, seed: int = 11, size: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, t (hash of the text), source, size, source_size, target, copies, taken.

    A document's expected number of copies is its source's target over its
    source's size: the whole part is certain, and the fractions are rounded
    together by the pivotal method. Two fractional documents meet, one gives
    the other its mass until one of them is 0 or 1, and the other goes on. The
    documents meet in folds of about FAN of near sizes of one source; each
    fold leaves one fractional document at most, and the rest of all folds
    meet in the next level, down to one per source: a reduction tree of
    log(rows)/log(FAN) levels, in which a hot source is spread over as many
    folds as its rows need. All draws are hashes of seed and doc_id: reruns agree.

    Null or empty text: size 0, nothing taken. Null source: a source of its own,
    last in order. Null doc_id and repeated rows: each row counts and is drawn by
    itself. No rows: no rows. Other columns are ignored.
    """
    words = F.expr(size) if size else F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("source").cast("string").alias("source"), words.cast("long").alias("size"))
    # repeated rows become one row and its times, then rows again that their place sets apart
    rows = rows.groupBy("doc_id", "t", "source", "size").agg(F.count("*").cast("int").alias("times"))
    rows = save(rows.select("doc_id", "t", "source", "size", F.explode(F.sequence(F.lit(1), "times")).alias("place")), "mix-sizes")
    targets = save(source_targets(rows, weights, cap), "mix-targets").withColumn("rate", F.least(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)), F.lit(float(cap))))
    small = bounded(targets.select(F.col("source").alias("s"), "source_size", "target", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p")), 100_000)
    joined = rows.join(small, rows["source"].eqNullSafe(small["s"]), "left").drop("s")
    sure = joined.where("p <= 1e-12 OR size = 0").select("doc_id", "t", "source", "size", F.lit(0).alias("up"))
    units = joined.where("p > 1e-12 AND size > 0").select("source", F.floor(F.log("size") * 8).cast("int").alias("class"), F.struct(F.struct(F.col("doc_id").alias("d"), "t").alias("id"), "size", F.xxhash64(F.lit(seed), "doc_id", "t", "place").alias("h"), "p").alias("unit"))
    level, decided = max(0, math.ceil(math.log2(max(1, rows.count()) / FAN))), []
    while True:
        last = level < 0
        keys = [F.col("source")] if last else [F.col("source"), F.col("class"), F.pmod(F.col("unit.h"), F.lit(1 << level)).alias("bucket")]
        folds = units.groupBy(*keys).agg(F.collect_list("unit").alias("units")).withColumn("fold", F.expr(_FOLD.format(seed=int(seed))))
        folds = save(folds.select("source", *([] if last else ["class"]), "fold"), "mix-level")
        decided.append(folds.select("source", F.explode("fold.done").alias("d")).select(F.col("d.id.d").alias("doc_id"), F.col("d.id.t").alias("t"), "source", F.col("d.size").alias("size"), F.col("d.up").alias("up")))
        if last:
            draw = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("fold.cur.h")), F.lit(1 << 53)) / F.lit(float(1 << 53))
            decided.append(folds.select(F.col("fold.cur.id.d").alias("doc_id"), F.col("fold.cur.id.t").alias("t"), "source", F.col("fold.cur.size").alias("size"), (draw < F.col("fold.cur.p")).cast("int").alias("up")))
            break
        units = folds.select("source", "class", F.col("fold.cur").alias("unit"))
        level = -1 if level == 0 else max(0, level - int(math.log2(FAN)))
    out = sure
    for part in decided:
        out = out.unionByName(part)
    out = out.join(small, out["source"].eqNullSafe(small["s"]), "left")
    return out.select("doc_id", "t", "source", "size", "source_size", "target", (F.col("whole") + F.col("up")).alias("copies"), ((F.col("whole") + F.col("up")) * F.col("size")).cast("long").alias("taken"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 in turn, with a cap of 3 copies."""
    return mix_sources(table(spark, sf_dir, "documents")).drop("t")


ORACLE_SQL = None
