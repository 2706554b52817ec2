"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenledger.llm.common import bounded, discard, save, table

#: Virtual nodes of a shard, and bits of a position on the ring, of which the first CELL name a cell.
NODES, BITS, CELL = 128, 60, 12
#: Rows of a block of the ring, about, and copies of a row that one task makes.
BLOCK, COPIES = 1 << 14, 1 << 16


def _position(*parts: Column) -> Column:
    return F.conv(F.left(F.md5(F.concat_ws(":", *parts).cast("binary")), F.lit(BITS // 4)), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int, nodes: int = NODES, seed: int = 12) -> DataFrame:
    """(node, shard, position, walk) of the ring's shards * nodes virtual nodes, numbered by position.

    walk: all shards in the order in which they are met from the node on,
    clockwise. Nothing here depends on data: the windows run over the nodes.
    """
    name = lambda c: F.col(c).cast("string")
    points = spark.range(shards * nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("replica"))
    points = points.select("shard", _position(F.lit(str(seed)), name("shard"), name("replica")).alias("position"))
    order = Window.orderBy("position", "shard")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    points = points.select("shard", "position", (F.row_number().over(order) - 1).alias("node"), F.collect_list("shard").over(every).alias("all"))
    walk = F.array_distinct(F.concat(F.expr("slice(all, node + 1, size(all))"), F.expr("slice(all, 1, node)")))
    return points.select("node", "shard", "position", walk.alias("walk"))


def _cells(nodes: DataFrame, n: int) -> DataFrame:
    """(cell, base, bounds): the number of nodes before each cell of the ring, and the positions of those in it."""
    spark = nodes.sparkSession
    inside = nodes.groupBy(F.shiftright("position", BITS - CELL).alias("cell")).agg(F.array_sort(F.collect_list("position")).alias("bounds"))
    cells = spark.range(1 << CELL).select(F.col("id").alias("cell")).join(inside, "cell", "left").select("cell", F.coalesce("bounds", F.array().cast("array<bigint>")).alias("bounds"))
    before = F.coalesce(F.sum(F.size("bounds")).over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.select("cell", before.cast("int").alias("base"), "bounds")


#: The arcs in the ring's order; what comes to a node goes to the shards of its walk as far as they have room.
_FLOW = """
aggregate(arcs, named_struct('room', room, 'moves', cast(array() AS array<struct<node:int,lo:bigint,hi:bigint,shard:int>>)),
  (a, x) -> aggregate(x.walk, named_struct('room', a.room, 'moves', a.moves, 'lo', 0L),
    (b, s) -> CASE WHEN b.lo >= x.mass OR b.room[s] <= 0 THEN b ELSE aggregate(array(least(x.mass - b.lo, b.room[s])), b,
      (c, take) -> named_struct('room', transform(c.room, (r, i) -> if(i = s, r - take, r)),
                                'moves', concat(c.moves, array(named_struct('node', x.node, 'lo', c.lo, 'hi', c.lo + take, 'shard', s))), 'lo', c.lo + take)) END,
    b -> named_struct('room', b.room, 'moves', b.moves)),
  a -> a.moves)
"""


def _copied(rows: DataFrame) -> DataFrame:
    """rows (n, before, weight) n times over, with before of each copy; many copies of one row are dealt out in runs."""
    few = rows.where(F.col("n") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    runs = rows.where(F.col("n") > COPIES).withColumn("from_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    runs = runs.repartition("position", "from_").withColumn("copy", F.explode(F.sequence(F.col("from_"), F.least(F.col("from_") + COPIES, F.col("n")) - 1))).drop("from_")
    return few.unionByName(runs).withColumn("before", F.col("before") + F.col("copy") * F.col("weight")).withColumn("nth", F.col("nth") + F.col("copy"))


def shard_rows(docs: DataFrame, shards: int = 24, law: str = "rows", slack: float = 0.0, nodes: int = NODES, seed: int = 12) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Each row has a position on the ring by a hash of doc_id, size and checksum
    and belongs to the next virtual node clockwise. A shard has room for its
    part of all rows (law `rows`: whole numbers one apart at most) or bytes
    (`bytes`), times 1 + slack; what comes to a full shard goes on clockwise,
    node by node in the ring's order. So loads are bounded by their room, and
    of `bytes` by one document more; with other data or one shard more only
    rows near the full shards' nodes go elsewhere.

    Rows are counted by block of the ring and by arc (the way between two
    nodes); the arcs' counts, shards * nodes at most, are all that the flow
    needs, which yields intervals of each arc's rows for each shard. No window
    holds more than a block of the ring, and only ids, sizes and checksums are
    shuffled. slot numbers a shard's rows from 0: those of earlier intervals,
    then the place in the interval.

    Null text: size 8, checksum 0. Null doc_id: a value like others. Repeated
    rows: one position, each with its own slot; many are dealt out in runs.
    No rows: no rows. grown_shard is null (a shard more moves rows among the
    others too). Other columns are ignored.
    """
    spark = docs.sparkSession
    if law not in ("rows", "bytes"):
        raise ValueError(f"law is {law!r}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    rows = save(rows.withColumn("position", _position(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("text_crc32").cast("string"))), "shard-rows")
    weight = F.lit(1).cast("long") if law == "rows" else F.col("size")
    count, mass = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * weight), F.lit(0))).first()

    points = save(ring(spark, shards, nodes, seed), "shard-ring")
    cells = F.broadcast(_cells(points, shards * nodes))  # 4096 rows
    arc = rows.withColumn("cell", F.shiftright("position", BITS - CELL)).join(cells, "cell").withColumn("weight", weight)
    arc = arc.withColumn("node", ((F.col("base") + F.size(F.filter("bounds", lambda b: b < F.col("position")))) % (shards * nodes)).cast("int")).drop("cell", "base", "bounds")
    bits = max(0, min(BITS, math.ceil(math.log2(max(1, count) / BLOCK))))
    inside = Window.partitionBy("node", "block").orderBy("position", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda v: F.coalesce(F.sum(v).over(inside), F.lit(0))
    placed = arc.withColumn("block", F.shiftright("position", BITS - bits)).withColumns({"before": sofar(F.col("n") * F.col("weight")), "nth": sofar(F.col("n"))})
    placed = save(placed, "shard-arcs")
    discard(rows)

    sums = placed.groupBy("node", "block").agg(F.sum(F.col("n") * F.col("weight")).alias("mass"), F.sum("n").alias("count"))
    earlier = Window.partitionBy("node").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = save(sums.select("node", "block", "mass", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_base") for c in ("mass", "count")]), "shard-blocks")

    room = [count // shards + (s < count % shards) if law == "rows" and not slack else math.ceil(mass * (1 + slack) / shards) for s in range(shards)]
    arcs = points.join(sums.groupBy("node").agg(F.sum("mass").alias("mass")), "node").groupBy().agg(F.array_sort(F.collect_list(F.struct("node", "mass", "walk"))).alias("arcs"))
    moves = arcs.select(F.col("arcs"), F.array(*[F.lit(r).cast("long") for r in room]).alias("room")).select(F.expr(f"inline({_FLOW})"))
    moves = save(moves, "shard-moves")  # an arc ends or a shard is full with each: shards * (nodes + 1) rows at most

    based = placed.join(bounded(sums.drop("mass")), ["node", "block"])
    based = based.withColumns({"before": F.col("before") + F.col("mass_base"), "nth": F.col("nth") + F.col("count_base")}).drop("mass_base", "count_base", "block")
    to = F.broadcast(moves)
    rows = _copied(based)
    given = rows.join(to, (rows["node"] == to["node"]) & (rows["before"] >= to["lo"]) & (rows["before"] < to["hi"])).select("doc_id", "size", "text_crc32", "shard", rows["node"].alias("node"), "lo", "nth")
    given = save(given, "shard-given")
    # the first place of each interval, and the rows of the shard's earlier ones
    firsts = given.groupBy("shard", "node", "lo").agg(F.min("nth").alias("first"), F.count("*").alias("count"))
    firsts = firsts.withColumn("slot_base", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("node", "lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    out = given.join(F.broadcast(firsts), ["shard", "node", "lo"])
    out = out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("slot_base") + F.col("nth") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    for used in (placed, sums, points, moves):
        discard(used)
    return out


def op12_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal numbers of rows."""
    return shard_rows(table(spark, sf_dir, "documents"))


ORACLE_SQL = None
