"""Approximate nearest neighbours: NN-descent graph by Spark joins, greedy graph search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenledger.llm.common import bounded, discard, groups, save, table

#: Neighbours kept in the graph, first neighbours from each random tree, trees, members of a leaf (about) and of a block (at most).
DEGREE, FIRST, TREES, LEAF, BLOCK = 24, 14, 12, 1_100, 1_900
#: Rounds of NN-descent end when fewer than this share of all lists change, or after so many.
SETTLED, MOST_ROUNDS = 0.01, 12
#: Search: nodes kept for a query, nodes expanded in a hop. Hops end when every kept node is expanded.
BEAM, WIDTH = 96, 24

_GRAPH = "id long, near array<long>, score array<float>"


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.float32).reshape(-1, dim)


def _best(ids, near, score, keep: int) -> pa.RecordBatch:
    """The keep best of near for each of ids; equal pairs count once."""
    order = np.lexsort((near, -score, ids))
    ids, near, score = ids[order], near[order], score[order]
    pair = np.lexsort((near, ids))
    again = np.zeros(len(ids), bool)
    again[pair[1:]] = (ids[pair[1:]] == ids[pair[:-1]]) & (near[pair[1:]] == near[pair[:-1]])
    ids, near, score = ids[~again], near[~again], score[~again]
    u, first, count = np.unique(ids, return_index=True, return_counts=True)
    rank = np.arange(len(ids)) - np.repeat(first, count)
    ok = rank < keep
    at = pa.array(np.concatenate([[0], np.cumsum(np.minimum(count, keep))]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(x[ok])) for x in (near, score.astype(np.float32))]
    return pa.RecordBatch.from_arrays([pa.array(u), *lists], ["id", "near", "score"])


def _leaves(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    for group in groups(batches):
        ids, x = group["id"].to_numpy(), _matrix(group["vector"].combine_chunks(), dim)
        for at in range(0, len(ids), 512):
            s = x[at : at + 512] @ x.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
            k = min(FIRST, len(ids) - 1)
            if k:
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                yield _best(np.repeat(ids[at : at + len(s)], k), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel(), k)


def _local_joins(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """At a pivot all its neighbours meet; pairs that beat the worst neighbour of one of them are emitted for it."""
    out: list[list] = [[], [], []]
    for group in groups(batches):
        ids, first = np.unique(group["id"].to_numpy(), return_index=True)
        if len(ids) < 2:
            continue
        x = _matrix(group["vector"].combine_chunks(), dim)[first]
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        worst, last = (group[k].to_numpy()[first][:, None] for k in ("worst", "last"))
        near = 1e-6 * np.abs(worst)  # of equal scores the smaller id is nearer
        a, b = np.nonzero((s > worst + near) | (s >= worst - near) & (ids[None, :] < last))
        for column, value in zip(out, (ids[a], ids[b], s[a, b]), strict=True):
            column.append(value)
        if sum(map(len, out[0])) > 200_000:
            yield _best(*(np.concatenate(c) for c in out), DEGREE)
            out = [[], [], []]
    if out[0]:
        yield _best(*(np.concatenate(c) for c in out), DEGREE)


def _merge(lists: DataFrame) -> DataFrame:
    """The DEGREE best of all lists of a node."""

    def merge(batches):
        for group in batches:
            ids, near, score = [], [], []
            for key, many, values in zip(group.column(0), group.column(1), group.column(2), strict=True):
                n = np.concatenate([np.asarray(x, np.int64) for x in many.as_py()])
                ids.append(np.full(len(n), key.as_py())), near.append(n)
                score.append(np.concatenate([np.asarray(x, np.float32) for x in values.as_py()]))
            if ids:
                yield _best(np.concatenate(ids), np.concatenate(near), np.concatenate(score), DEGREE)

    return lists.groupBy("id").agg(F.collect_list("near").alias("near"), F.collect_list("score").alias("score")).mapInArrow(merge, _GRAPH)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(id, x): vectors of finite components, not all 0; of the rows of one vec_id the least."""
    x = F.col("embedding").cast("array<double>")
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False))) & F.exists(x, lambda v: v != 0)
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("id"), x.alias("x")).groupBy("id").agg(F.min("x").alias("x"))


def packed(rows: DataFrame, dim: int, largest: float) -> DataFrame:
    """rows (id, x) with vector: dim single floats, all vectors divided by one number, so that inner products keep their order."""

    def pack(batches):
        for batch in batches:
            out = np.zeros((batch.num_rows, dim), np.float32)
            for i, v in enumerate(batch.column(1)):
                x = np.asarray(v.as_py())
                out[i, : len(x)] = x / largest
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in out], pa.binary())], ["id", "x", "vector"])

    return rows.mapInArrow(pack, "id long, x array<double>, vector binary")


def build_graph(vectors: DataFrame, dim: int, count: int, seed: int = 1) -> DataFrame:
    """Neighbour lists (id, near, score) of vectors (id, vector).

    Random trees give the first lists: a leaf is a pattern of signs before
    random hyperplanes, of LEAF members on average whatever the input's size;
    larger leaves are dealt at random into blocks, and one tree is random
    blocks alone. Then, in rounds until SETTLED, every node is a pivot: its
    neighbours and DEGREE of those that it is a neighbour of are joined with
    their vectors, meet there, and lists take what is nearer.
    """
    bits = max(0, math.ceil(math.log2(max(1, count) / LEAF)))
    planes = np.random.default_rng(seed).normal(size=(TREES, bits, dim)).astype(np.float32)

    def signs(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            for tree in range(TREES):
                code = (x @ planes[tree].T > 0) @ (1 << np.arange(bits)) if bits and tree else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((code.astype(np.int64) * TREES + tree)), batch.column(0)], ["leaf", "id"])

    if not count:
        return vectors.sparkSession.createDataFrame([], _GRAPH)
    leaves = save(vectors.select("id", "vector").mapInArrow(signs, "leaf long, id long"), "ann-leaves")
    sizes = save(leaves.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1"), "ann-sizes")
    dealt = leaves.join(bounded(sizes), "leaf", "left").select(F.xxhash64("leaf", F.pmod(F.xxhash64("leaf", "id"), F.coalesce("blocks", F.lit(1)))).alias("block"), "id")
    blocks = dealt.join(vectors.select("id", "vector"), "id").select("block", "id", "vector")
    first = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(lambda it: _leaves(it, dim), _GRAPH)
    graph = save(_merge(first), "ann-graph")
    for _ in range(MOST_ROUNDS):
        edges = graph.select(F.col("id").alias("pivot"), F.explode("near").alias("id"))
        back = graph.select("id", F.posexplode("near").alias("rank", "pivot"))
        back = back.withColumn("n", F.row_number().over(Window.partitionBy("pivot").orderBy("rank", "id"))).where(F.col("n") <= DEGREE).select("pivot", "id")
        full = F.size("score") >= DEGREE
        own = graph.select("id", F.when(full, F.element_at("score", -1)).otherwise(F.lit(-3.0e38)).cast("float").alias("worst"), F.when(full, F.element_at("near", -1)).otherwise(F.lit(-1)).alias("last")).join(vectors.select("id", "vector"), "id")
        meet = edges.unionByName(back).join(own, "id").select("pivot", "id", "vector", "worst", "last")
        better = meet.repartition("pivot").sortWithinPartitions("pivot").mapInArrow(lambda it: _local_joins(it, dim), _GRAPH)
        new = save(_merge(graph.unionByName(better)), "ann-graph")
        moved = new.join(graph.select("id", F.array_sort("near").alias("was")), "id").where(F.array_sort("near") != F.col("was")).count()
        discard(graph)
        graph = new
        if moved <= SETTLED * count:
            break
    return graph


def search(vectors: DataFrame, graph: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (id, x) that are nodes of the graph: greedy, from a query's own neighbours.

    In a hop each query expands the WIDTH best nodes of its beam that it has
    not expanded yet; their neighbours are joined with their vectors and
    scored in double precision, and the BEAM best stay.
    """
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    data, asked = vectors.select(F.col("id").alias("node"), F.col("x").alias("y")), queries.select(F.col("id").alias("q"), "x")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "node")

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.where("q <> node").distinct().join(data, "node").join(asked, "q").select("q", "node", dot.alias("score"))

    start = graph.join(queries.select("id"), "id").select(F.col("id").alias("q"), F.explode("near").alias("node"))
    beam = save(scored(start).withColumn("open", F.lit(True)), "ann-beam")
    while True:
        ranked = beam.withColumn("n", F.row_number().over(Window.partitionBy("q", "open").orderBy(F.desc("score"), "node")))
        ranked = save(ranked.withColumn("go", F.col("open") & (F.col("n") <= WIDTH)).select("q", "node", "score", "open", "go"), "ann-hop")
        if not ranked.where("go").limit(1).count():
            break
        reached = ranked.where("go").select("q", F.col("node").alias("id")).join(graph, "id").select("q", F.explode("near").alias("node")).distinct()
        new = scored(reached.join(ranked.select("q", "node"), ["q", "node"], "left_anti")).withColumn("open", F.lit(True))
        grown = ranked.select("q", "node", "score", (F.col("open") & ~F.col("go")).alias("open")).unionByName(new)
        kept = save(grown.withColumn("n", F.row_number().over(best)).where(F.col("n") <= BEAM).drop("n"), "ann-beam")
        discard(beam), discard(ranked)
        beam = kept
    return beam.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", F.col("node").alias("vec_id"), "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest other rows of the rows of vectors (vec_id, embedding) whose vec_id is divisible by every, by inner product.

    Null vectors and vectors that are zero, empty or hold null or non-finite
    components take no part; of rows of one vec_id the least counts. Shorter
    vectors are taken as ending in zeros. No rows: no rows. Other columns are
    ignored. The graph is approximate: a search can miss neighbours.
    """
    rows = save(valid_vectors(vectors), "ann-valid")
    size = rows.agg(F.max(F.size("x")).alias("dim"), F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most")).first()
    dim, count = size["dim"] or 1, size["n"]
    data = save(packed(rows, dim, size["most"] or 1.0), "ann-vectors")
    return search(data, build_graph(data, dim, count), data.where(F.col("id") % every == 0), k)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, the 20 nearest of each twentieth."""
    return nearest(table(spark, sf_dir, "embeddings"))
