"""How filters interact: what each removes in every order, by joins of the ids that fail them."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenledger.llm.common import WORD, bounded, discard, few, save, table

SPACE = r"[\x20\x09-\x0D]+"
#: Copies of the table of repeated texts that a join with many of them is salted over.
SALT = 32
#: Repeated texts up to which their table is broadcast.
REPEATED = 100_000


def text_filters(text: Column) -> dict[str, Column]:
    """Filter letter to whether a text (not null) fails it, but for E."""
    words = F.regexp_count(text, F.lit(WORD))
    distinct = F.size(F.array_distinct(F.filter(F.split(text, SPACE), lambda w: w != "")))
    return {
        "A": words < 200,
        "B": 100 * distinct < 50 * words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failing_ids(docs: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(documents, {filter: ids}) of docs (doc_id, text, lang), all saved; a document is known by doc_id and its text's hash t.

    documents: doc_id, t, part, n (repeated rows of one part are counted).
    The texts are read once; from there on only ids and hashes are moved.
    E fails documents whose text some smaller doc_id has, table-wide.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    checks = text_filters(F.col("text"))
    read = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("t"), F.array(*[F.when(v, F.lit(k)) for k, v in checks.items()]).alias("fails"))
    read = save(read.groupBy("doc_id", "t", "part", "fails").agg(F.count("*").alias("n")), "audit-read")
    out = {k: save(read.where(F.array_contains("fails", k)).select("doc_id", "t").distinct(), f"audit-{k}") for k in checks}

    twice = save(read.where("doc_id IS NOT NULL").groupBy("t").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("t", "least"), "audit-texts")
    ids = read.select("doc_id", "t").where("doc_id IS NOT NULL")
    small = F.broadcast(twice)
    if not few(twice, REPEATED):  # a text that many documents share is dealt out over SALT keys; the files of twice don't tell its rows, so the join is marked
        small = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).hint("merge")
        ids = ids.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    again = ids.join(small, [c for c in small.columns if c != "least"]).where("doc_id > least").select("doc_id", "t").distinct()
    out["E"] = save(again, "audit-E")
    discard(twice)
    return read.drop("fails"), out


def prefix_survivors(documents: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """documents with survives: bit S is set if it passes every filter of the set S (a number with bit i for the i-th filter).

    All prefixes of all orders go through together. A left-semi join with a
    filter's failing ids takes that filter's prefixes away, a left-anti join
    keeps those of the others; the ids are written between filters, so that
    each pair of joins reads them once. Keys are ids with hashes: no hot key.
    """
    names = list(failing)
    rows = documents.withColumn("survives", F.lit((1 << (1 << len(names))) - 1).cast("long"))
    for i, name in enumerate(names):
        without = sum(1 << s for s in range(1 << len(names)) if not s >> i & 1)
        same = lambda ids: rows["doc_id"].eqNullSafe(ids["id_"]) & (rows["t"] == ids["t_"])  # noqa: B023, E731
        ids = bounded(failing[name].select(F.col("doc_id").alias("id_"), F.col("t").alias("t_")), 200_000)
        lost = rows.join(ids, same(ids), "left_semi").withColumn("survives", F.col("survives").bitwiseAND(F.lit(without).cast("long")))
        done = save(rows.join(ids, same(ids), "left_anti").unionByName(lost), "audit-survivors")
        if i:
            discard(rows)
        rows = done
    return rows


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic: whether any label of the doc_id says quality 1, toxic 1."""
    for name, column in (("good", "quality"), ("toxic", "toxic")):
        ids = bounded(labels.where(F.col(column) == 1).select(F.col("doc_id").cast("long").alias("id_")).where("id_ IS NOT NULL").distinct(), 200_000)
        rows = rows.join(ids, rows["doc_id"] == ids["id_"], "left_semi").withColumn(name, F.lit(True)).unionByName(rows.join(ids, rows["doc_id"] == ids["id_"], "left_anti").withColumn(name, F.lit(False)))
    return rows


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: doc_id, text, lang (the part); labels: doc_id, quality, toxic. Each
    of the 120 orders is applied left to right; step s runs the s-th filter.
    Counts are by sets of prefixes (32 for each part), of which the orders are
    then read; no document is counted twice for two orders.

    Null or empty text: one text, no words: fails A alone (and E). Null lang:
    part ''. Null doc_id: never has, nor is, a smaller one; no label. Repeated
    rows: each counts; doc_id and text repeated are no smaller doc_id. Labels
    of one doc_id: any counts. No rows: no rows. Other columns are ignored.
    """
    documents, failing = failing_ids(docs)
    survivors = with_labels(prefix_survivors(documents, failing), labels)
    sums = [F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]]
    cells = save(survivors.groupBy("part", "survives").agg(*sums), "audit-cells")

    names = list(failing)
    number = {k: i for i, k in enumerate(names)}
    steps = [(order, s + 1, sum(1 << number[k] for k in order[:s]), 1 << number[order[s]]) for order in map("".join, permutations(names)) for s in range(len(names))]
    pairs = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(f).alias("f")) for s, f in sorted({(s, f) for *_, s, f in steps})])
    # bit s of a number of prefixes
    lives = lambda s: F.col("survives").bitwiseAND(F.expr(f"shiftleft(1L, cast({s} AS int))")) != 0
    count = lambda c, what="n": F.coalesce(F.sum(F.when(c, F.col(what))), F.lit(0)).cast("long")
    every = (1 << len(names)) - 1
    here = lives("s") & ~lives("s | f")
    per = cells.select("*", F.inline(pairs)).groupBy("part", "s", "f").agg(
        count(lives("s | f")).alias("kept"), count(here).alias("removed"), count(~lives("s") & ~lives("f")).alias("redundant"), count(lives(f"{every} - f") & ~lives("f")).alias("unique_fails"),
        count(here, "good").alias("good_lost"), count(here, "toxic").alias("toxic_lost"),
    )
    # a set of size k comes before f in k! (m - 1 - k)! orders
    times = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(names) - 1 - k)) for k in range(len(names))]), (F.bit_count("s") + 1).cast("int"))
    per = per.withColumn("shapley", F.sum(F.col("removed") * times).over(Window.partitionBy("part", "f")))
    orders = docs.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{o}', {i}, {s}, {f})" for o, i, s, f in steps) + " AS v(filter_order, step, s, f)")
    return per.join(F.broadcast(orders), ["s", "f"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters on all documents, in all orders."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS x, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY x) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT k, part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: CASE f
    WHEN 'A' THEN len(w) < 200 WHEN 'B' THEN 100 * len(list_distinct(w)) < 50 * len(w)
    WHEN 'C' THEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x) WHEN 'D' THEN regexp_matches(x, '[#$%&*|]') ELSE coalesce(w.doc_id > least, false) END) AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
o AS (SELECT '' AS o, 0 AS n UNION ALL SELECT o.o || v.f, n + 1 FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(f) WHERE n < 5 AND NOT contains(o.o, v.f)),
s AS (SELECT o AS filter_order, step, string_split(o[1:step - 1], '') AS before, o[step] AS own FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE n = 5),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
r AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT list_has_any(fails, list_append(before, own)) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN list_contains(fails, own) AND NOT list_has_any(fails, before) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN list_contains(fails, own) AND list_has_any(fails, before) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = [own] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN list_contains(fails, own) AND NOT list_has_any(fails, before) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN list_contains(fails, own) AND NOT list_has_any(fails, before) THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""
