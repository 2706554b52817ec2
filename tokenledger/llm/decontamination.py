"""Benchmark decontamination by winnowed fingerprints (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import bounded, discard, save, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words: runs of ASCII letters and digits and of anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a fingerprint, and of a window that a shared span must have.
GRAM, WINDOW = 4, 10


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _let(value: str, name: str, body: str) -> str:
    """SQL: body, an array, with name standing for value, which is computed once."""
    return f"flatten(transform(array({value}), {name} -> {body}))"


def _combine(items: str, size: int, how: str) -> str:
    """SQL: `how(a, b)` folded over all runs of size elements of an array, by doubling."""
    if size == 1:
        return items
    half = 1 << ((size - 1).bit_length() - 1)
    return _let(_combine(items, half, how), "v", f"zip_with(slice(v, 1, greatest(0, size(v) - {size - half})), slice(v, {size - half + 1}, size(v)), (a, b) -> {how}(a, b))")


def _grams(size: int) -> str:
    """SQL: hashes of all runs of size words of `words`; none if there are fewer."""
    return _combine("transform(words, w -> xxhash64(w))", size, "xxhash64")


def _by_length(lengths: list[int], body: Callable[[int], str], name: str = "n") -> str:
    """SQL: body(length) for the length that the column name has."""
    return "CASE " + name + " " + " ".join(f"WHEN {n} THEN {body(n)}" for n in lengths) + " END"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, items.

    A document word is hit if it lies in an occurrence of a window of the
    benchmark (item_id, text): window words in a row of an item, or the whole
    of a shorter one. Of each window's hashes of gram words the smallest is
    kept on the document's side and looked up among all of the benchmark's, so
    a shared span of a window's length always shares a fingerprint; hits are
    extended to whole windows and compared as text. One scan looks up the
    fingerprints for all lengths of windows, one more extends hits, and the
    words are counted beside the last join. Only hits leave the first scan:
    the benchmark's fingerprints are broadcast where they are few (counted),
    and else joined by shuffling fingerprints alone.

    Null or empty text: no words, not contaminated. Items without words, an
    empty benchmark: no hits. Items of null item_id hit but are not counted.
    Repeated rows: each is returned. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = save(benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(window))), "bench-items")
    lengths = [r["n"] for r in items.select("n").distinct().orderBy("n").collect()]  # at most window values
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    # Unicode lower case keeps the words apart as they are and unites more: enough for fingerprints, and faster
    loose = F.coalesce(F.array_remove(F.split(F.lower("text"), NOT_WORD), ""), F.array().cast("array<string>")).alias("words")
    counted = keyed.select("doc_id", "text_hash", F.size(loose).cast("long").alias("n_words"))
    if lengths:
        k = {n: min(gram, n) for n in lengths}
        prints = F.expr(_by_length(lengths, lambda n: _grams(k[n])))
        known = save(items.select("n", F.transform("words", F.lower).alias("words")).select("n", F.explode(prints).alias("print")).distinct(), "bench-prints")
        windows = save(items.select("item_id", F.explode(F.expr("transform(sequence(0, size(words) - n), i -> array_join(slice(words, i + 1, n), ' '))")).alias("run")).distinct(), "bench-windows")
        kept = ", ".join(f"transform(array_distinct({_let('words', 'words', _combine(_grams(k[n]), n - k[n] + 1, 'least'))}), p -> struct({n} AS n, p AS print))" for n in lengths)
        rows = keyed.select("doc_id", "text_hash", loose).select("doc_id", "text_hash", F.expr(f"inline(concat({kept}))"))
        hits = save(rows.join(bounded(known, 1_000_000), ["n", "print"], "left_semi"), "bench-hits")
        mine = hits.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "n").agg(F.collect_set("print").alias("prints"))
        mine = F.broadcast(mine) if hits.limit(1_000_001).count() <= 1_000_000 else mine  # of 8 bytes each, and no more arrays than prints
        rows = keyed.join(mine, keyed["doc_id"].eqNullSafe(mine["d"]) & (keyed["text_hash"] == mine["h"])).dropDuplicates(["doc_id", "text_hash", "n"])
        rows = rows.select("doc_id", "text_hash", "n", "prints", words_of(F.col("text")).alias("words")).where("size(words) >= n")

        def starts(n: int) -> str:
            own = _grams(k[n]).replace("xxhash64(w)", "xxhash64(lower(w))")
            return _let(own, "g", f"array_distinct(flatten(transform(filter(sequence(0, size(g) - 1), i -> array_contains(prints, g[i])), i -> sequence(greatest(0, i - {n - k[n]}), i))))")

        rows = rows.select("doc_id", "text_hash", "n", "words", F.explode(F.expr(_by_length(lengths, starts))).alias("start")).where("start <= size(words) - n")
        rows = rows.select("doc_id", "text_hash", "start", F.col("n").alias("length"), F.expr("array_join(slice(words, start + 1, n), ' ')").alias("run"))
        # a run has as many words as its item's windows, so windows of other lengths never equal it
        size = windows.agg(F.sum(F.octet_length("run") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 32)).first()[0] or 0
        found = rows.join(F.broadcast(windows) if size <= 32_000_000 else windows, "run").select("doc_id", "text_hash", "start", "length", "item_id")
    else:
        found = counted.where("false").select("doc_id", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("item_id"))
    per = found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    per = per.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.length - 1)))))").cast("long").alias("hit"), "items")
    if lengths:
        per = save(per, "bench-found")
        ids = per.agg(F.sum(F.size("items") + 1)).first()[0] or 0
        per = F.broadcast(per) if ids <= 500_000 else per
        discard(hits), discard(known), discard(windows)
    discard(items)
    out = counted.join(per, counted["doc_id"].eqNullSafe(per["d"]) & (counted["text_hash"] == per["h"]), "left")
    hit, ids = F.coalesce("hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "text_hash", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), ids.alias("items"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark, windows of 10 words."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "text_hash")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS run FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS run
       FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
m AS (SELECT k, i, n, item_id FROM dw JOIN bw USING (n, run)),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT k, i, n FROM m)) GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN it USING (k)
"""
