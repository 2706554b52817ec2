"""Line deduplication: exact and within a few edits, by a segment-partition join (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import bounded, discard, save, table

#: Lines shorter than this are removed as exact repeats only; edits between near lines. Two edits are a tenth of a line of
#: 20 characters; below, near lines are mostly different ones (sf0.01: 296 of the 298 pairs within 2 edits of lines under
#: 20 characters have fewer than 10, such as "Th." and "Wh."; no pair has 20 to 39).
NEAR_CHARS, EDITS = 20, 2
#: Letters whose counts bound the edits between two lines from below (an edit changes one count, or two).
LETTERS = "aeinrsthdloucmgbfpwy"


def _segment_keys(edits: int) -> tuple[list[str], list[str]]:
    """SQL: the keys under which a line's segments are indexed, and those with which it probes for lines as long or up to edits shorter.

    A line of n characters has edits + 1 segments; one of them is intact in
    any line within so many edits, at a start that lies within the bounds
    that the edits before and behind it leave.
    """
    parts = edits + 1
    index, probe = [], []
    for short in range(edits + 1):
        for i in range(parts):
            size = f"(({'n' if not short else f'(n - {short})'} + {i}) div {parts})"
            start = " + ".join(["1", *(f"(({'n' if not short else f'(n - {short})'} + {j}) div {parts})" for j in range(i))])
            lo, hi = max(-i, short - (parts - 1 - i)), min(i, short + (parts - 1 - i))
            for shift in range(lo, hi + 1):
                key = f"xxhash64({i}, n - {short}, substring(line, {start} + {shift}, {size}))"
                probe.append(key)
                if not short and not shift:
                    index.append(key)
    return index, probe


def _within(edits: int) -> str:
    """SQL: edit distance of the character arrays x and y (lengths n and m, at most edits apart), right up to edits.

    Bit-parallel: a column of the band of 2 * edits + 1 diagonals is two words
    of vertical differences, and a character of y moves them by additions and
    logic. The distance is read along the band's lower edge and then along
    the last row.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    equal = " + ".join(f"if(padded[j - 1 + {b}] = y[j - 1], {1 << b}, 0)" for b in range(width))
    start = sum(1 << b for b in range(width) if b >= edits)
    hp, hn = f"((a.vn | ~(d | a.vp)) & {full})", "(d & a.vp)"
    move = f"""named_struct(
      'vp', ({hn} | ~(shiftright(d, 1) | {hp})) & {full}, 'vn', shiftright(d, 1) & {hp},
      'dist', a.dist + CASE WHEN j <= n - {edits} THEN 1 - (shiftright(d, {width - 1}) & 1)
                       ELSE (shiftright({hp}, n - j + {edits}) & 1) - (shiftright({hn}, n - j + {edits}) & 1) END)"""
    step = f"transform(array({equal}), e -> transform(array(((((e & a.vp) + a.vp) ^ a.vp) | e | a.vn) & {full}), d -> {move})[0])[0]"
    return f"""transform(array(concat(array_repeat('', {edits}), x, array_repeat('', {2 * edits + 1}))), padded ->
      aggregate(sequence(1, m), named_struct('vp', {start}, 'vn', 0, 'dist', {edits}), (a, j) -> {step}).dist)[0]"""


def deduped(docs: DataFrame, min_chars: int | None = None, edits: int = EDITS) -> DataFrame:
    """One row per row of docs (doc_id, text): row (its columns as a struct), n_lines, n_removed, n_near, text (what is kept).

    A line (between line feeds, outer spaces aside) that is not empty is removed
    if the same line, or, from NEAR_CHARS characters on, one of so many within
    edits edits, occurs earlier: in a document of smaller doc_id, or before it
    in its own. A given min_chars is the least length for both. Equal
    lines are one node from the scan on (a combining aggregation), so that a
    line that a third of all documents hold is one row. Near lines are found
    through equal segments; of lines that share one, counts of some letters, in
    the join's condition, turn most others away, and the bit-parallel distance decides.

    Null text: no lines, empty result. Empty text: one empty line, kept.
    Null doc_id sorts first. Repeated rows are one document returned twice.
    No rows: no rows. Other columns are ignored.
    """
    least, near_chars = (1, NEAR_CHARS) if min_chars is None else (max(1, min_chars), min_chars)
    key = [F.col("doc_id"), F.xxhash64("text").alias("t")]
    lines = docs.where("text IS NOT NULL").select(*key, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("line", F.trim("line")).withColumn("n", F.length("line")).where(F.col("n") >= least)
    lines = lines.withColumn("h", F.xxhash64(F.lit(1), "line"))
    index, probe = _segment_keys(edits)
    mine = lines.select("doc_id", "t", "pos", "h", F.expr(f"CASE WHEN n >= {near_chars} THEN array({', '.join(probe)}) END").alias("probe"))
    nodes = mine.groupBy("h").agg(F.min(F.struct("doc_id", "t", "pos")).alias("first"), F.count("*").alias("times"), F.first(F.struct("probe")).alias("line"))
    nodes = save(nodes.select("h", "first", "times", "line.*"), "lines-nodes")
    places = [probe.index(k) for k in index]
    asked = nodes.select(F.col("h").alias("a"), F.explode("probe").alias("key"))
    held = nodes.where("probe IS NOT NULL").select(F.col("h").alias("b"), F.explode(F.array(*[F.element_at("probe", p + 1) for p in places])).alias("key"))
    # most lines meet none: letters are counted, and texts fetched, for those alone that do (a semi-join stops at the first other line)
    asked = save(asked.join(held, (asked["key"] == held["key"]) & (F.col("a") != F.col("b")), "left_semi"), "lines-asked")
    held = save(held.join(bounded(asked.select("key").distinct(), 200_000), "key"), "lines-held")
    wanted = save(nodes.join(asked.select("a").unionByName(held.select(F.col("b").alias("a"))).distinct().toDF("h"), "h").select("h", "first.*"), "lines-wanted")
    small = bounded(wanted.select(F.col("doc_id").alias("d"), F.col("t").alias("u"), F.col("pos").alias("p"), "h"), 200_000)
    text = docs.where("text IS NOT NULL").select(*key, "text")
    chars = text.join(small, text["doc_id"].eqNullSafe(small["d"]) & (text["t"] == small["u"])).select("h", F.trim(F.element_at(F.split("text", "\n", -1), F.col("p") + 1)).alias("line")).dropDuplicates(["h"])
    # counts modulo 8, three bits each: their circular difference is never above the true one
    counts = [((F.length("line") - F.length(F.replace(F.col("line"), F.lit(x)))) % 8).cast("long") for x in LETTERS]
    packed = sum((F.shiftleft(c, 3 * i) for i, c in enumerate(counts)), F.lit(0).cast("long"))
    chars = save(chars.select("h", packed.alias("counts"), F.split("line", "").alias("chars")), "lines-chars")
    apart = " + ".join(f"(4 - abs(4 - abs((shiftright(x, {3 * i}) & 7) - (shiftright(y, {3 * i}) & 7))))" for i in range(len(LETTERS)))
    own = lambda df, h, c: df.join(chars.select(F.col("h").alias(h), F.col("counts").alias(c)), h)
    pairs = own(asked, "a", "x").join(own(held, "b", "y").withColumnRenamed("key", "same"), (F.col("key") == F.col("same")) & (F.col("a") != F.col("b")) & F.expr(f"{apart} <= {2 * edits}"))
    pairs = save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "lines-pairs")
    chars = chars.select("h", "chars")
    # the distances cost far more than the pairs' bytes tell: deal them out by number
    joined = pairs.join(chars.toDF("a", "x"), "a").join(chars.toDF("b", "y"), "b").withColumn("n", F.size("x")).withColumn("m", F.size("y")).repartition(max(1, min(20_000, pairs.count() // 1_000)))
    # (a column, not a condition: the optimiser moves conditions below the dealing)
    made = save(joined.select("a", "b", F.expr(f"CASE WHEN abs(n - m) <= {edits} THEN {_within(edits)} <= {edits} ELSE false END").alias("near")), "lines-links")
    links = made.where("near").select("a", "b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = nodes.join(both.select(F.col("a").alias("h")).distinct(), "h", "left_semi").select("h", "first")
    near = both.join(first.toDF("a", "fa"), "a").join(first.toDF("b", "fb"), "b").where("fb < fa").select(F.col("a").alias("h")).distinct().withColumn("near", F.lit(True))
    known = save(nodes.select("h", "first", "times").join(near, "h", "left").where("times > 1 OR near").select("h", "first", F.coalesce("near", F.lit(False)).alias("near")), "lines-known")
    gone = lines.select("doc_id", "t", "pos", "h").join(bounded(known, 200_000), "h").where(F.col("near") | (F.struct("doc_id", "t", "pos") != F.col("first")))
    gone = gone.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("gone"), F.collect_set(F.when(F.col("near"), F.col("pos"))).alias("near"))
    gone = save(gone.select(F.col("doc_id").alias("d"), F.col("t").alias("u"), "gone", "near"), "lines-gone")
    for done in (nodes, asked, held, pairs, wanted, chars, made, known):
        discard(done)
    rows = docs.select(*key, F.col("text"), F.struct(*docs.columns).alias("row"))
    small = bounded(gone, 200_000)
    rows = rows.join(small, rows["doc_id"].eqNullSafe(small["d"]) & (rows["t"] == small["u"]), "left").withColumn("lines", F.coalesce(F.split("text", "\n", -1), F.array().cast("array<string>")))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\\n')"))
    none = F.lit(0).cast("long")
    return rows.select("row", F.size("lines").cast("long").alias("n_lines"), F.greatest(F.size("gone").cast("long"), none).alias("n_removed"), F.greatest(F.size("near").cast("long"), none).alias("n_near"), kept.alias("text"))


def dedup_lines(docs: DataFrame, min_chars: int | None = None, edits: int = EDITS, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near, kept_sha256, text (what is kept) of deduped(), and the columns keep, which have none of these names."""
    out = deduped(docs, min_chars, edits)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "n_near", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "text", *[F.col("row").getField(c).alias(c) for c in keep or []])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents, within 2 edits from 20 characters on."""
    return dedup_lines(table(spark, sf_dir, "documents")).drop("text")
