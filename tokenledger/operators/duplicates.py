"""Near-equal prompts: within a session, and against the history of all prompts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenledger import staging
from tokenledger.functions.text import history_norm, history_words, jaccard, prompt_words
from tokenledger.settings import DEFAULTS, Settings


def longest_first(words: Column) -> Column:
    """Words in an order that never changes: the longest first, which are seldom the commonest."""
    return F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])


def word_counts(sets: DataFrame) -> DataFrame:
    """(word, df): in how many sets a word is."""
    return sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def rarest_first(sets: DataFrame, often: DataFrame) -> DataFrame:
    """sets (id, words, ...), id unique, with their words in the order of often (word, df), unknown words first."""
    ranked = sets.select("id", F.explode("words").alias("word")).join(often, "word", "left")
    ranked = ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("ranked"))  # the words of one text
    return sets.drop("words").join(ranked, "id").withColumn("words", F.col("ranked.word")).drop("ranked")


def _band(n: Column, threshold: float) -> Column:
    """Sets of sizes within the threshold of each other are in the same band or in neighbouring ones."""
    return F.floor(F.log(n) / math.log(1 / threshold) + 1e-9).cast("int")


def _parities(words: Column) -> list[Column]:
    """128 bits in two longs: whether the number of words that hash to a place is odd. As many of them differ as words are in one of two sets only, or fewer."""
    place = lambda w: F.xxhash64(w).bitwiseAND(F.lit(127))
    bit = lambda w, half: F.when(F.shiftright(place(w), 6) == half, F.call_function("shiftleft", F.lit(1).cast("long"), place(w).bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))
    return [F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s.bitwiseXOR(bit(w, half))) for half in (0, 1)]  # noqa: B023


def _prefix(sets: DataFrame, key: list[str], threshold: float, bands: tuple[int, ...], names: tuple[str, str, str]) -> DataFrame:
    """(key, word, band, id, n, place, parities) of the words that a similar set must share one of, for each of the bands around the set's own."""
    n, bits = F.size("words"), [f"bits{i}_{names[0]}" for i in range(2)]
    sets = sets.select(*key, "id", "words", *[b.alias(c) for c, b in zip(bits, _parities(F.col("words")), strict=True)])  # once a set, not once a word
    rows = sets.select(*key, F.col("id").alias(names[0]), n.alias(names[1]), *bits, _band(n, threshold).alias("own_"), F.posexplode(F.slice("words", F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))).alias(names[2], "word"))
    rows = rows.withColumn("band", F.explode(F.array(*[F.col("own_") + b for b in bands])) if bands != (0,) else F.col("own_"))
    return rows.drop("own_")


def similar_sets(sets: DataFrame, key: list[str], threshold: float, old: DataFrame | None = None) -> DataFrame:
    """(key, a, b, similarity) that reach the threshold, a <> b: pairs within sets (key, id, words) both ways round, and of sets with old ones.

    Both are saved tables; words stand in one and the same order in all of
    them. Two such sets share a word among the first n - ceil(threshold n) + 1
    of each (prefix filter), their sizes are in neighbouring bands, by which a
    common word is split (size filter), from the first word that they share on
    enough is left of both to reach the overlap that the threshold asks for
    (positional filter), and no more of their parities differ than words may
    (parity filter): sets that merely share a word leave no pair to shuffle.
    What passes is compared word by word.
    """
    index, a, b = ("b", "n_b", "at_b"), F.col("n_a"), F.col("n_b")
    left = F.least(a - F.col("at_a"), b - F.col("at_b"))
    shared = F.ceil((a + b) * (threshold / (1 + threshold)) - 1e-9)
    apart = sum(F.bit_count(F.col(f"bits{i}_a").bitwiseXOR(F.col(f"bits{i}_b"))) for i in range(2))
    fits = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9) & (left >= shared) & (apart <= a + b - 2 * shared)
    on = [*key, "word", "band"]

    def verified(pairs: DataFrame, others: DataFrame) -> DataFrame:
        own = lambda df, i, w: df.select(*key, F.col("id").alias(i), F.col("words").alias(w))
        rows = pairs.select(*key, "a", "b").distinct().join(own(sets, "a", "x"), [*key, "a"]).join(own(others, "b", "y"), [*key, "b"])
        return rows.withColumn("similarity", jaccard(F.col("x"), F.col("y"))).where(F.col("similarity") >= threshold).select(*key, "a", "b", "similarity")

    larger = (a > b) | ((a == b) & (F.col("a") > F.col("b")))
    pairs = _prefix(sets, key, threshold, (0, -1), ("a", "n_a", "at_a")).join(_prefix(sets, key, threshold, (0,), index), on).where(larger & fits)
    found = verified(pairs, sets)
    found = found.withColumn("way_", F.explode(F.array(F.lit(0), F.lit(1)))).select(*key, F.when(F.col("way_") == 0, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("way_") == 0, F.col("b")).otherwise(F.col("a")).alias("b"), "similarity")
    if old is None:
        return found
    again = _prefix(sets, key, threshold, (0, -1, 1), ("a", "n_a", "at_a")).join(_prefix(old, key, threshold, (0,), index), on).where((F.col("a") != F.col("b")) & fits)
    return found.unionByName(verified(again, old))


def prompt_sets(prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(said, sets) of prompts (session_id, seq, prompt): the word set id of each, and the sets of each session with the place of their first prompt."""
    said = prompts.select("session_id", "seq", prompt_words(F.col("prompt")).alias("words")).where(F.size("words") > 0).withColumn("id", F.xxhash64(F.array_join("words", " ")))
    sets = said.groupBy("session_id", "id").agg(F.min("seq").alias("first"), F.first("words").alias("words"))
    return said.select("session_id", "seq", "id"), sets.withColumn("words", longest_first(F.col("words")))


def session_duplicates(prompts: DataFrame, s: Settings = DEFAULTS, earlier: DataFrame | None = None) -> DataFrame:
    """(session_id, seq, similarity) of prompts (session_id, seq, prompt) that reach dup_threshold with an earlier one of their session.

    Equal sets of words are one set with the place of its first prompt, so a
    session that repeats itself is not paired with itself. earlier: the sets
    (session_id, id, first, words; saved) of prompts before all of these.
    """
    said, sets = prompt_sets(prompts)
    sets = staging.save(sets, "prompt-sets")
    firsts = sets if earlier is None else sets.unionByName(earlier.select(*sets.columns))
    firsts = firsts.groupBy("session_id", "id").agg(F.min("first").alias("first"))
    again = said.join(firsts, ["session_id", "id"]).where("seq > first").select("session_id", "seq", F.lit(1.0).alias("similarity"))
    near = similar_sets(sets, ["session_id"], s.dup_threshold, earlier).join(firsts.withColumnRenamed("id", "b"), ["session_id", "b"])
    near = said.withColumnRenamed("id", "a").join(near, ["session_id", "a"]).where("first < seq").select("session_id", "seq", "similarity")
    return again.unionByName(near).groupBy("session_id", "seq").agg(F.max("similarity").alias("similarity"))


#: Sets of a session that one tile pairs with as many others.
TILE = 256


def nearest_earlier(prompts: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(session_id, seq, similarity): how like each prompt is to the most similar earlier one of its session, whether or not that reaches a threshold; prompts that are like none are left out.

    The sets of a session are dealt over tiles: one of many sets is compared by
    many tasks, each holding TILE sets of either side. Of the sets that one set
    is compared with, those stay that are more similar than all that came before.
    """
    said, sets = prompt_sets(prompts)
    sets = staging.save(sets, "prompt-sets")
    every = sets if earlier is None else sets.unionByName(earlier.select(*sets.columns))
    every = staging.save(every.groupBy("session_id", "id").agg(F.min("first").alias("first"), F.first("words").alias("words")), "all-sets")
    tiles = every.groupBy("session_id").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles_"))
    own = lambda df, c: df.join(tiles.hint("merge"), "session_id").withColumn(c, F.pmod(F.xxhash64("id"), F.col("tiles_")).cast("int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col("tiles_") - 1)).alias(c)
    left = own(sets, "x_").select("session_id", "x_", upto("y_"), F.col("id").alias("a"), F.col("words").alias("x"))
    right = own(every, "y_").select("session_id", upto("x_"), "y_", "id", "first", F.col("words").alias("y"))
    pairs = left.join(right.hint("merge"), ["session_id", "x_", "y_"]).select("session_id", "a", "first", jaccard(F.col("x"), F.col("y")).alias("similarity")).where("similarity > 0")
    steps = pairs.groupBy("session_id", "a", "first").agg(F.max("similarity").alias("similarity"))
    before = Window.partitionBy("session_id", "a").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before_", F.max("similarity").over(before)).where("before_ IS NULL OR similarity > before_").drop("before_")
    near = said.withColumnRenamed("id", "a").join(steps.hint("merge"), ["session_id", "a"]).where("first < seq")
    return near.groupBy("session_id", "seq").agg(F.max("similarity").alias("similarity"))


def build_prompt_index(prompts: DataFrame, n: int | None = 4_000) -> DataFrame:
    """(norm, words, first, latest, project) of prompts (prompt, asked_at, project) of four words and more, one row a norm, the n latest."""
    said = prompts.select(history_norm(F.col("prompt")).alias("norm"), "asked_at", "project")
    # words are taken from the grouped norms: they are as long as these, and would be shuffled with them
    index = said.groupBy("norm").agg(F.min("asked_at").alias("first"), F.max("asked_at").alias("latest"), F.max_by("project", F.struct("asked_at", "project")).alias("project"))
    index = index.select("norm", history_words(F.col("norm")).alias("words"), "first", "latest", "project").where(F.size("words") >= 4)
    return index if n is None else index.orderBy(F.desc("latest"), "norm").limit(n)


#: Bands of a MinHash signature, and hashes of a band.
BANDS, BAND = 24, 4


def _lsh_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """As similar_sets without a key, found by MinHash: some pairs near the threshold can be missed.

    Two sets meet if all hashes of a band agree: of pairs at a similarity of
    0.7 one in 700 is missed, of pairs at 0.2 one in 26 is compared. By single
    hashes nine in ten of the latter would be, and so most pairs of all.
    """
    least = lambda b, i: F.array_min(F.transform("words", lambda w: F.xxhash64(w, b, F.lit(i))))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[least(b, i) for i in range(BAND)]))
    rows = staging.save(sets.select("id", F.size("words").alias("n"), F.explode(bands).alias("band")), "bands")
    x, y = (rows.select("band", F.col("id").alias(i), F.col("n").alias(f"n_{i}")) for i in ("a", "b"))
    fits = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9
    met = x.join(y.hint("merge"), "band").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    own = lambda i, w: sets.select(F.col("id").alias(i), F.col("words").alias(w))
    found = met.join(own("a", "x"), "a").join(own("b", "y"), "b").withColumn("similarity", jaccard(F.col("x"), F.col("y"))).where(F.col("similarity") >= threshold)
    return found.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "similarity").select("p.a", "p.b", "similarity")


def history_duplicates(prompts: DataFrame, index: DataFrame, s: Settings = DEFAULTS, method: str = "exact", indexed: bool = False) -> DataFrame:
    """(session_id, seq, norm, similarity, latest, project): the most similar entry of the index that was first asked before the prompt, the latest of equals.

    prompts: session_id, seq, prompt, asked_at. Norms are compared once,
    whatever the number of prompts that have them, with their words ranked from
    the rarest on. method: exact, or lsh. With indexed, the index has id (a
    norm's hash) and ranked words, and holds the prompts' own norms: then only
    these are compared with it.
    """
    t = s.history_threshold
    said = staging.save(prompts.select("session_id", "seq", "asked_at", history_norm(F.col("prompt")).alias("norm")).withColumn("id", F.xxhash64("norm")), "asked")
    if indexed:
        entries = index
        asked = staging.save(index.select("id", "words").join(said.select("id").distinct(), "id", "left_semi"), "asked-sets")
        near = similar_sets(asked, [], t, index.select("id", "words"))
    else:
        own = said.groupBy("id").agg(F.first("norm").alias("norm")).withColumn("words", history_words(F.col("norm"))).where(F.size("words") >= 4).select("id", "words")
        entries = staging.save(index.withColumn("id", F.xxhash64("norm")), "entries")
        sets = own.unionByName(entries.select("id", "words")).dropDuplicates(["id"])
        sets = staging.save(rarest_first(sets, word_counts(sets)) if method == "exact" else sets, "norm-sets")
        near = similar_sets(sets, [], t) if method == "exact" else _lsh_pairs(sets, t)
    near = near.select("a", "b", "similarity").distinct()
    itself = said.join(entries.select("id", "norm", "first", "latest", "project"), ["id", "norm"]).withColumn("similarity", F.lit(1.0))
    other = said.select("session_id", "seq", "asked_at", F.col("id").alias("a")).join(near, "a").join(entries.select(F.col("id").alias("b"), "norm", "first", "latest", "project"), "b")
    found = itself.select("session_id", "seq", "asked_at", "norm", "similarity", "first", "latest", "project").unionByName(other.select("session_id", "seq", "asked_at", "norm", "similarity", "first", "latest", "project")).where("first < asked_at")
    best = found.groupBy("session_id", "seq").agg(F.max_by(F.struct("norm", "similarity", "latest", "project"), F.struct("similarity", "latest", "norm")).alias("m"))
    return best.select("session_id", "seq", "m.*")


def first_prompt_anchor(prompts: DataFrame) -> DataFrame:
    """(session_id, anchor): a stable name of a conversation, the hash of the first 80 characters of its first prompt."""
    first = prompts.groupBy("session_id").agg(F.min_by("prompt", "seq").alias("prompt"))
    anchor: Column = F.sha2(F.left("prompt", F.lit(80)).cast("binary"), 256)
    return first.select("session_id", anchor.alias("anchor"))
