"""Jobs on the context of conversations: compaction, caps, tools, and searches of a corpus of files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenledger import staging
from tokenledger.functions.text import long_words
from tokenledger.operators.carry import running_before
from tokenledger.settings import DEFAULTS, Settings


def compact_context(messages: DataFrame, s: Settings = DEFAULTS, keep_recent: int = 2, longer_than: int = 500, head: int = 400) -> DataFrame:
    """messages (conv_id, turn, kind, text) with text compacted and chars_saved.

    In a conversation of more than max_context_tokens * 4 characters every tool
    result but the last keep_recent that is longer than longer_than keeps its
    head and a note. Totals and the place of the last results are aggregates, so
    that a conversation with most of the messages is no hot task.
    """
    totals = messages.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"))
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    recent = messages.where("kind = 'tool_result'").select("conv_id", "turn").withColumn("place", last).where(F.col("place") <= keep_recent).groupBy("conv_id").agg(F.min("turn").alias("recent"))
    large = totals.where(F.col("chars") > s.max_context_tokens * 4).join(recent, "conv_id").select("conv_id", "recent")
    cut = F.coalesce((F.col("turn") < F.col("recent")) & (F.col("kind") == "tool_result") & (F.length("text") > longer_than), F.lit(False)) & F.lit(s.enable_compaction)
    rows = messages.join(large, "conv_id", "left").withColumn("cut", cut).drop("recent")
    gone = F.length("text") - head
    note = F.concat(F.left("text", F.lit(head)), F.lit("\n…[compacted: "), F.format_number(gone, 0), F.lit(" characters left out]"))
    return rows.withColumn("chars_saved", F.when(F.col("cut"), gone).otherwise(0).cast("long")).withColumn("text", F.when(F.col("cut"), note).otherwise(F.col("text"))).drop("cut")


def compaction_savings(compacted: DataFrame) -> DataFrame:
    """(conv_id, tokens_saved) of conversations that lost something."""
    return compacted.groupBy("conv_id").agg(F.ceil(F.sum("chars_saved") / 4).cast("long").alias("tokens_saved")).where("tokens_saved > 0")


def cap_tool_results(messages: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """messages with tool results cut at max_tool_result_chars, with a note of what was left out."""
    cap = s.max_tool_result_chars
    note = F.concat(F.left("text", F.lit(cap)), F.lit("\n…[truncated: "), F.format_number(F.length("text") - cap, 0), F.lit(" characters left out]"))
    return messages.withColumn("text", F.when((F.col("kind") == "tool_result") & (F.length("text") > cap), note).otherwise(F.col("text")))


def conversation_context(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, context_tokens): the tokens of all that was said up to each message."""
    rows = running_before(messages.withColumn("turn", F.col("turn").cast("long")), ["conv_id"], "turn", F.length("text").cast("long"), "before")
    return rows.select("conv_id", "turn", F.ceil((F.col("before") + F.length("text")) / 4).cast("long").alias("context_tokens"))


def tier_tools(prompts: DataFrame, catalog: DataFrame, s: Settings = DEFAULTS, local: int = 0) -> DataFrame:
    """(session_id, seq, kept, kept_ids, tokens_saved): the max_tools - local tools of the catalogue that fit each prompt best.

    A tool (ordinal, name, description, input_schema) scores a point for each
    word of the prompt that is part of its name and description; ties go to
    the catalogue's order. An inverted index takes the place of scoring every
    tool for every prompt: a word is part of a text if it is part of one of its
    terms. Prompts with the same hits are ranked once.
    """
    n = max(0, s.max_tools - local)
    said = F.concat_ws("", "name", "description", "input_schema")
    tools = catalog.select("ordinal", F.lower(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))).alias("hay"), F.length(said).alias("chars"))
    terms = tools.select("hay").distinct().select("hay", F.explode(F.array_distinct(F.filter(F.split("hay", "[^a-z0-9]+"), lambda w: F.length(w) > 2))).alias("term"))
    asked = prompts.select("session_id", "seq", F.explode_outer(long_words(F.col("prompt"))).alias("word"))
    # a word that is part of a term begins with one of the term's trigrams
    trigrams = terms.select("term").distinct().select("term", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("term") - 2), lambda i: F.substring(F.col("term"), i, 3)))).alias("trigram"))
    words = asked.where("word IS NOT NULL").select("word").distinct().withColumn("trigram", F.left("word", F.lit(3)))
    index = words.join(trigrams, "trigram").where(F.col("term").contains(F.col("word"))).select(F.col("word").alias("gram"), "term").join(terms, "term").select("hay", "gram").distinct()
    index = staging.save(index, "tool-index")
    hits = asked.join(index.select("gram").distinct(), F.col("word") == F.col("gram"), "left").groupBy("session_id", "seq").agg(F.array_sort(F.collect_list("gram")).alias("hits"))
    hits = staging.save(hits, "tool-hits")
    kinds = hits.where(F.size("hits") > 0).select("hits").distinct()
    scores = kinds.select("hits", F.explode("hits").alias("gram")).join(index, "gram").groupBy("hits", "hay").agg(F.count("*").alias("score"))
    best = Window.partitionBy("hits").orderBy(F.desc("score"), "ordinal")
    front = tools.withColumn("place", F.row_number().over(Window.partitionBy("hay").orderBy("ordinal"))).where(F.col("place") <= n).drop("place")
    scored = scores.join(front, "hay").select("hits", "ordinal", "chars", "score").withColumn("place", F.row_number().over(best)).where(F.col("place") <= n).drop("place")
    ranked = scored.groupBy("hits").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "ordinal", "chars"))).alias("scored"))  # n at most
    # places that are left go to the catalogue's first, of which those that score are n at most
    first = tools.orderBy("ordinal").limit(n).groupBy().agg(F.array_sort(F.collect_list(F.struct(F.lit(0).cast("long").alias("rank"), "ordinal", "chars"))).alias("first"))
    every = tools.agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("every"))
    out = hits.join(ranked, "hits", "left").join(F.broadcast(first.join(every, how="cross")), how="cross")  # one row
    none = F.array().cast(ranked.schema["scored"].dataType)
    own = F.coalesce("scored", none)
    kept = F.slice(F.concat(own, F.filter("first", lambda x: ~F.array_contains(F.transform(own, lambda y: y["ordinal"]), x["ordinal"]))), 1, n) if n else none
    out = out.withColumn("kept_", kept)
    ids, chars = F.array_sort(F.transform("kept_", lambda x: x["ordinal"])), F.aggregate("kept_", F.lit(0).cast("long"), lambda t, x: t + x["chars"])
    return out.select("session_id", "seq", F.size(ids).cast("long").alias("kept"), ids.alias("kept_ids"), F.ceil((F.col("every") - chars) / 4).cast("long").alias("tokens_saved"))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ** crosses folders, * and ? don't, {a,b} are alternatives."""
    out, depth, i = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 2
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def _matching(files: DataFrame, glob: str | None, exclude: tuple[str, ...]) -> DataFrame:
    out = files if glob is None else files.where(F.col("path").rlike(glob_pattern(glob)))
    for x in exclude:
        out = out.where(~F.col("path").rlike(glob_pattern(x)))
    return out


def corpus_find(files: DataFrame, glob: str, exclude: tuple[str, ...] = (), limit: int = 500) -> DataFrame:
    """The first paths, in order, of files (path) that match a glob and none of exclude."""
    return _matching(files, glob, exclude).select("path").orderBy("path").limit(limit)


def corpus_grep(files: DataFrame, query: str, is_regex: bool = False, glob: str | None = None, exclude: tuple[str, ...] = (), limit: int = 200, max_bytes: int = 200_000, clip: int = 200) -> DataFrame:
    """(path, line, text): the first lines, in order, of files (path, content) that hold the query, without regard to case.

    Files of more than max_bytes and those of exclude are passed over; a
    literal query matches as it stands. Texts are cut at clip characters.
    """
    pattern = "(?i)" + (query if is_regex else re.escape(query))
    small = _matching(files, glob, exclude).where(F.octet_length("content") <= max_bytes)
    lines = small.select("path", F.posexplode(F.split("content", "\r?\n")).alias("i", "text")).where(F.col("text").rlike(pattern))
    return lines.select("path", (F.col("i") + 1).cast("long").alias("line"), F.left("text", F.lit(clip)).alias("text")).orderBy("path", "line").limit(limit)
