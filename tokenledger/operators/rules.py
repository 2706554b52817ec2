"""Guardrail rules of prompts: one array of findings for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger import settings as S
from tokenledger.functions.text import SPACE, has_output_cap, has_word, whole_workspace
from tokenledger.operators.carry import last_before
from tokenledger.operators.pricing import cheaper_of, has_hint, is_reasoning, output_multiplier, price_of, projected_output, usd, with_learnt
from tokenledger.settings import DEFAULTS, Settings

#: The rules in the order in which their findings stand.
RULES = ("duplicate", "asked_before", "whole_workspace", "many_references", "snowball", "sensitive", "cache_order", "overkill", "no_cap", "reasoning", "unknown_price")


def valid_patterns(spark: SparkSession, patterns: tuple) -> list[str]:
    """The patterns that the JVM can compile; others are left out."""
    out = []
    for p in patterns:
        try:
            spark._jvm.java.util.regex.Pattern.compile(p)
            out.append(p)
        except Exception:  # an invalid pattern never fires
            continue
    return out


def opens_variably(text: Column) -> Column:
    """Whether a prompt begins with a fence or an absolute path, or is long and doesn't begin with a stable lead."""
    t = F.regexp_replace(text, f"^{SPACE}+", "")
    return t.rlike(r"^(```|[A-Za-z]:\\|/)") | ((F.length(t) > 600) & ~t.rlike(f"(?i)^(?:{S.STABLE_LEAD})"))


def rule_columns(spark: SparkSession, s: Settings = DEFAULTS, cheaper: Column | None = None) -> dict[str, Column]:
    """Rules over a prompt alone (prompt, model, context_tokens, ref_count, ref_ids): they hold for tables and streams alike. cheaper: a suggestion that is known."""
    prompt, model = F.coalesce("prompt", F.lit("")), F.col("model")
    context = F.col("context_tokens")
    cheaper = cheaper_of(model, context, projected_output(context, output_multiplier(model, s)), s) if cheaper is None else cheaper
    sensitive = F.lit(False)
    for p in valid_patterns(spark, s.sensitive_patterns):
        sensitive = sensitive | prompt.rlike(p)
    easy = has_word(prompt, S.TRIVIAL) | ~has_word(prompt, S.HARD)
    return {
        "whole_workspace": whole_workspace(F.col("ref_ids")), "many_references": ~whole_workspace(F.col("ref_ids")) & (F.col("ref_count") > s.max_refs), "sensitive": sensitive, "cache_order": opens_variably(prompt),
        "overkill": ~has_hint(model, s.cheap_hints) & easy & (F.length(prompt) < 600) & cheaper.isNotNull(),
        "no_cap": has_word(prompt, S.GENERATIVE) & ~has_output_cap(prompt, S.BRIEF) & (F.length(prompt) < 2000),
        "reasoning": is_reasoning(model, s), "unknown_price": price_of(model, s)["price_key"].isNull(),
    }


def _details(s: Settings) -> dict[str, tuple[str, Column]]:
    cheaper, said = F.col("cheaper_"), lambda c: F.coalesce(c.cast("string"), F.lit(""))
    pct = lambda c: said(F.floor(F.col(c) * 100 + 0.5))
    text = lambda x: F.lit(x)
    return {
        "duplicate": ("Asked already in this session", F.concat(pct("similarity"), text("% like an earlier prompt of this session; its answer may do."))),
        "asked_before": ("Asked in an earlier session", F.concat(pct("past_similarity"), text("% like a prompt in "), said(F.col("past_project")), text("."))),
        "whole_workspace": ("The whole workspace is attached", text("Every turn sends all of it; attach the files that the task needs.")),
        "many_references": ("Many references", F.concat(said(F.col("ref_count")), text(f" references, more than {s.max_refs}; each is sent with every turn."))),
        "snowball": ("The context snowballs", F.concat(text("It grew by "), said(F.col("growth")), text(" tokens, more than "), said(F.col("threshold")), text("."))),
        "sensitive": ("Possibly sensitive data", text("The prompt matches a configured pattern.")),
        "cache_order": ("Order unfit for a prompt cache", text("Text that changes stands before what stays the same.")),
        "overkill": ("A cheaper model may do", F.concat(said(cheaper["model"]), text(" would cost "), F.format_string("%.6f", usd(cheaper["best"])), text(" instead of "), F.format_string("%.6f", usd(cheaper["now"])), text(" dollars."))),
        "no_cap": ("No bound on the answer", text("Ask for a short answer, a list or a number of lines.")),
        "reasoning": ("A reasoning model", text("Hidden output is billed as well.")),
        "unknown_price": ("Price unknown", text("The fallback price is used.")),
    }


def with_growth(prompts: DataFrame, dups: DataFrame, s: Settings = DEFAULTS, carried: DataFrame | None = None) -> DataFrame:
    """prompts (session_id, seq, prompt, context_tokens) with similarity (to an earlier prompt of the session), duplicate, and growth of the context.

    Growth counts from the last turn that ran: one that was skipped as a
    duplicate leaves the context as it was. carried: (session_id, context) the
    last contexts that ran before all of these prompts.
    """
    rows = prompts.join(dups.select("session_id", "seq", "similarity"), ["session_id", "seq"], "left")
    rows = rows.withColumn("duplicate", F.col("similarity").isNotNull() & (F.trim("prompt") != ""))
    ran = F.when(~F.col("duplicate") | F.lit(not s.block_duplicates), F.col("context_tokens"))
    rows = last_before(rows, ["session_id"], "seq", ran, "before_")
    if carried is not None:
        rows = rows.join(carried.select("session_id", F.col("context").alias("carried_")), "session_id", "left").withColumn("before_", F.coalesce("before_", "carried_")).drop("carried_")
    return rows.withColumn("growth", F.col("context_tokens") - F.col("before_")).drop("before_")


def evaluate_rules(prompts: DataFrame, dups: DataFrame, hist: DataFrame, s: Settings = DEFAULTS, threshold: DataFrame | None = None, multipliers: DataFrame | None = None, carried: DataFrame | None = None) -> DataFrame:
    """prompts (session_id, seq, prompt, model, context_tokens, ref_count, ref_ids) with duplicate, growth, projected, findings (array of rule, title, detail).

    dups and hist: as session_duplicates and history_duplicates give them.
    threshold: one row, what growth the context may have (else the setting).
    multipliers: (model, multiplier) learnt from history. carried: as in with_growth.
    """
    rows = prompts if "ref_ids" in prompts.columns else prompts.withColumn("ref_ids", F.array().cast("array<string>"))
    rows = with_growth(rows, dups, s, carried).join(hist.select("session_id", "seq", F.col("similarity").alias("past_similarity"), F.col("project").alias("past_project")), ["session_id", "seq"], "left")
    rows = rows.join(F.broadcast(threshold.select("threshold")), how="cross") if threshold is not None else rows.withColumn("threshold", F.lit(s.snowball_tokens).cast("long"))
    rows, own = with_learnt(rows, multipliers)
    rows = rows.withColumn("projected", projected_output(F.col("context_tokens"), output_multiplier(F.col("model"), s, own))).drop("learnt")
    rows = rows.withColumn("cheaper_", cheaper_of(F.col("model"), F.col("context_tokens"), F.col("projected"), s))
    fires = rule_columns(prompts.sparkSession, s, F.col("cheaper_")) | {
        "duplicate": F.col("duplicate"), "asked_before": ~F.col("duplicate") & F.col("past_similarity").isNotNull() & (F.trim("prompt") != ""), "snowball": F.coalesce(F.col("growth") > F.col("threshold"), F.lit(False)),
    }
    details = _details(s)
    found = F.array(*[F.when(F.coalesce(fires[r], F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(details[r][0]).alias("title"), details[r][1].alias("detail"))) for r in RULES])
    return rows.withColumn("findings", F.filter(found, lambda x: x.isNotNull())).drop("cheaper_")


def rule_counts(evaluated: DataFrame) -> DataFrame:
    """(rule, prompts) of all rules, 0 included."""
    counted = evaluated.select(F.explode("findings.rule").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    every = evaluated.sparkSession.createDataFrame([(r,) for r in RULES], "rule string")
    return every.join(counted, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("prompts"))


def duplicate_savings(evaluated: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row: prompts skipped as duplicates, and the tokens and dollars that they would have cost."""
    p = price_of(F.col("model"), s)
    rows = evaluated.where("duplicate").withColumn("units", F.col("context_tokens") * p["p_in"] + F.col("projected") * p["p_out"])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(F.count("*").alias("skipped"), total("context_tokens").alias("input_tokens_saved"), total("projected").alias("output_tokens_saved"), usd(F.coalesce(F.sum(F.col("units").cast("decimal(38,0)")), F.lit(0))).alias("usd_saved"))
