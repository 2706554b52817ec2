"""The ledger's queries: operators over the canonical tables of a folder, with the settings of production or those that a fixture needs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger import adapters as T
from tokenledger import staging
from tokenledger.functions import text as X
from tokenledger.operators import budget, calibration, context, dashboard, duplicates, pricing, roi, rules, staged, turns, usage
from tokenledger.settings import DEFAULTS, Settings

#: The tables hold nothing sensitive and no long contexts, so two rules are given something to find.
COACH = replace(DEFAULTS, sensitive_patterns=(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "(unclosed"), snowball_tokens=300)
COMPACT = replace(DEFAULTS, max_context_tokens=200)
CAPPED = replace(DEFAULTS, max_tool_result_chars=800)
ASSUMED = replace(DEFAULTS, assumed_cache_fraction=0.25)
BLOCKING = replace(DEFAULTS, hard_block=True, session_budget=20_000, daily_budget=6_000)
WANTED = {"models": ("claude-opus-4.8", "gpt-4o-mini", "gemini-3-flash"), "projects": ("p1", "p2", "p3", "p4", "p5")}
#: Panels that a chat client puts around a reply: up to their divider, lines that it quotes, lone dividers.
PANELS = ((r"(?s)> panel.*?\n---\n", ""), (r"(?m)^> .*$", ""), (r"\n---\s*\n", "\n"))

Query = Callable[[SparkSession, str, Settings], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(name: str, settings: Settings = DEFAULTS):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir, s=settings: f(spark, sf_dir, s)
        return f

    return add


def text_days(df: DataFrame) -> DataFrame:
    """Days as ISO text, so that every reader sees the same value."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def run(name: str, spark: SparkSession, sf_dir: str, settings: Settings | None = None) -> DataFrame:
    return QUERIES[name](spark, sf_dir) if settings is None else QUERIES[name](spark, sf_dir, settings)


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.turns(spark, sf_dir).select("model").distinct()


# --- prices ------------------------------------------------------------------
@_query("price_book")
def price_book(spark, d, s):
    used = T.turns(spark, d).groupBy(pricing.price_of(F.col("model"), s)["price_key"].alias("price_key")).agg(F.count("*").alias("n"))
    per_m = lambda c: pricing.usd(F.col(c) * 1_000_000)
    return pricing.build_price_book(spark, s).join(used, "price_key", "left").select("ordinal", "price_key", per_m("p_in").alias("input_per_m"), per_m("p_out").alias("output_per_m"), F.coalesce("n", F.lit(0)).alias("turns"))


@_query("model_prices")
def model_prices(spark, d, s):
    named = _models(spark, d).unionByName(T.prompts(spark, d).select("model")).unionByName(T.request_models(spark, d).select(F.concat(F.lit("Copilot/"), F.upper("model")).alias("model")))
    return pricing.model_prices(named, pricing.build_price_book(spark, s), s)


@_query("turn_cost")
def turn_cost(spark, d, s):
    return pricing.list_cost(T.turns(spark, d), s).select("seq", "model", "cost_usd")


@_query("cost_assumed_cache", ASSUMED)
def cost_assumed_cache(spark, d, s):
    return pricing.in_dollars(pricing.price_turns(T.turns(spark, d).withColumn("cache_read_tokens", F.lit(None).cast("long")), s).select("seq", "input_units", "output_units", "cost_units"))


@_query("cost_real_cache")
def cost_real_cache(spark, d, s):
    return pricing.in_dollars(T.priced(spark, d, s).select("seq", "model", F.coalesce("cached_tokens", F.lit(0)).alias("cached_tokens"), "input_units", "output_units", "cost_units"))


@_query("credit_multiplier")
def credit_multiplier(spark, d, s):
    return _models(spark, d).withColumn("c", pricing.credits_of(F.col("model"), s)).select("model", "c.credit_key", "c.multiplier", F.col("c.credit_key").isNotNull().alias("matched"))


@_query("reasoning_flag")
def reasoning_flag(spark, d, s):
    return T.turns(spark, d).select("seq", "model", pricing.is_reasoning(F.col("model"), s).alias("reasoning"), pricing.output_multiplier(F.col("model"), s).alias("multiplier"))


@_query("cheaper_model")
def cheaper_model(spark, d, s):
    rows = T.turns(spark, d).withColumn("c", pricing.cheaper_of(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), s))
    return rows.select("seq", "model", F.col("c.model").alias("suggestion"), pricing.usd(F.col("c.now")).alias("current_usd"), pricing.usd(F.col("c.best")).alias("suggested_usd"))


@_query("cheapest_family")
def cheapest_family(spark, d, s):
    key, a, b = pricing.cheapest_family(s)
    p = pricing.price_of(F.col("model"), s)
    return _models(spark, d).select("model", F.lit(key).alias("family"), ((p["p_in"] + p["p_out"]) / F.lit(float(a + b))).alias("times"))


@_query("projected_output")
def projected_output(spark, d, s):
    return T.turns(spark, d).select("seq", "model", pricing.projected_output(F.col("input_tokens"), pricing.output_multiplier(F.col("model"), s)).alias("projected"))


@_query("receipt_delta")
def receipt_delta(spark, d, s):
    return pricing.turn_receipts(T.requests(spark, d), s).select("seq", "projected_usd", "delta_pct")


@_query("turn_receipt")
def turn_receipt(spark, d, s):
    log = T.usage_log(spark, d, s, indexed=False)
    learnt = calibration.calibrated_multiplier(_models(spark, d), calibration.calibrate_models(log), calibration.baseline_ratio(log), s)
    return pricing.turn_receipts(T.requests(spark, d), s, learnt).select("seq", "model", "input_total", "billed_output", F.col("cost_usd").alias("cost"), "credits")


# --- scalar functions ----------------------------------------------------------
@_query("normalize_model")
def normalize_model(spark, d, s):
    return T.table(spark, d, "part").select("p_partkey", X.normalize_model(F.concat("p_type", F.lit("/"), "p_name", F.lit("/ "), "p_brand", F.lit(" "))).alias("model"))


@_query("project_name")
def project_name(spark, d, s):
    uri = r"CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'file:///w/My%20App+x/' WHEN 2 THEN concat('file:///w/', c_name) WHEN 3 THEN '///' WHEN 4 THEN concat('c:', chr(92), 'ws', chr(92), c_mktsegment, chr(92)) ELSE concat('/w/100%/', c_mktsegment) END AS uri"
    return T.table(spark, d, "customer").selectExpr("c_custkey", uri).select("c_custkey", X.project_from_uri(F.col("uri")).alias("project"), X.norm_uri(F.col("uri")).alias("dir"))


@_query("token_estimate")
def token_estimate(spark, d, s):
    return T.table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@_query("finish_reason")
def finish_reason(spark, d, s):
    return T.requests(spark, d).select("seq", X.finish_reason(F.col("hit_cap"), F.col("tool_calls"), F.col("duplicate")).alias("finish_reason"))


@_query("format_usd")
def format_usd(spark, d, s):
    cost = pricing.usd(F.col("cost_units")) * F.pow(F.lit(10.0), (F.col("seq") % 7).cast("double"))
    tokens = F.col("input_tokens") * F.element_at(F.array(F.lit(1), F.lit(10), F.lit(1000)), (F.col("seq") % 3 + 1).cast("int"))
    return T.priced(spark, d, s).select("seq", *[X.format_usd(cost, k).alias(k) for k in ("price", "short", "compact", "axis")], *[X.format_tokens(tokens, k).alias(f"tokens_{k}") for k in ("millions", "panel")])


# --- turns ---------------------------------------------------------------------
@_query("turns_union")
def turns_union(spark, d, s):
    t = T.turns(spark, d)
    cols = ["source", "project", "session_id", "seq", "response_id", "model", "ts", "input_tokens", "output_tokens"]
    return turns.union_turns(t.where("source = 'legacy'").select(cols), t.where("source = 'agent'").select(*cols, "cache_read_tokens"))


@_query("turns_dedup")
def turns_dedup(spark, d, s):
    return turns.dedup_turns(T.turns(spark, d)).select("source", "project", "session_id", "seq", "response_id", "model", "ts", "input_tokens", "output_tokens")


@_query("turn_index")
def turn_index(spark, d, s):
    return turns.turn_index(T.turns(spark, d)).select("session_id", "seq", "turn_index")


@_query("scope_workspace")
def scope_workspace(spark, d, s):
    return turns.scope_workspace(T.turns(spark, d), "p3").select("source", "session_id", "seq", "model")


@_query("scope_open_folders")
def scope_open_folders(spark, d, s):
    sessions = T.table(spark, d, "customer").selectExpr("c_custkey", "CASE c_custkey % 3 WHEN 0 THEN concat('/w/', c_mktsegment, '/') WHEN 1 THEN concat('/W/', lower(c_mktsegment)) ELSE '' END AS working_dir")
    folders = T.table(spark, d, "customer").where("c_nationkey < 3").selectExpr("concat('/w/', replace(c_mktsegment, 'A', '%41')) AS uri").where("uri LIKE '%U%'")
    return turns.scope_open_folders(sessions, folders).select("c_custkey", "working_dir")


# --- usage ---------------------------------------------------------------------
def _cells(spark, d, s) -> DataFrame:
    return usage.usage_cells(T.priced(spark, d, s))


def _filtered(cells: DataFrame) -> DataFrame:
    return dashboard.filter_cells(cells, **WANTED)


def _sessions(spark, d, s) -> DataFrame:
    titles = T.turns(spark, d).groupBy("project", "session_id").agg(F.max("seq").alias("n")).where("n % 3 = 0").selectExpr("project", "session_id", "concat('Title ', n) AS title")
    return usage.usage_sessions(T.priced(spark, d, s), T.turns(spark, d), titles)


def _shown(df: DataFrame) -> DataFrame:
    return text_days(pricing.in_dollars(df))


for _name, _keys in {"usage_by_model": ["model"], "usage_daily": ["day"], "usage_daily_by_model": ["day", "model"]}.items():
    QUERIES[_name] = lambda spark, d, s=DEFAULTS, keys=_keys: text_days(usage.usage_by(T.priced(spark, d, s), *keys))
for _name, _f in {
    "usage_by_project": lambda spark, d, s: usage.usage_by_project(T.priced(spark, d, s)),
    "usage_cells": lambda spark, d, s: pricing.in_dollars(_cells(spark, d, s)),
    "usage_sessions": lambda spark, d, s: pricing.in_dollars(_sessions(spark, d, s)),
    "session_peak_turn": lambda spark, d, s: usage.session_peak_turn(T.priced(spark, d, s)),
    "usage_totals": lambda spark, d, s: usage.usage_totals(T.priced(spark, d, s)),
    "usage_grouping_sets": lambda spark, d, s: usage.usage_grouping_sets(_cells(spark, d, s)),
    "peak_day": lambda spark, d, s: pricing.in_dollars(usage.peak_day(usage.daily_cost(_cells(spark, d, s)))),
    "top_sessions": lambda spark, d, s: pricing.in_dollars(usage.top_sessions(_sessions(spark, d, s))),
    "cells_filtered": lambda spark, d, s: pricing.in_dollars(dashboard.filter_cells(_cells(spark, d, s), date_from="2024-01-03", date_to="2024-01-20", **WANTED)),
    "dashboard_cards": lambda spark, d, s: dashboard.cards(_filtered(_cells(spark, d, s))),
    "model_efficiency": lambda spark, d, s: dashboard.model_efficiency(_cells(spark, d, s)),
    "savings_whatif": lambda spark, d, s: dashboard.savings_whatif(_cells(spark, d, s), s),
    "cost_cumulative": lambda spark, d, s: dashboard.cumulative_cost(usage.daily_cost(_cells(spark, d, s))),
    "cost_moving_avg": lambda spark, d, s: dashboard.moving_average(usage.daily_cost(_cells(spark, d, s))),
    "export_cells": lambda spark, d, s: dashboard.export_rows(_filtered(_cells(spark, d, s))),
}.items():
    QUERIES[_name] = lambda spark, d, s=DEFAULTS, f=_f: text_days(f(spark, d, s))
#: Queries that use the cube more than once: it is small and written once.
for _name, _f in {
    "trend_delta": lambda cells, s: dashboard.trend_delta(_filtered(cells), cells),
    "attribution_share": lambda cells, s: dashboard.attribution(cells, "model").select(F.lit("model").alias("kind"), F.col("model").alias("name"), "cost", "share").unionByName(dashboard.attribution(cells, "project").select(F.lit("project").alias("kind"), F.col("project").alias("name"), "cost", "share")),
    "cost_stack": lambda cells, s: dashboard.stacked_layers(cells),
    "daily_top_models": lambda cells, s: dashboard.daily_top_models(cells),
}.items():
    QUERIES[_name] = lambda spark, d, s=DEFAULTS, f=_f: text_days(f(staging.save(_cells(spark, d, s), "cells"), s))


def _staged(spark, d, s) -> str:
    """Turns staged in two steps: all but each seventh day's, then those, which refreshes the partitions that they touch."""
    turns_, path = T.turns(spark, d), staging.shared_folder(spark, "turns-priced")
    late = F.coalesce(F.dayofmonth("ts") % 7 == 0, F.lit(False))
    staged.stage_turns(turns_.where(~late), path, s)
    staged.refresh_turns(turns_, turns_.where(late), path, s)
    return path


@_query("usage_cells_staged")
def usage_cells_staged(spark, d, s):
    return text_days(pricing.in_dollars(usage.usage_cells(staged.read_staged(spark, _staged(spark, d, s)))))


@_query("usage_open_projects")
def usage_open_projects(spark, d, s):
    """Cells of a span of days and of the projects whose folders are open: neither reads the partitions of others."""
    folders = T.table(spark, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("p"), F.col("n_nationkey") % 9).alias("project"))
    return text_days(pricing.in_dollars(usage.usage_cells(staged.read_staged(spark, _staged(spark, d, s), ("2024-01-03", "2024-01-20"), folders))))


@_query("session_detail")
def session_detail(spark, d, s):
    detail = usage.session_detail(T.priced(spark, d, s))
    line = lambda t: F.concat_ws("|", t["place"].cast("string"), F.coalesce(t["day"], F.lit("undated")), t["model"], t["input_tokens"].cast("string"), t["output_tokens"].cast("string"), F.format_string("%.6f", X.half_up(t["cost"], 6)), t["snippet"], t["file"])
    return detail.select("project", "session_id", F.array_join(F.transform("detail", line), ";").alias("detail"))


@_query("session_search")
def session_search(spark, d, s):
    found = dashboard.search_sessions(_sessions(spark, d, s), usage.session_detail(T.priced(spark, d, s)), "ASK 1", projects=("p1", "p2"), date_from="2024-01-03", date_to="2024-01-20")
    return found.select("project", "session_id", "title", F.array_join(F.transform("hits", lambda t: t["place"].cast("string")), ",").alias("hits"))


@_query("filter_domains")
def filter_domains(spark, d, s):
    out = dashboard.filter_domains(_cells(spark, d, s))
    return text_days(out.withColumns({c: F.array_join(c, ",") for c in ("models", "projects")}))


@_query("insights")
def insights(spark, d, s):
    return dashboard.insights(staging.save(_cells(spark, d, s), "cells"), _sessions(spark, d, s), s)


# --- calibration ----------------------------------------------------------------
@_query("calibration_models")
def calibration_models(spark, d, s):
    return calibration.calibrate_models(T.usage_log(spark, d, s, indexed=False))


@_query("calibration_baseline")
def calibration_baseline(spark, d, s):
    return calibration.baseline_ratio(T.usage_log(spark, d, s, indexed=False))


@_query("duplicate_rate")
def duplicate_rate(spark, d, s):
    return calibration.duplicate_rate(T.usage_log(spark, d, s, indexed=False))


@_query("context_growth")
def context_growth(spark, d, s):
    return calibration.context_growth(T.usage_log(spark, d, s))


@_query("snowball_p90")
def snowball_p90(spark, d, s):
    return calibration.snowball_p90(T.usage_log(spark, d, s))


@_query("snowball_threshold")
def snowball_threshold(spark, d, s):
    return calibration.snowball_threshold(T.usage_log(spark, d, s), s)


@_query("calibration_real")
def calibration_real(spark, d, s):
    return calibration.calibration(T.usage_log(spark, d, s), T.priced(spark, d, s), s)


@_query("calibrated_multiplier")
def calibrated_multiplier(spark, d, s):
    log = T.usage_log(spark, d, s, indexed=False)
    named = _models(spark, d).unionByName(_models(spark, d).select(F.concat(F.lit("v/"), "model").alias("model"))).unionByName(_models(spark, d).select(F.left("model", F.lit(2)).alias("model")))
    return calibration.calibrated_multiplier(named, calibration.calibrate_models(log), calibration.baseline_ratio(log), s)


@_query("savings_columns")
def savings_columns(spark, d, s):
    rows = pricing.price_turns(T.requests(spark, d), s)
    projected = pricing.projected_output(F.col("input_tokens"), pricing.output_multiplier(F.col("model"), s))
    rows, cheaper = rows.withColumn("cheaper", pricing.cheaper_of(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), s)), F.col("cheaper")
    return rows.select(
        "seq", F.ceil(F.col("compacted_chars") / 4).cast("long").alias("tokens_saved_by_compaction"), F.when(F.col("duplicate"), F.col("input_tokens") + projected).otherwise(0).alias("tokens_saved_by_duplicate_block"), F.col("tiered_tokens").alias("tokens_saved_by_tiering"),
        F.when(~F.col("duplicate"), cheaper["model"]).alias("suggested_cheaper_model"), F.when(~F.col("duplicate"), X.half_up(pricing.usd(cheaper["now"] - cheaper["best"]), 6)).alias("potential_savings_usd"),
    )


# --- budgets ---------------------------------------------------------------------
@_query("budget_replay")
def budget_replay(spark, d, s):
    return budget.budget_replay(T.turns(spark, d, monthly=True), s).select("session_id", "seq", "session_used", "day_used", "session_pct", "day_pct", "level", "budget")


@_query("budget_hard_block", BLOCKING)
def budget_hard_block(spark, d, s):
    return budget.budget_replay(T.turns(spark, d, monthly=True), s).select("session_id", "seq", "session_used", "day_used", "level", "budget", "blocked")


@_query("budget_learnt")
def budget_learnt(spark, d, s):
    """The replay with the output multipliers that the log shows."""
    log = staging.save(T.usage_log(spark, d, s, indexed=False).select("model", "input_tokens", "output_tokens", "cost_units", "reasoning"), "log")
    learnt = calibration.calibrated_multiplier(_models(spark, d), calibration.calibrate_models(log), calibration.baseline_ratio(log), s)
    return budget.budget_replay(T.turns(spark, d, monthly=True), s, multipliers=learnt).select("session_id", "seq", "projected", "session_used", "day_used", "level")


@_query("budget_reset")
def budget_reset(spark, d, s):
    rows = T.turns(spark, d, monthly=True).withColumn("is_reset", F.col("seq") % 29 == 0)
    return budget.budget_replay(rows, s).select("session_id", "seq", "segment", "session_used", "level")


# --- prompts ----------------------------------------------------------------------
def _history(spark, d, s, method="exact") -> DataFrame:
    said = staging.save(T.prompts(spark, d), "prompts")
    return duplicates.history_duplicates(said, duplicates.build_prompt_index(said, None), s, method)


def _evaluated(spark, d, s) -> DataFrame:
    said = staging.save(T.prompts(spark, d), "prompts")  # read by three operators
    past = duplicates.history_duplicates(said, duplicates.build_prompt_index(said, None), s)
    return rules.evaluate_rules(said, duplicates.session_duplicates(said, s), past, s)


@_query("session_duplicates")
def session_duplicates(spark, d, s):
    return duplicates.session_duplicates(T.prompts(spark, d), s)


@_query("prompt_index")
def prompt_index(spark, d, s):
    return duplicates.build_prompt_index(T.prompts(spark, d)).select("norm", "first", "latest", "project")


@_query("history_duplicates")
def history_duplicates(spark, d, s):
    return _history(spark, d, s)


@_query("history_duplicates_lsh")
def history_duplicates_lsh(spark, d, s):
    return _history(spark, d, s, "lsh")


@_query("guardrail_findings", COACH)
def guardrail_findings(spark, d, s):
    return _evaluated(spark, d, s).select("session_id", "seq", F.array_join("findings.rule", ",").alias("findings"))


@_query("guardrail_learnt", COACH)
def guardrail_learnt(spark, d, s):
    """The findings with the threshold and the multipliers that the prompts' own log shows."""
    said, log = staging.save(T.prompts(spark, d), "prompts"), staging.save(T.prompt_log(spark, d, s), "log")
    learnt = calibration.calibrated_multiplier(said.select("model").distinct(), calibration.calibrate_models(log), calibration.baseline_ratio(log), s)
    past = duplicates.history_duplicates(said, duplicates.build_prompt_index(said, None), s)
    rows = rules.evaluate_rules(said, duplicates.session_duplicates(said, s), past, s, calibration.snowball_threshold(log, s), learnt)
    return rows.select("session_id", "seq", "projected", F.array_join("findings.rule", ",").alias("findings"))


@_query("rule_counts", COACH)
def rule_counts(spark, d, s):
    return rules.rule_counts(_evaluated(spark, d, s))


@_query("duplicate_savings")
def duplicate_savings(spark, d, s):
    return rules.duplicate_savings(_evaluated(spark, d, s), s)


@_query("session_anchor")
def session_anchor(spark, d, s):
    return duplicates.first_prompt_anchor(T.prompts(spark, d))


# --- edits ---------------------------------------------------------------------------
def _files(spark, d) -> DataFrame:
    return roi.edit_roi_files(T.edit_ops(spark, d), T.request_models(spark, d), T.file_inventory(spark, d), T.ROOT)


@_query("edit_roi_files")
def edit_roi_files(spark, d, s):
    return _files(spark, d).select("fs_path", "ops", "iterations", "created", "there", F.array_join("models", ",").alias("models"), "verdict")


@_query("model_roi")
def model_roi(spark, d, s):
    # one pass over the log, kept as a table of a row for each model
    log = staging.save(calibration.calibrate_models(T.usage_log(spark, d, s, indexed=False), F.min("seq").alias("ordinal")), "calibrated")
    return roi.model_roi(_files(spark, d), log)


@_query("roi_totals")
def roi_totals(spark, d, s):
    return roi.roi_totals(_files(spark, d), T.edit_ops(spark, d), T.ROOT)


@_query("roi_top_files")
def roi_top_files(spark, d, s):
    return roi.top_files(_files(spark, d)).select("fs_path", "iterations", "ops", "verdict")


# --- conversations --------------------------------------------------------------------
@_query("compact_context", COMPACT)
def compact_context(spark, d, s):
    return context.compact_context(T.messages(spark, d), s).select("conv_id", "turn", "text", "chars_saved")


@_query("compaction_savings", COMPACT)
def compaction_savings(spark, d, s):
    return context.compaction_savings(context.compact_context(T.messages(spark, d), s))


@_query("cap_tool_result", CAPPED)
def cap_tool_result(spark, d, s):
    return context.cap_tool_results(T.messages(spark, d), s).select("conv_id", "turn", "text")


@_query("conversation_context")
def conversation_context(spark, d, s):
    return context.conversation_context(T.messages(spark, d))


@_query("tool_tiering")
def tool_tiering(spark, d, s):
    out = context.tier_tools(T.prompts(spark, d), T.tool_catalog(spark, d), s)
    return out.select("session_id", "seq", "kept", "tokens_saved", F.array_join(F.transform("kept_ids", lambda x: x.cast("string")), ",").alias("kept_ids"))


@_query("strip_chrome")
def strip_chrome(spark, d, s):
    said = T.messages(spark, d).withColumn("reply", F.expr("concat('> panel', chr(10), 'figures', chr(10), '---', chr(10), text, chr(10), '> receipt ', turn, chr(10), '---', chr(10), ' end ')"))
    return said.select("conv_id", "turn", X.strip_panels(F.col("reply"), PANELS).alias("text"))


@_query("corpus_grep")
def corpus_grep(spark, d, s):
    return context.corpus_grep(T.corpus_files(spark, d), "License", exclude=("src3/**",))


@_query("corpus_find")
def corpus_find(spark, d, s):
    return context.corpus_find(T.corpus_files(spark, d), "src1*/{en,de}/*", exclude=("**/*7",))


@_query("agent_turns")
def agent_turns(spark, d, s):
    return T.turns(spark, d).where("source = 'agent' AND (input_tokens <> 0 OR output_tokens <> 0)").select("session_id", "seq", "response_id", "model", "input_tokens", "output_tokens", "cache_read_tokens")
