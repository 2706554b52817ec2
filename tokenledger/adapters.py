"""The canonical tables of the ledger, made from the given tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenledger.operators.calibration import is_reasoning
from tokenledger.operators.pricing import price_turns
from tokenledger.operators.turns import dedup_turns, turn_index
from tokenledger.settings import DEFAULTS, Settings

ROOT = "/ws/app"
MODEL = "CASE event_type WHEN 'click' THEN 'gpt-4o-mini' WHEN 'view' THEN 'claude-3-5-sonnet' WHEN 'purchase' THEN 'claude-opus-4.8' WHEN 'signup' THEN 'gemini-3-flash' ELSE 'in-house-7b' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns_of(events: DataFrame, monthly: bool = False) -> DataFrame:
    """Turns of events: sessions of a day, or of a month, of a user."""
    period = "year(ts) * 100 + month(ts)" if monthly else "year(ts) * 10000 + month(ts) * 100 + day(ts)"
    return events.selectExpr(
        "CASE WHEN event_id % 4 = 0 THEN 'agent' ELSE 'legacy' END AS source", "concat('p', user_id % 9) AS project", f"concat('s', user_id, '-', {period}) AS session_id", "event_id AS seq",
        "CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 20 = 19 THEN concat('r', event_id - 1) ELSE concat('r', event_id) END AS response_id", f"{MODEL} AS model", "CASE WHEN event_id % 97 <> 0 THEN ts END AS ts",
        "cast(floor(value * 100) AS bigint) AS input_tokens", "20 * cast(get_json_object(props, '$.k') AS bigint) AS output_tokens", "CASE WHEN event_id % 4 = 0 THEN cast(floor(value * 60) AS bigint) END AS cache_read_tokens",
        "concat('ask ', event_id % 50) AS snippet", "concat('f', event_id % 7, '.py') AS file",
    )


def turns(spark: SparkSession, sf_dir: str, monthly: bool = False) -> DataFrame:
    return turns_of(table(spark, sf_dir, "events"), monthly)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with what the chat loop did: tool_result_tokens, tool_calls, hit_cap, duplicate, compacted_chars, tiered_tokens."""
    return turns(spark, sf_dir).selectExpr("*", "seq % 100 AS tool_result_tokens", "seq % 4 AS tool_calls", "seq % 11 = 0 AS hit_cap", "seq % 13 = 0 AS duplicate", "CASE WHEN seq % 5 = 0 THEN greatest(0, input_tokens - 400) ELSE 0 END AS compacted_chars", "CASE WHEN seq % 7 = 0 THEN output_tokens ELSE 0 END AS tiered_tokens")


def priced(spark: SparkSession, sf_dir: str, s: Settings = DEFAULTS, monthly: bool = False) -> DataFrame:
    return price_turns(dedup_turns(turns(spark, sf_dir, monthly)), s)


def usage_log(spark: SparkSession, sf_dir: str, s: Settings = DEFAULTS, indexed: bool = True) -> DataFrame:
    """The usage log of monthly sessions: skipped duplicates have no tokens and no cost. indexed: with turn_index."""
    rows = priced(spark, sf_dir, s, monthly=True)
    rows = (turn_index(rows) if indexed else rows).withColumn("duplicate", F.col("seq") % 13 == 0).withColumn("reasoning", is_reasoning(F.col("model"), s))
    return rows.withColumns({c: F.when(F.col("duplicate"), F.lit(0).cast("long")).otherwise(F.col(c)) for c in ("input_tokens", "output_tokens", "input_units", "output_units", "cost_units")})


_LEAD = "CASE (conv_id + turn) % 6 WHEN 0 THEN 'Write a function: ' WHEN 1 THEN 'List the files: ' WHEN 2 THEN 'Debug the race condition: ' WHEN 3 THEN 'Explain, be concise: ' WHEN 4 THEN '/src/app/main.py ' ELSE 'Contact a.b@example.com: ' END"


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of users with re-asks in the same and in other conversations, attachments and models."""
    said = table(spark, sf_dir, "conversations").withColumn("chars", F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))).where("role = 'user'")
    base = said.selectExpr("conv_id", "turn", f"concat({_LEAD}, CASE WHEN conv_id % 8 = 3 THEN repeat(concat(text, ' '), 3) ELSE text END) AS prompt", "cast(ceil(chars / 4) AS bigint) AS context_tokens")
    again = base.where("turn <= 1 AND conv_id % 5 = 0").selectExpr("conv_id", "turn + 100 AS turn", "concat(prompt, ' please') AS prompt", "context_tokens")
    moved = base.where("turn <= 1 AND conv_id % 7 = 0").selectExpr("conv_id + 1000000 AS conv_id", "turn", "concat(prompt, ' again') AS prompt", "context_tokens")
    return base.unionByName(again).unionByName(moved).selectExpr(
        "conv_id AS session_id", "turn AS seq", "prompt", "context_tokens", "(conv_id * 7 + turn) % 9 AS ref_count", "conv_id * 1000 + turn AS asked_at", "concat('w', conv_id % 7) AS project",
        "CASE WHEN (conv_id + turn) % 23 = 0 THEN array('file:a.py', 'vscode.Workspace') ELSE array(concat('file:', turn, '.py')) END AS ref_ids",
        "CASE conv_id % 6 WHEN 0 THEN 'claude-opus-4.8' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'claude-3-5-sonnet' WHEN 3 THEN 'gemini-1.5-pro' WHEN 4 THEN 'o3' ELSE 'in-house-7b' END AS model",
    )


def prompt_log(spark: SparkSession, sf_dir: str, s: Settings = DEFAULTS) -> DataFrame:
    """A usage log of the prompts: their contexts as input, and one to three times as much output."""
    rows = turn_index(prompts(spark, sf_dir).select("session_id", "seq", "model", F.col("context_tokens").alias("input_tokens"), (F.col("context_tokens") * (F.col("session_id") % 3 + 1)).alias("output_tokens")))
    return rows.withColumns({"cost_units": F.lit(0).cast("long"), "reasoning": is_reasoning(F.col("model"), s), "duplicate": F.lit(False)})


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "CASE role WHEN 'assistant' THEN 'tool_result' ELSE 'text' END AS kind", "text")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("concat(source, '/', lang, '/', doc_id) AS path", "text AS content")


def tool_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS ordinal", "p_name AS name", "p_type AS description", "p_brand AS input_schema")


def edit_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = "concat(CASE WHEN l_partkey % 11 = 0 THEN '/ws/other' ELSE '/ws/app/src' END, '/f', l_partkey * 100 + l_suppkey % 10, '.py') AS fs_path"
    return table(spark, sf_dir, "lineitem").selectExpr("concat('e', l_orderkey % 50) AS session_id", "CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN 'create' ELSE 'edit' END AS type", path, "CASE WHEN l_orderkey % 13 = 0 THEN '' ELSE concat('q', l_orderkey) END AS request_id")


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that still exist: those whose part isn't divisible by 5."""
    return edit_ops(spark, sf_dir).select("fs_path").distinct().where(F.floor(F.regexp_extract("fs_path", r"f(\d+)\.py$", 1).cast("long") / 100) % 5 != 0)


#: The model of an order's request; an empty one where none is known.
ORDER_MODEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'claude-opus-4.8' WHEN '2-HIGH' THEN 'claude-3-5-sonnet' WHEN '3-MEDIUM' THEN 'gpt-4o-mini' WHEN '5-LOW' THEN '' ELSE 'gemini-3-flash' END"


def request_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("concat('q', o_orderkey) AS request_id", f"{ORDER_MODEL} AS model").where("model <> ''")
