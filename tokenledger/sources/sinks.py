"""Sinks: the append-only usage log and exports of usage cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.functions.text import half_up

def record_defaults() -> dict[str, Column]:
    """Columns of a record, and what stands for one that the turns lack. Budget shares are ratios, costs dollars."""
    zero, none, no, texts = F.lit(0), F.lit(0.0), F.lit(False), F.array().cast("array<string>")
    return {
        "system": F.lit("chat"), "operation": F.lit("chat"), "finish_reason": F.lit("stop"), "time_to_first_token_ms": zero, "duration_ms": zero, "input_cost_usd": none, "output_cost_usd": none, "tool_result_tokens": zero, "tool_calls_count": zero,
        "tool_names": texts, "loop_iterations": zero, "loop_hit_cap": no, "forced_final_answer": no, "tokens_saved_by_compaction": zero, "tokens_saved_by_duplicate_block": zero, "tokens_saved_by_tiering": zero, "suggested_cheaper_model": F.lit(None).cast("string"),
        "potential_savings_usd": F.lit(None).cast("double"), "workspace": F.lit("(none)"), "budget_session_pct": none, "budget_daily_pct": none, "findings": texts, "duplicate": no, "compacted": no, "reasoning_model": no,
    }


def usage_records(turns: DataFrame, prefix: str) -> DataFrame:
    """One JSON text per turn (value): 33 keys in order, costs to 6 places, budget shares as whole per cents, nulls kept.

    Needed: ts, model, input_tokens, output_tokens, cost_usd, session_id,
    turn_index; columns of record_defaults are taken where the turns have them.
    """
    defaults = record_defaults()
    get = lambda c: F.col(c) if c in turns.columns else defaults[c]
    six, pct = (lambda c: half_up(get(c), 6)), (lambda c: half_up(get(c) * 100))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    keys = {
        "timestamp": at, "gen_ai.system": get("system"), "gen_ai.operation.name": get("operation"), "gen_ai.request.model": F.col("model"), "gen_ai.response.finish_reasons": F.array(get("finish_reason")), "gen_ai.usage.input_tokens": F.col("input_tokens"), "gen_ai.usage.output_tokens": F.col("output_tokens"),
        "gen_ai.usage.total_tokens": F.col("input_tokens") + F.col("output_tokens"), "gen_ai.server.time_to_first_token_ms": get("time_to_first_token_ms"), "gen_ai.client.operation.duration_ms": get("duration_ms"), ".cost_usd": half_up(F.col("cost_usd"), 6), ".input_cost_usd": six("input_cost_usd"), ".output_cost_usd": six("output_cost_usd"),
    } | {f".{c}": get(c) for c in ("tool_result_tokens", "tool_calls_count", "tool_names", "loop_iterations", "loop_hit_cap", "forced_final_answer", "tokens_saved_by_compaction", "tokens_saved_by_duplicate_block", "tokens_saved_by_tiering", "suggested_cheaper_model")}
    keys |= {".potential_savings_usd": six("potential_savings_usd"), ".session_id": F.col("session_id"), ".turn_index": F.col("turn_index"), ".workspace": get("workspace"), ".budget_session_pct": pct("budget_session_pct"), ".budget_daily_pct": pct("budget_daily_pct")}
    keys |= {f".{c}": get(c) for c in ("findings", "duplicate", "compacted", "reasoning_model")}
    record = F.struct(*[v.alias(prefix + k if k.startswith(".") else k) for k, v in keys.items()])
    return turns.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def write_usage_log(turns: DataFrame, path: str, prefix: str, batch: int | str | None = None) -> None:
    """Append records to a folder of JSON Lines files; what is there is never rewritten.

    With a batch's name they are the folder's partition of that name: a batch
    that is written again, after a failure, takes its own place, and others stay.
    """
    records = usage_records(turns, prefix)
    if batch is None:
        records.write.mode("append").text(path)
    else:
        records.withColumn("batch", F.lit(str(batch))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").text(path)


def pack_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Write (file, value, order columns) as archives of text: every line of a value with its file's name and a tab before it, a file's lines in order in one archive."""
    lines = lines.repartition("file").sortWithinPartitions("file", *order)
    lines.select(F.explode(F.split("value", "\n")).alias("line"), "file").select(F.concat("file", F.lit("\t"), "line").alias("value")).write.text(path)


def pack_files(files: DataFrame, path: str) -> None:
    """Write whole files (value, file) as an archive, one row a file."""
    files.select("value", "file").write.parquet(path)


def export_cells(cells: DataFrame, path: str, kind: str = "csv") -> None:
    """Cells of export_rows as one CSV file (a header, then by date, model, project), or as JSON Lines files.

    In the CSV, model and project are quoted with quotes doubled, costs have 6
    places, and the rest is bare. Cells are an aggregate: one file holds them.
    """
    if kind == "json":
        cells.write.mode("overwrite").json(path)
        return
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    costs = [F.format_string("%.6f", F.col(c)) for c in ("input_cost", "output_cost", "cost")]
    line = F.concat_ws(",", "date", quoted("model"), quoted("project"), *[F.col(c).cast("string") for c in ("turns", "input_tokens", "output_tokens")], *costs)
    body = cells.select(line.alias("value"), F.struct(F.lit(1).alias("n"), "date", "model", "project").alias("place"))
    head = cells.sparkSession.range(1).select(F.lit(",".join(cells.columns)).alias("value"), F.struct(F.lit(0).alias("n"), *[F.lit("").alias(c) for c in ("date", "model", "project")]).alias("place"))
    # one file, but the cells are aggregated by as many tasks as before
    head.unionByName(body).repartition(1).sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)
