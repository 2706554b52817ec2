"""Readers of chat sessions, agent stores, usage logs, edit checkpoints, transcripts and workspaces."""

from __future__ import annotations

import datetime
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenledger.functions.text import normalize_model, project_from_uri


def number(v: Column, path: str) -> Column:
    """A JSON number as double, 0 for anything else: a number in quotes is none."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    value = F.try_variant_get(v, path, "double")
    return F.coalesce(F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & (F.abs(value) < float("inf")), value), F.lit(0.0))


def text(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def whole_lines(files: DataFrame) -> DataFrame:
    """(file, line_no, line) of whole files (value, file), one row a file."""
    return files.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def read_whole(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(value, file) of the small files below a folder, one row a file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select("value", F.col("_metadata.file_path").alias("file"))


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(value, file) of whole files packed by sinks.pack_files."""
    return spark.read.schema("value string, file string").parquet(path)


def read_lines(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """(file, line_no, line) of text files, a large file by its splits: a line's number is its place in its split, after the lines of the splits before.

    Lines end with a line feed alone, as in whole_lines; within a task, rows
    come in the order of the file, which their ascending ids keep.
    """
    return _numbered(spark.read.text(path, lineSep="\n", **options).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id")))


def read_packed_lines(spark: SparkSession, path: str) -> DataFrame:
    """read_lines of files packed by sinks.pack_lines: each line names its file before a tab, and a file's lines stand in order in one archive.

    A folder of small files costs a listing, an opening and a commit for each; archives are read by splits, however many files they hold.
    """
    rows = spark.read.text(path, lineSep="\n").select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).alias("split"), F.monotonically_increasing_id().alias("id"))
    tab = F.locate("\t", F.col("value"))
    return _numbered(rows.select(F.expr("substring(value, instr(value, '\t') + 1)").alias("line"), F.left("value", tab - 1).alias("file"), "split", "id"))


def _numbered(rows: DataFrame) -> DataFrame:
    """(file, line_no, line) of lines (line, file, split, id)."""
    inside = Window.partitionBy("file", "split").orderBy("id")
    counts = rows.groupBy("file", "split").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = rows.withColumn("place", F.row_number().over(inside) - 1).join(counts.hint("merge"), ["file", "split"])
    return numbered.select("file", (F.col("before") + F.col("place")).cast("int").alias("line_no"), "line")


def chat_entries(files: DataFrame, session: str = r"([^/]+)\.jsonl$", workspace: str = r"([^/]+)/chatSessions/[^/]*$") -> DataFrame:
    """(workspace_hash, session_id, line_no, entry variant) of lines (file: its path, line_no, line) or whole files (value, file); malformed and blank lines are left out.

    session and workspace are the patterns whose first groups name them in a path.
    """
    lines = files if "line" in files.columns else whole_lines(files)
    lines = lines.withColumn("entry", F.try_parse_json("line")).where("entry IS NOT NULL")
    return lines.select(F.regexp_extract("file", workspace, 1).alias("workspace_hash"), F.regexp_extract("file", session, 1).alias("session_id"), "line_no", "entry")


def read_chat_sessions(spark: SparkSession, path: str, workspace: str = "*", glob: str = "*.jsonl") -> DataFrame:
    """chat_entries of <path>/<workspace>/chatSessions/<session>.jsonl; a workspace's hash reads its folder alone."""
    return chat_entries(read_lines(spark, f"{path}/{workspace}/chatSessions", pathGlobFilter=glob))


def bad_lines(files: DataFrame) -> DataFrame:
    """(file, bad): the lines of each file that are neither blank nor JSON."""
    lines = (files if "line" in files.columns else whole_lines(files)).where("trim(line) <> ''")
    return lines.groupBy("file").agg(F.count_if(F.try_parse_json("line").isNull()).alias("bad"))


def session_titles(raw: DataFrame) -> DataFrame:
    """The last non-empty title of each session."""
    titled = raw.withColumn("title", text(F.col("entry"), "$.v.customTitle")).where("title <> ''")
    return titled.groupBy("workspace_hash", "session_id").agg(F.max_by("title", "line_no").alias("title"))


def extract_turns(raw: DataFrame) -> DataFrame:
    """Turns of chat entries: requests whose metadata has a token key, null values included; numbers that are none count 0."""
    rows = raw.select("workspace_hash", "session_id", "line_no", F.posexplode(F.try_variant_get("entry", "$.v.requests", "array<variant>")).alias("index", "r"))
    keys = F.json_object_keys(F.to_json(F.try_variant_get("r", "$.result.metadata", "variant")))
    present = F.coalesce(F.array_contains(keys, "promptTokens") | F.array_contains(keys, "outputTokens"), F.lit(False))
    rows = rows.where(present)
    model = F.coalesce(text(F.col("r"), "$.modelId"), text(F.col("r"), "$.result.metadata.resolvedModel"), F.lit("unknown"))
    said = F.coalesce(text(F.col("r"), "$.message"), text(F.col("r"), "$.message.text"), F.lit(""))
    stamp = number(F.col("r"), "$.timestamp")
    names = F.transform(F.slice(F.coalesce(F.try_variant_get("r", "$.variableData.variables", "array<variant>"), F.array().cast("array<variant>")), 1, 6), lambda x: F.try_variant_get(x, "$.name", "string"))
    return rows.select(
        F.lit("legacy").alias("source"), "workspace_hash", "session_id", (F.col("line_no") * 100_000 + F.col("index")).cast("long").alias("seq"), F.coalesce(text(F.col("r"), "$.result.metadata.responseId"), F.lit("")).alias("response_id"),
        normalize_model(model).alias("model"), F.when(stamp > 0, F.timestamp_millis(stamp.cast("long"))).alias("ts"), number(F.col("r"), "$.result.metadata.promptTokens").cast("long").alias("input_tokens"),
        number(F.col("r"), "$.result.metadata.outputTokens").cast("long").alias("output_tokens"), F.lit(None).cast("long").alias("cache_read_tokens"), F.left(said, F.lit(140)).alias("snippet"),
        F.coalesce(F.get(F.filter(names, lambda x: x.isNotNull() & (x != "")), 0), F.lit("")).alias("file"),
    )


def prompt_history(raw: DataFrame) -> DataFrame:
    """(workspace_hash, session_id, line_no, index, prompt, asked_at) of every request with text, whether or not it has token counts; asked_at is null where no time is known."""
    rows = raw.select("workspace_hash", "session_id", "line_no", F.posexplode(F.try_variant_get("entry", "$.v.requests", "array<variant>")).alias("index", "r"))
    said, stamp = F.coalesce(text(F.col("r"), "$.message"), text(F.col("r"), "$.message.text"), F.lit("")), number(F.col("r"), "$.timestamp")
    return rows.select("workspace_hash", "session_id", "line_no", "index", said.alias("prompt"), F.when(stamp > 0, stamp.cast("long")).alias("asked_at")).where("prompt <> ''")


#: Rows of an Arrow batch of decoded stores, and bytes of their texts; a batch ends with the row that reaches either.
STORE_ROWS, STORE_BYTES = 4096, 4 << 20


def _store_file(path: str, content: bytes, mtime: datetime.datetime) -> list[tuple]:
    """The rows of one file; a single one of kind corrupt if it can't be read."""
    session, rows, text = path.rsplit("/", 2)[-2], [], lambda x: None if x is None else str(x)
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(content)
        for kind, sql in (("turn_usage", "SELECT turn_id, usage FROM turn_usage ORDER BY rowid"), ("session_metadata", "SELECT key, value FROM session_metadata ORDER BY rowid")):
            rows += [(session, kind, n, text(a), text(b), mtime) for n, (a, b) in enumerate(db.execute(sql))]
    except sqlite3.Error:
        rows = [(session, "corrupt", 0, None, None, mtime)]
    finally:
        db.close()
    return rows


def _store_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"session_id": pa.string(), "kind": pa.string(), "n": pa.int64(), "key": pa.string(), "value": pa.string(), "file_mtime": pa.timestamp("us", "UTC")}

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    rows, held = [], 0
    for batch in batches:
        for path, content, mtime in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            for row in _store_file(path, content.as_py(), mtime):
                rows.append(row)
                held += len(row[3] or "") + len(row[4] or "")
                if len(rows) >= STORE_ROWS or held >= STORE_BYTES:
                    yield made(rows)
                    rows, held = [], 0
    if rows:
        yield made(rows)


def read_agent_store(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, kind, n, key, value, file_mtime) of <path>/<session>/session.db: turn_usage and session_metadata rows; an unreadable file gives one row of kind corrupt."""
    return agent_store(spark.read.format("binaryFile").load(f"{path}/*/session.db"))


def agent_store(files: DataFrame) -> DataFrame:
    """The rows of read_agent_store for files (path, content, modificationTime)."""
    return files.select("path", "content", "modificationTime").mapInArrow(_store_rows, "session_id string, kind string, n long, key string, value string, file_mtime timestamp")


def agent_turns(store: DataFrame) -> DataFrame:
    """Turns of agent stores: rows with usage and some tokens; blank turn ids are named within their session."""
    use = F.from_json("value", "inputTokens double, outputTokens double, cacheReadTokens double, model string")
    rows = store.where("kind = 'turn_usage' AND trim(coalesce(value, '')) <> ''").withColumn("u", use)
    count = lambda c: F.coalesce(F.col(f"u.{c}"), F.lit(0.0)).cast("long")
    rows = rows.where((count("inputTokens") != 0) | (count("outputTokens") != 0))
    name = F.when(F.coalesce("key", F.lit("")) == "", F.concat("session_id", F.lit(":turn:"), F.col("n").cast("string"))).otherwise(F.col("key"))
    return rows.select(F.lit("agent").alias("source"), "session_id", name.alias("response_id"), normalize_model(F.coalesce("u.model", F.lit("unknown"))).alias("model"), F.col("file_mtime").alias("ts"), count("inputTokens").alias("input_tokens"), count("outputTokens").alias("output_tokens"), F.when(F.col("u.cacheReadTokens").isNotNull(), count("cacheReadTokens")).alias("cache_read_tokens"))


def agent_titles(store: DataFrame) -> DataFrame:
    """(session_id, title) of agent sessions: their customTitle, else '(agent session)'."""
    named = F.max(F.when((F.col("kind") == "session_metadata") & (F.col("key") == "customTitle"), F.nullif("value", F.lit(""))))
    return store.groupBy("session_id").agg(F.coalesce(named, F.lit("(agent session)")).alias("title"))


def working_dirs(store: DataFrame, prefix: str = "copilot") -> DataFrame:
    """The working directory of each session: the first of a list, a single one, or the customization directory."""
    keys = [f"{prefix}.{k}" for k in ("workingDirectories", "workingDirectory", "customizationDirectory")]
    meta = store.where((F.col("kind") == "session_metadata") & F.col("key").isin(keys)).dropDuplicates(["session_id", "key"]).groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))  # a few keys a session
    pick = lambda k: F.nullif(F.try_element_at("m", F.lit(f"{prefix}.{k}")), F.lit(""))
    return meta.select("session_id", F.coalesce(F.nullif(F.get_json_object(pick("workingDirectories"), "$[0]"), F.lit("")), pick("workingDirectory"), pick("customizationDirectory"), F.lit("")).alias("working_dir"))


def read_workspaces(spark: SparkSession, path: str, glob: str = "workspace.json") -> DataFrame:
    """(workspace_hash, project) of <path>/<hash>/workspace.json: of its folder, else of its workspace file; 'unknown' where neither is told."""
    return workspaces_of(read_whole(spark, path, glob))


def workspaces_of(files: DataFrame) -> DataFrame:
    """read_workspaces of whole files (value, file)."""
    files = files.select(F.from_json("value", "folder string, workspace string").alias("w"), "file").select("w.*", "file")
    return files.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("workspace_hash"), project_from_uri(F.coalesce(F.nullif("folder", F.lit("")), "workspace")).alias("project"))


def read_usage_log(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """The fields that calibration reads, from a JSON Lines log; lines that are no JSON are left out."""
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("e")).where("e IS NOT NULL")
    key = lambda k: f'$["{k}"]'
    return lines.select(
        text(F.col("e"), key(f"{prefix}.session_id")).alias("session_id"), number(F.col("e"), key(f"{prefix}.turn_index")).cast("long").alias("turn_index"), text(F.col("e"), key("gen_ai.request.model")).alias("model"),
        number(F.col("e"), key("gen_ai.usage.input_tokens")).cast("long").alias("input_tokens"), number(F.col("e"), key("gen_ai.usage.output_tokens")).cast("long").alias("output_tokens"), number(F.col("e"), key(f"{prefix}.cost_usd")).alias("cost_usd"),
        F.coalesce(F.try_variant_get("e", key(f"{prefix}.reasoning_model"), "boolean"), F.lit(False)).alias("reasoning"), F.coalesce(F.try_variant_get("e", key(f"{prefix}.duplicate"), "boolean"), F.lit(False)).alias("duplicate"),
    )


def read_edit_ops(spark: SparkSession, path: str, glob: str = "state.json") -> DataFrame:
    """(session_id, type, fs_path, request_id) of <path>/<session>/state.json; operations without a path are left out, files that are no JSON as well."""
    return edit_ops_of(read_whole(spark, path, glob))


def edit_ops_of(files: DataFrame) -> DataFrame:
    """read_edit_ops of whole files (value, file)."""
    schema = "timeline struct<operations: array<struct<type: string, requestId: string, uri: struct<fsPath: string>>>>"
    files = files.select("file", F.from_json("value", schema).alias("s"))
    ops = files.select("file", F.explode("s.timeline.operations").alias("o")).where("o.uri.fsPath <> ''")
    return ops.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("session_id"), F.coalesce("o.type", F.lit("edit")).alias("type"), F.col("o.uri.fsPath").alias("fs_path"), F.coalesce("o.requestId", F.lit("")).alias("request_id"))


def read_request_models(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(request_id, model) of transcripts: of requests with both ids and a model the last in the order of paths and places wins."""
    return request_models_of(read_whole(spark, path, glob))


def request_models_of(files: DataFrame) -> DataFrame:
    """read_request_models of whole files (value, file)."""
    schema = "requests array<struct<requestId: string, modelId: string>>"
    files = files.select("file", F.from_json("value", schema).alias("s"))
    rows = files.select("file", F.posexplode("s.requests").alias("i", "r")).where("r.requestId IS NOT NULL AND r.modelId <> ''")
    last = rows.groupBy(F.col("r.requestId").alias("request_id")).agg(normalize_model(F.max_by("r.modelId", F.struct("file", "i"))).alias("model"))
    return last.where("model <> ''")
