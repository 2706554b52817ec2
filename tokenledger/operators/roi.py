"""What became of edits: verdicts of files and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.functions.text import norm_path

VERDICTS = ("kept", "rework", "discarded", "pending")

#: Operations of a partition: more operations take more partitions, not more memory for each.
PART_ROWS = 250_000


def within(ops: DataFrame, root: str) -> DataFrame:
    """The operations on files below the root; case and the kind of slash don't matter."""
    below = root.replace("\\", "/").lower().rstrip("/") + "/"
    return ops.where(norm_path(F.col("fs_path")).startswith(below))


def edit_roi_files(ops: DataFrame, request_models: DataFrame, inventory: DataFrame, root: str) -> DataFrame:
    """Per file below root: ops, iterations (distinct requests, 1 at least), created, there (in the inventory), models (sorted), verdict.

    Discarded: created and gone. Then rework from three iterations on, kept if
    it is there, else pending.
    """
    # plain counts by path and request, then by path and model; only a file's few models are gathered
    parts = max(int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions")), ops.count() // PART_ROWS)
    asked = within(ops, root).repartition(parts, "fs_path", "request_id").groupBy("fs_path", "request_id").agg(F.count("*").alias("ops"), F.bool_or(F.col("type") == "create").alias("created"))
    rows = asked.repartition(parts, "request_id").join(request_models.select("request_id", "model").repartition(parts, "request_id"), "request_id", "left")
    per = rows.repartition(parts, "fs_path").groupBy("fs_path", "model").agg(F.sum("ops").alias("ops"), F.count_if(F.col("request_id") != "").alias("requests"), F.bool_or("created").alias("created"))
    files = per.groupBy("fs_path").agg(F.sum("ops").alias("ops"), F.greatest(F.lit(1).cast("long"), F.sum("requests")).alias("iterations"), F.bool_or("created").alias("created"), F.array_sort(F.collect_list("model")).alias("models"))
    files = files.join(inventory.select("fs_path").repartition(parts, "fs_path").distinct().withColumn("there", F.lit(True)), "fs_path", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    verdict = F.when(~F.col("there") & F.col("created"), "discarded").when(F.col("iterations") >= 3, "rework").when(F.col("there"), "kept").otherwise("pending")
    return files.withColumn("verdict", verdict)


def _counts() -> list:
    return [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]


def model_roi(files: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Per model: files, iterations, verdicts, est_cost (average cost of a turn times iterations), the dearest first.

    calibrated: (model, avg_cost, ordinal). The average is that of the first
    model in order whose name holds this one's or is held by it.
    """
    per = files.select(F.explode("models").alias("model"), "iterations", "verdict").groupBy("model").agg(F.count("*").alias("files"), F.sum("iterations").alias("iterations"), *_counts())
    c = calibrated.select(F.lower("model").alias("own"), "avg_cost", "ordinal")
    name = F.lower("model")
    # a row for each model on both sides; the files are read once
    fit = per.join(F.broadcast(c), name.contains(F.col("own")) | F.col("own").contains(name), "left")
    out = fit.groupBy(per.columns).agg((F.min_by("avg_cost", F.when(F.col("own").isNotNull(), F.struct("ordinal", "own"))) * F.col("iterations")).alias("est_cost"))
    return out.orderBy(F.desc(F.coalesce("est_cost", F.lit(0.0))), F.desc("iterations"), "model")


def roi_totals(files: DataFrame, ops: DataFrame, root: str) -> DataFrame:
    """One row: files, verdicts, attributed (some model is known), sessions with operations below root."""
    sessions = within(ops, root).agg(F.count_distinct("session_id").alias("sessions"))
    return files.agg(F.count("*").alias("files"), *_counts(), F.coalesce(F.bool_or(F.size("models") > 0), F.lit(False)).alias("attributed")).join(sessions, how="cross")


def top_files(files: DataFrame, n: int = 60) -> DataFrame:
    """The n files of the most iterations, then operations."""
    return files.orderBy(F.desc("iterations"), F.desc("ops"), "fs_path").limit(n)
