"""Priced turns staged by day and project: written once, refreshed by partition, pruned when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tokenledger import staging
from tokenledger.operators.pricing import local_day, price_turns
from tokenledger.operators.turns import dedup_turns
from tokenledger.settings import DEFAULTS, Settings

#: The partition columns: day and project as text, undated and unknown where there is none.
PARTS = ["part_day", "part_project"]
#: Partitions up to which their names may come to the driver, to be deleted.
NAMED = 100_000


def _named_parts(turns: DataFrame, s: Settings) -> DataFrame:
    day = F.coalesce(local_day(F.col("ts"), s).cast("string"), F.lit("undated"))
    return turns.withColumns({"part_day": day, "part_project": F.coalesce(F.nullif("project", F.lit("")), F.lit("unknown"))})


def _write(priced: DataFrame, path: str, s: Settings) -> None:
    # rebalanced, so that a day or project with a third of the turns is written by many tasks
    rows = _named_parts(priced, s).hint("rebalance", *PARTS)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)


def stage_turns(turns: DataFrame, path: str, s: Settings = DEFAULTS) -> None:
    """Write turns, deduplicated and priced, to path by day and project; partitions that they have no row of stay as they are."""
    _write(price_turns(dedup_turns(turns), s), path, s)


def touched(turns: DataFrame, new: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(part_day, part_project) that new ones of the turns can change: their own, and those of turns with a response id of theirs."""
    ids = new.where("response_id <> ''").select("response_id").distinct()
    rows = _named_parts(new, s).select(*PARTS).unionByName(_named_parts(turns.join(ids, "response_id", "left_semi"), s).select(*PARTS))
    return rows.distinct()


def refresh_turns(turns: DataFrame, new: DataFrame, path: str, s: Settings = DEFAULTS) -> DataFrame:
    """Bring the staged turns up to date with turns, of which new ones have come: only touched partitions are priced and replaced. Those are returned.

    A turn is kept or dropped for the first of its response id, so the ids of
    touched partitions are looked up in all turns, and nothing else is.
    """
    parts = staging.save(touched(turns, new, s), "touched")
    # every turn that shares a response id with one in a touched partition has a say in which of them stays
    inside = _named_parts(turns, s).join(parts, PARTS, "left_semi").drop(*PARTS)
    ids = inside.where("response_id <> ''").select("response_id").distinct()
    rivals = turns.where("response_id <> ''").join(ids, "response_id", "left_semi")
    kept = dedup_turns(rivals).unionByName(inside.where("coalesce(response_id, '') = ''"))
    kept = staging.save(_named_parts(price_turns(kept, s), s).join(parts, PARTS, "left_semi"), "refreshed")
    _write(kept.drop(*PARTS), path, s)
    spark, empty = turns.sparkSession, parts.join(kept, PARTS, "left_anti")
    if empty.limit(NAMED + 1).count() > NAMED:
        raise ValueError(f"more than {NAMED} partitions lost all their turns: stage the turns anew")
    for r in empty.collect():  # at most NAMED names of partitions that repeated responses have left without a turn
        name = lambda v: spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(v)
        staging.remove(spark, f"{path}/part_day={name(r['part_day'])}/part_project={name(r['part_project'])}")
    staging.discard(kept)
    return parts


def read_staged(spark: SparkSession, path: str, days: tuple[str, str] | None = None, projects: DataFrame | None = None) -> DataFrame:
    """The staged turns, of days from the first to the last, and of projects (project): both prune partitions, the latter while the query runs."""
    found = spark.read.parquet(path).schema
    # the names as text, whatever they look like
    schema = StructType([StructField(f.name, StringType()) if f.name in PARTS else f for f in found])
    rows = spark.read.schema(schema).parquet(path)
    if days is not None:
        rows = rows.where(F.col("part_day").between(*days))
    if projects is not None:
        names = projects.select(F.coalesce(F.nullif("project", F.lit("")), F.lit("unknown")).alias("part_project")).distinct()
        rows = rows.join(names, "part_project", "left_semi")
    return rows.drop(*PARTS)
