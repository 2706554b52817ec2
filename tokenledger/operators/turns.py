"""Turns: union of sources, removal of repeated responses, scope, places within sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenledger.functions.text import norm_uri
from tokenledger.operators import carry


def union_turns(legacy: DataFrame, agent: DataFrame) -> DataFrame:
    """Both sources; a column that one lacks is null there, so an unknown cache count stays unknown."""
    return legacy.unionByName(agent, allowMissingColumns=True)


def dedup_turns(turns: DataFrame) -> DataFrame:
    """Of the turns of one response_id the first (chat logs before agent stores, then project, session_id, seq); turns without an id all stay.

    Turns without an id keep out of the window, so they make no hot key.
    """
    rank = F.when(F.col("source") == "legacy", 0).otherwise(1)
    first = Window.partitionBy("response_id").orderBy(rank, "project", "session_id", "seq")
    named = turns.where("response_id <> ''").withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    return named.unionByName(turns.where("coalesce(response_id, '') = ''"))


def turn_index(turns: DataFrame, owner: str = "session_id", order: str = "seq") -> DataFrame:
    """turns with turn_index, their place within the session from 1."""
    return carry.place(turns, [owner], order, "turn_index")


def scope_workspace(turns: DataFrame, workspace: str | None = None) -> DataFrame:
    """The turns of one workspace (a filter that reaches a table partitioned by project), or all."""
    return turns if workspace is None else turns.where(F.col("project") == workspace)


def scope_open_folders(sessions: DataFrame, open_folders: DataFrame) -> DataFrame:
    """Of sessions (working_dir) those whose directory is among open_folders (uri); all, if none is open."""
    folders = open_folders.select(norm_uri(F.col("uri")).alias("dir_")).where("dir_ <> ''").distinct()
    rows = sessions.withColumn("dir_", norm_uri(F.col("working_dir")))
    none = folders.groupBy().agg((F.count("*") == 0).alias("none_"))
    inside = rows.join(folders.withColumn("open_", F.lit(True)), "dir_", "left").crossJoin(F.broadcast(none))
    return inside.where("none_ OR open_").drop("dir_", "open_", "none_")


def with_projects(turns: DataFrame, workspaces: DataFrame, limit: int = 500_000) -> DataFrame:
    """turns (workspace_hash) with project, by workspaces (workspace_hash, project); 'unknown' where none is told.

    The workspaces are broadcast if they are at most limit rows (counted), and else shuffled.
    """
    names = workspaces.groupBy("workspace_hash").agg(F.min(F.nullif("project", F.lit(""))).alias("project"))
    names = F.broadcast(names) if names.limit(limit + 1).count() <= limit else names
    return turns.drop("project").join(names, "workspace_hash", "left").withColumn("project", F.coalesce("project", F.lit("unknown")))
