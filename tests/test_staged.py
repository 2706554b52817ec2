"""Staged turns, split scans, batches of the log, workspaces and time zones."""

import datetime
import os

from pyspark.sql import functions as F

from tokenledger.operators import budget, pricing, staged, turns, usage
from tokenledger.settings import Settings
from tokenledger.sources import readers, sinks

TURNS = "source string, project string, session_id string, seq long, response_id string, model string, ts timestamp, input_tokens long, output_tokens long, cache_read_tokens long"


def frame(spark, rows):
    """rows: project, day, seq, response id, input tokens."""
    at = lambda d: None if d is None else datetime.datetime(2024, 1, d, 12)
    return spark.createDataFrame([("legacy", p, f"{p}-s", i, r, "gpt-4o", at(d), n, 1, None) for p, d, i, r, n in rows], TURNS)


ROWS = [("a", 1, 1, "x", 10), ("a", 2, 2, "y", 20), ("b/=c", 2, 3, "z", 30), ("", None, 4, "", 40), ("b/=c", 3, 5, "w", 50), ("c", 3, 6, "v", 60), ("c", 4, 7, "y", 70)]


def files_of(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def cells(priced):
    return sorted(map(str, usage.usage_cells(priced).collect()))


def test_refresh_equals_a_rebuild(spark, tmp_path):
    path = str(tmp_path / "turns")
    every = frame(spark, ROWS)
    first = every.where("seq NOT IN (1, 2)")
    staged.stage_turns(first, path)
    assert cells(staged.read_staged(spark, path)) == cells(pricing.price_turns(turns.dedup_turns(first)))
    was = files_of(path)
    # the new turn 2 comes before turn 7 of the same response, whose partition is left without a row
    parts = {tuple(r) for r in staged.refresh_turns(every, every.where("seq IN (1, 2)"), path).collect()}
    assert parts == {("2024-01-01", "a"), ("2024-01-02", "a"), ("2024-01-04", "c")}
    rebuilt = pricing.price_turns(turns.dedup_turns(every))
    assert cells(staged.read_staged(spark, path)) == cells(rebuilt)
    now = files_of(path)
    assert {f for f in was if f not in now} == {f for f in was if "2024-01-04" in f} and all(now[f] == t for f, t in was.items() if f in now)  # others weren't written
    assert staged.read_staged(spark, path).where("project = ''").count() == 1  # partitions have names of their own


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "turns")
    staged.stage_turns(frame(spark, ROWS), path)
    some = staged.read_staged(spark, path, ("2024-01-02", "2024-01-03"))
    assert {r["seq"] for r in some.collect()} == {2, 3, 5, 6} and "PartitionFilters: [isnotnull(part_day" in plan_of(some)
    folders = spark.createDataFrame([("b/=c", 1), ("c", 2), ("", 1)], "project string, open int")
    folders.write.parquet(str(tmp_path / "folders"))
    open_ = spark.read.parquet(str(tmp_path / "folders")).where("open = 1")
    rows = staged.read_staged(spark, path, projects=open_)
    assert "dynamicpruning" in plan_of(rows)
    assert {r["seq"] for r in rows.collect()} == {3, 4, 5}


def test_a_file_of_many_splits_is_the_whole_file(spark, tmp_path):
    folder = tmp_path / "w1" / "chatSessions"
    folder.mkdir(parents=True)
    entry = '{"v": {"customTitle": "T%d", "requests": [{"message": "%s", "responseId": "r%d", "result": {"metadata": {"promptTokens": %d}}}]}}'
    lines = [entry % (i, "é" * (i % 50), i, i) if i % 7 else ("" if i % 2 else "broken\rline") for i in range(400)]
    (folder / "s1.jsonl").write_text("\n".join(lines))
    (folder / "s2.jsonl").write_text("\n".join(lines[:3]) + "\n")
    whole = spark.read.text(str(folder), wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    want = readers.extract_turns(readers.chat_entries(whole)).orderBy("session_id", "seq").collect()
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, "2048")
    try:
        raw = readers.read_chat_sessions(spark, str(tmp_path))
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 8
        assert readers.extract_turns(raw).orderBy("session_id", "seq").collect() == want and len(want) == 344
        assert readers.session_titles(raw).where("session_id = 's1'").first()["title"] == "T398"
        split = readers.read_lines(spark, str(folder))
        assert sorted(map(tuple, split.where("line <> ''").collect())) == sorted(map(tuple, readers.whole_lines(whole).where("line <> ''").collect()))
        assert {r["bad"] for r in readers.bad_lines(split).collect()} == {29, 1}
    finally:
        spark.conf.set(key, was)


def test_a_batch_of_the_log_takes_its_own_place(spark, tmp_path):
    path = str(tmp_path / "log")
    log = lambda n, k: spark.range(n).selectExpr("timestamp'2024-01-01' AS ts", "'m' AS model", "id AS input_tokens", "2L AS output_tokens", "0.1D AS cost_usd", f"'s{k}' AS session_id", "id AS turn_index")
    sinks.write_usage_log(log(3, 1), path, "p", batch=1)
    first = files_of(path)
    sinks.write_usage_log(log(4, 2), path, "p", batch=2)
    sinks.write_usage_log(log(5, 2), path, "p", batch=2)  # the batch runs again
    got = readers.read_usage_log(spark, path, "p")
    assert {(r["session_id"], r["count"]) for r in got.groupBy("session_id").count().collect()} == {("s1", 3), ("s2", 5)}
    assert first.items() <= files_of(path).items()


def test_projects_of_workspaces(spark):
    rows = spark.createDataFrame([("h1", 1), ("h2", 2), (None, 3), ("h3", 4)], "workspace_hash string, seq long")
    names = spark.createDataFrame([("h1", "app"), ("h1", "app"), ("h2", ""), (None, "none")], "workspace_hash string, project string")
    for limit in (10, 0):
        assert {r["seq"]: r["project"] for r in turns.with_projects(rows, names, limit).collect()} == {1: "app", 2: "unknown", 3: "unknown", 4: "unknown"}


def test_days_of_a_time_zone(spark):
    df = frame(spark, [("a", 1, 1, "x", 10)]).withColumn("ts", F.timestamp_seconds(F.lit(1_704_074_400)))  # 2024-01-01 02:00 UTC
    day = lambda zone: str(pricing.price_turns(df, Settings(timezone=zone)).first()["day"])
    assert (day(None), day("UTC"), day("America/New_York"), day("Asia/Tokyo")) == ("2024-01-01", "2024-01-01", "2023-12-31", "2024-01-01")
    two = frame(spark, [("a", 1, 1, "x", 10), ("a", 1, 2, "y", 10)]).withColumn("ts", F.timestamp_seconds(1_704_074_400 + F.col("seq") * 3600 * 3))
    used = lambda zone: [r["day_used"] for r in budget.budget_replay(two, Settings(timezone=zone)).orderBy("seq").collect()]
    assert used("UTC") == [0, 11] and used("America/New_York") == [0, 11] and used("Asia/Tokyo") == [0, 11] and used("America/Los_Angeles") == [0, 0]
