"""Queries of round 3's findings against their SQL, and the steps that they share."""

import datetime
import pathlib
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_carried import folded, replayed
from tests.test_ledger import SF, rows
from tokenledger import staging
from tokenledger.operators import budget, duplicates, roi
from tokenledger.settings import Settings
from tokenledger.sources import readers, samples, sinks
from tokenledger.streaming import jobs


def written(spark):
    return set(pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).rglob("part-*"))


@pytest.mark.parametrize(("name", "column"), [("stream_enrich", "large"), ("stream_session_state", "similarity"), ("agent_scope", "working_dir"), ("agent_working_dir", "title")])
def test_the_whole_query_equals_its_check(spark, name, column):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("events", "customer", "part", "documents", "conversations", "lineitem", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, check = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(check.columns) and column in ours.columns
    assert not ours[column].isna().any()
    assert rows(ours) == rows(check)


def test_a_cheaper_model_is_looked_for_once_a_row(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["savings_columns"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_archives_hold_files_as_folders_do(spark, tmp_path):
    """Files in few archives, with blank and broken lines, a value of several lines and tabs within, in small splits."""
    said = [(f"w{i % 3}/chatSessions/c{i}.jsonl", turn, "\n{oops\n{\"a\": 1}" if turn == 4 else f"line\t{i} {turn} " + "x" * (i * turn % 90)) for i in range(40) for turn in range(9)]
    df = spark.createDataFrame(said, "file string, turn int, value string")
    sinks.pack_lines(df.repartition(5), str(tmp_path / "archives"), "turn")
    assert len(list((tmp_path / "archives").glob("part-*"))) <= 4
    want = {}
    for file, _, value in sorted(said):
        want.setdefault(file, []).extend(value.split("\n"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "1k")
        got = readers.read_packed_lines(spark, str(tmp_path / "archives")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {(r["file"], r["line_no"], r["line"]) for r in got} == {(f, n, line) for f, lines in want.items() for n, line in enumerate(lines)}


@pytest.mark.parametrize("name", ["src_workspaces", "turn_extract", "chat_prompt_index", "session_titles", "src_chat_jsonl", "chat_projects", "edit_ops_read", "request_models"])
def test_raw_files_are_few(spark, name):
    """As many files as tasks wrote, not one for each session, workspace or state."""
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("conversations", "lineitem", "orders", "supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    before = written(spark)
    ours = entry.queries()[name](spark, SF).toPandas()
    assert rows(ours) == rows(con.execute(entry.oracle_sql()[name]).df())
    assert len(written(spark) - before) <= 16


def test_agent_stores_in_small_batches():
    """Files written and read by few at a time, and rows of many sessions in one batch."""
    turns = [{"seq": i, "id": f"t{i}", "usage": '{"inputTokens": 1}'} for i in range(30)]
    sessions = pa.RecordBatch.from_pylist([{"session_id": f"s{i}", "first": i, "project": i % 9, "turns": turns} for i in range(500)])
    made = list(samples._databases(iter([sessions])))
    assert max(b.num_rows for b in made) <= 64 and sum(b.num_rows for b in made) == 500
    assert sum(b.nbytes for b in made) < 500 * 5000
    at = pa.array([datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)], pa.timestamp("us", "UTC"))
    files = [pa.RecordBatch.from_arrays([*b.columns, pa.concat_arrays([at] * b.num_rows)], ["path", "content", "modificationTime"]) for b in made]
    read = list(readers._store_rows(iter(files)))
    assert len(read) < 10 and max(b.num_rows for b in read) <= readers.STORE_ROWS
    rows = [r for b in read for r in b.to_pylist()]
    assert sum(r["kind"] == "corrupt" for r in rows) == 13 and sum(r["kind"] == "turn_usage" for r in rows) == 487 * 30
    assert [r["key"] for r in rows if r["session_id"] == "s1" and r["kind"] == "turn_usage"] == [f"t{i}" for i in range(30)]


def test_lsh_compares_few_unlike_pairs(spark):
    """Sets that share a quarter of their words: none is like another, and few meet."""
    common = [f"c{i}" for i in range(5)]
    sets = staging.save(spark.createDataFrame([(i, common + [f"w{i}-{j}" for j in range(15)]) for i in range(200)] + [(1000 + i, common + [f"w{i}-{j}" for j in range(14)]) for i in range(50)], "id long, words array<string>"), "t")
    found = {(r["a"], r["b"]) for r in duplicates._lsh_pairs(sets, 0.7).collect()}
    assert found == {p for i in range(50) for p in ((i, 1000 + i), (1000 + i, i))}
    bands = max(pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("bands-*"), key=lambda p: p.stat().st_mtime)
    rows = spark.read.parquet(f"file://{bands}")
    met = rows.alias("x").join(rows.alias("y"), "band").where("x.id < y.id").select("x.id", "y.id").distinct().count()
    assert met < 250 * 249 // 2 // 4


def test_hard_blocking_takes_few_rounds(spark, monkeypatch):
    """Days of many turns with small gaps left, and sessions over several days: rounds do not grow with the turns that run."""
    rng = random.Random(12)
    rows = [(f"{p}{rng.randrange(90)}", p, rng.randrange(4), rng.choice([10, 40, 120, 300, 900, 2_500]), False) for p in (rng.choice("ab") for _ in range(900))]
    saved, save = [], staging.save
    monkeypatch.setattr(staging, "save", lambda df, name: saved.append(name) or save(df, name))
    monkeypatch.setattr(budget, "FOLDED", 20)
    s = Settings(session_budget=3_500, daily_budget=6_000, hard_block=True)
    assert replayed(spark, rows, s) == folded(rows, s)
    assert saved.count("budget-round") <= 8


def test_batches_are_made_from_one_pass(spark):
    """The rows of a stream's batches are worked out once, and words are not shuffled with the norms that they are taken from."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        seen.add(1)
        return i

    made = jobs.in_batches(spark.range(40).select(counted("id").alias("seq")), "seq", 3)
    assert seen.value == 40
    assert sorted(r["seq"] for r in jobs.run_to_table(made).collect()) == list(range(40))
    said = spark.createDataFrame([("One two three four five", 1, "p"), ("one TWO three four five", 3, "q"), ("too short", 2, "p")], "prompt string, asked_at long, project string")
    index = duplicates.build_prompt_index(said, None)
    assert "first(words" not in index._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["norm"], r["words"], r["first"], r["latest"], r["project"]) for r in index.collect()] == [("one two three four five", ["five", "four", "one", "three", "two"], 1, 3, "q")]


def test_batches_broadcast_only_what_is_marked(spark, monkeypatch):
    """Rows, sets and contexts of a stream's batches are joined without a pass through the driver; its own session alone is set so."""
    said = spark.createDataFrame([(f"s{i % 3}", i, f"word{i % 4} and more of {i % 2}", i, 10 * i) for i in range(24)], "session_id string, seq long, prompt string, asked_at long, context_tokens long")
    plans, save = [], staging.save
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    path = staging.shared_folder(spark, "coach")
    live = jobs.Coach(f"{path}/state")
    batches = jobs.in_batches(said, "seq", 2)

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, name)

    monkeypatch.setattr(staging, "save", seen)
    told = jobs.run_to_table(batches, each=lambda batch, n: live.told(batch, n, findings=False, below=True).select("session_id", "seq", "turn_index"), path=path)
    assert sorted((r["session_id"], r["seq"], r["turn_index"]) for r in told.collect()) == [(f"s{k}", i, i // 3 + 1) for k in range(3) for i in range(k, 24, 3)]
    assert any("SortMergeJoin" in x for x in plans) and not any("BroadcastExchange" in x for x in plans)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == threshold


def test_edits_take_partitions_by_rows(spark, monkeypatch):
    """More operations are dealt over more partitions than spark.sql.shuffle.partitions, with the same rows."""
    ops = spark.createDataFrame([(f"e{i % 3}", "create" if i % 5 == 0 else "edit", f"/ws/app/f{i % 7}.py", f"q{i % 20}" if i % 9 else "") for i in range(80)], "session_id string, type string, fs_path string, request_id string")
    models = spark.createDataFrame([(f"q{i}", f"m{i % 3}") for i in range(15)], "request_id string, model string")
    there = ops.select("fs_path").where("fs_path <> '/ws/app/f0.py'")
    want = sorted(roi.edit_roi_files(ops, models, there, "/ws/app").collect())
    monkeypatch.setattr(roi, "PART_ROWS", 10, raising=False)
    made = roi.edit_roi_files(ops, models, there, "/ws/app")
    assert "fs_path" in made.columns and sorted(made.collect()) == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 8" in plan
