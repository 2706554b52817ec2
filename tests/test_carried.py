"""What is carried on: over blocks of an order, over rounds of hard blocking, and over the batches of a stream."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenledger import staging
from tokenledger.operators import budget, carry, duplicates, rules
from tokenledger.settings import Settings
from tokenledger.streaming import jobs

TURNS = "session_id string, project string, seq long, ts timestamp, model string, input_tokens long, output_tokens long, is_reset boolean"


def test_blocks_equal_windows(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), i * 3, rng.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    w = Window.partitionBy("k").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("seq", F.last("v", True).over(before).alias("last"), F.lag("v").over(w).alias("prev"), F.row_number().over(w).cast("long").alias("place"), F.coalesce(F.sum("v").over(before), F.lit(0)).alias("sum"))
    got = carry.last_before(df, ["k"], "seq", F.col("v"), "last", 50)
    got = carry.previous(got, ["k"], "seq", F.col("v"), "prev", 50)
    got = carry.place(got, ["k"], "seq", "place", 50)
    got = carry.sums_before(got, ["k"], "seq", {"sum": F.col("v")}, 50)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()), key=lambda r: r[0])


def turns(spark, rows):
    """rows: session, project, day, input tokens, reset."""
    at = datetime.datetime(2024, 1, 1, 12)
    return spark.createDataFrame([(s, p, i, None if d is None else at + datetime.timedelta(days=d), "none", n, 0, r) for i, (s, p, d, n, r) in enumerate(rows)], TURNS)


def folded(rows, s):
    """Turn by turn: (session_used, day_used, blocked)."""
    sessions, days, out = {}, {}, []
    for session, project, day, n, reset in rows:
        projected = n + min(2000, -(-3 * n // 10))
        if reset:
            sessions[session] = 0
        a, b = sessions.get(session, 0), days.get((project, day), 0)
        over = a + projected >= s.session_budget or b + projected >= s.daily_budget
        out.append((a, b, over))
        if not (over and s.hard_block):
            sessions[session], days[project, day] = a + n, b + n
    return out


def replayed(spark, rows, s):
    got = budget.budget_replay(turns(spark, rows), s).orderBy("seq").collect()
    return [(r["session_used"], r["day_used"], r["blocked"] if s.hard_block else r["level"] == "over") for r in got]


def test_hard_block_is_shared_by_the_sessions_of_an_owner(spark):
    rows = [(f"s{i}", "p", 0, 1_000, False) for i in range(6)]
    soft, hard = (Settings(daily_budget=3_000, hard_block=h) for h in (False, True))
    assert [x[2] for x in replayed(spark, rows, soft)] == [False, False, True, True, True, True]
    got = replayed(spark, rows, hard)
    assert got == folded(rows, hard) and [x[1] for x in got] == [0, 1000, 2000, 2000, 2000, 2000] and [x[2] for x in got] == [False, False, True, True, True, True]
    # a smaller one still fits after larger ones were stopped; the next day starts anew
    rows = [*rows, ("s9", "p", 0, 300, False), ("s1", "p", 1, 1_000, False), ("s1", "q", 0, 1_000, False)]
    assert replayed(spark, rows, hard) == folded(rows, hard) and [x[2] for x in replayed(spark, rows, hard)][6:] == [False, False, False]


@pytest.mark.parametrize("at_once", [0, 20, 2048])
def test_hard_block_equals_the_fold(spark, at_once, monkeypatch):
    monkeypatch.setattr(budget, "FOLDED", at_once)
    rng = random.Random(at_once)
    # sessions of one project and, s0 to s3, of several
    rows = [(rng.choice(["s0", "s1", "s2", "s3", f"a{rng.randrange(4)}"]) if p == "a" else rng.choice(["s0", "s1", "s2", "s3", f"b{rng.randrange(3)}"]), p, rng.choice([0, 0, 1, None]), rng.choice([0, 40, 120, 300, 900]), rng.random() < 0.03) for p in (rng.choice("aab") for _ in range(120))]
    if at_once == 2048:
        rows = [(s if s[0] != "s" else p + s, p, *rest) for s, p, *rest in rows]  # no session of two owners
    s = Settings(session_budget=2_500, daily_budget=6_000, hard_block=True)
    assert replayed(spark, rows, s) == folded(rows, s)


def test_skipped_turns_spend_nothing(spark):
    df = turns(spark, [("s", "p", 0, 1_000, False)] * 3).withColumn("skipped", F.col("seq") == 1)
    got = budget.budget_replay(df).orderBy("seq").collect()
    assert [(r["session_used"], r["day_used"]) for r in got] == [(0, 0), (1000, 1000), (1000, 1000)]
    learnt = spark.createDataFrame([("o3", 4.0)], "model string, multiplier double")
    row = budget.with_projection(df.withColumn("model", F.lit("o3")).withColumn("output_tokens", F.lit(10).cast("long")), multipliers=learnt).where("seq = 0").first()
    assert (row["projected"], row["spent"]) == (1000 + 1200, 1040)


def test_versions_by_batch(spark, tmp_path):
    v = staging.Versions(str(tmp_path / "v"), ["k"], "k string, n bigint", every=3)
    rows = lambda *x: spark.createDataFrame(list(x), "k string, n bigint")
    state = lambda n, only=None: sorted(map(tuple, v.before(spark, n, only).collect()))
    assert state(0) == []
    v.put(rows(("a", 1), ("b", 1)), 0)
    v.put(rows(("a", 2)), 1)
    v.put(rows(("c", 9)), 2)
    v.put(rows(("c", 3)), 2)  # the batch runs again
    assert state(3) == [("a", 2), ("b", 1), ("c", 3)] and state(2) == [("a", 2), ("b", 1)] and state(3, rows(("b", 0)).select("k")) == [("b", 1)]
    v.put(rows(("d", 4)), 3, keep=F.col("n") > 1, remake=lambda df: df.withColumn("n", F.col("n") * 10))
    assert state(4) == [("a", 20), ("c", 30), ("d", 40)] and state(3) == [("a", 2), ("b", 1), ("c", 3)]


def shuffled(spark, df, order, path, parts, first=0, last=None):
    """Some of the parts of df, by order, as files in no order within; later parts are younger files."""
    rows = sorted(df.collect(), key=lambda r: r[order])
    size = -(-len(rows) // parts)
    for k in list(range(parts))[first:last]:
        part = rows[k * size : (k + 1) * size]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("hard", [False, True])
def test_stream_budget_equals_batch_over_five_batches(spark, tmp_path, hard):
    rng = random.Random(8)
    s = Settings(session_budget=3_000, daily_budget=5_000, hard_block=hard)
    rows = [(f"s{rng.randrange(5)}", "p", rng.choice([0, 0, 1, None]), rng.choice([40, 120, 300, 900]), rng.random() < 0.08) for _ in range(90)]
    rows = [(x, "q" if x == "s4" else "p", *rest) for x, _, *rest in rows]
    batch = turns(spark, rows)
    want = {r["seq"]: (r["session_used"], r["day_used"], r["level"], r["blocked"] if hard else None) for r in budget.budget_replay(batch, s).collect()}
    stream = budget.with_projection(batch, s).withColumn("day", F.coalesce(F.to_date("ts").cast("string"), F.lit(""))).withColumn("kind", F.explode(F.when(F.col("is_reset"), F.array(F.lit("reset"), F.lit("turn"))).otherwise(F.array(F.lit("turn")))))
    stream = stream.select("session_id", "project", "day", "kind", (F.col("seq") * 2 + (F.col("kind") == "turn").cast("long")).alias("seq"), "projected", "spent")
    path, state = str(tmp_path / "in"), str(tmp_path / "job")
    shuffled(spark, stream, "seq", path, 5, 0, 2)
    run = lambda: jobs.run_to_table(jobs.read_stream(spark, path), each=jobs.BudgetMeter(f"{state}/state", s, every=2).told, path=state)
    run()
    shuffled(spark, stream, "seq", path, 5, 2)  # the job stopped, and goes on
    got = {r["seq"] // 2: (r["session_used"], r["day_used"], r["level"], r["blocked"] if hard else None) for r in run().collect()}
    assert got == want


PROMPTS = "session_id long, seq long, prompt string, model string, context_tokens long, ref_count long, ref_ids array<string>, asked_at long, project string"


def asked(spark, n=60):
    rng = random.Random(5)
    base = [" ".join(f"word{rng.randrange(40)}" for _ in range(12)) for _ in range(5)]
    said = []
    for i in range(n):
        words = rng.choice(base).split()
        if rng.random() < 0.6:
            words[rng.randrange(12)] = f"other{i}"
        said.append((i % 3, i // 3, " ".join(words), rng.choice(["o3", "gpt-4o-mini"]), rng.randrange(100, 9000), i % 8, [], i, f"w{i % 2}"))
    return spark.createDataFrame(said, PROMPTS)


def test_stream_findings_equal_batch_with_a_restart(spark, tmp_path):
    df, s = asked(spark), Settings(snowball_tokens=500)
    repeats = duplicates.session_duplicates(df, s)
    want = rules.evaluate_rules(df, repeats, duplicates.history_duplicates(df, duplicates.build_prompt_index(df, None), s), s)
    show = lambda rows: {(r["session_id"], r["seq"]): (r["similarity"], r["growth"], [f["rule"] for f in r["findings"]]) for r in rows}
    want = show(want.collect())
    assert {"duplicate", "asked_before", "snowball"} <= {x for *_, f in want.values() for x in f}
    path, state = str(tmp_path / "in"), str(tmp_path / "job")
    shuffled(spark, df, "asked_at", path, 5, 0, 3)
    run = lambda: jobs.run_to_table(jobs.read_stream(spark, path), each=jobs.Coach(f"{state}/state", s, "bigint", every=2, refresh=2).told, path=state)
    run()
    shuffled(spark, df, "asked_at", path, 5, 3)
    done = run().collect()
    assert show(done) == want
    places = {(r["session_id"], r["seq"]): r["turn_index"] for r in done}
    assert places == {(k, i): i + 1 for k, i in places}


def test_idle_sets_go(spark, tmp_path):
    coach = jobs.Coach(str(tmp_path / "c"), session="bigint", idle=10, every=1)
    row = lambda session, seq, at: spark.createDataFrame([(session, seq, "the same old words", "m", 1, 0, [], at, "w")], PROMPTS)
    tell = lambda n, *r: coach.told(row(*r), n, findings=False).first()["similarity"]
    assert tell(0, 1, 0, 0) is None and tell(1, 1, 1, 5) == 1.0  # asked again within the time
    assert tell(2, 2, 0, 30) is None and tell(3, 1, 2, 31) is None  # session 1 was idle for longer


def test_similar_sets_of_common_words(spark, tmp_path):
    """Prompts from templates, in which every word is common, against brute force; new sets against old ones too."""
    rng = random.Random(9)
    template = [f"w{i}" for i in range(14)]
    sets = [tuple(sorted({w if rng.random() > 0.15 else rng.choice(["x", "y", "z"]) for w in rng.sample(template, rng.randrange(4, 14))})) for _ in range(60)]
    df = staging.save(spark.createDataFrame([(i, list(w)) for i, w in enumerate(sets)], "id long, words array<string>"), "t")
    ranked = staging.save(duplicates.rarest_first(df, duplicates.word_counts(df)), "t")
    for t in (0.5, 0.7, 0.85):
        want = {(i, j): round(len(set(a) & set(b)) / len(set(a) | set(b)), 9) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and len(set(a) & set(b)) / len(set(a) | set(b)) >= t}
        found = lambda rows: {(r["a"], r["b"]): round(r["similarity"], 9) for r in rows.collect()}
        assert found(duplicates.similar_sets(ranked, [], t)) == want
        new, old = ranked.where("id >= 40"), ranked.where("id < 40")
        assert found(duplicates.similar_sets(new, [], t, old)) == {k: v for k, v in want.items() if k[0] >= 40}


def test_lsh_finds_most(spark):
    df = asked(spark, 90)
    index = duplicates.build_prompt_index(df, None)
    exact = {(r["session_id"], r["seq"]) for r in duplicates.history_duplicates(df, index).collect()}
    found = {(r["session_id"], r["seq"]) for r in duplicates.history_duplicates(df, index, method="lsh").collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact) > 0


def test_first_turns_of_a_stream(spark, tmp_path):
    at = lambda d: datetime.datetime(2024, 1, d)
    row = lambda i, r, d=1, source="agent": (source, "p", "s", i, r, "m", at(d) if d else None, i, 0, None)
    frame = lambda *rows: spark.createDataFrame(list(rows), "source string, project string, session_id string, seq long, response_id string, model string, ts timestamp, input_tokens long, output_tokens long, cache_read_tokens long")
    first = jobs.FirstTurns(str(tmp_path / "f"), idle=5, every=2)
    kept = lambda n, *rows: sorted(r["seq"] for r in first.told(frame(*rows), n).collect())
    assert kept(0, row(3, "a"), row(2, "a"), row(9, "a", source="legacy"), row(4, ""), row(5, ""), row(6, None), row(7, "u", None)) == [4, 5, 6, 7, 9]
    assert kept(1, row(10, "a"), row(11, "b"), row(12, "")) == [11, 12]
    assert kept(1, row(10, "a"), row(11, "b"), row(12, "")) == [11, 12]  # the batch runs again
    assert kept(2, row(13, "c", 20), row(14, "u")) == [13]  # a full version: a and b are forgotten, the undated u is not
    assert kept(3, row(15, "a", 21), row(16, "c", 21), row(17, "u")) == [15]
