"""The ledger's operators: worked examples, settings, invariants, and the SQL checks at the smallest scale."""

import datetime
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from tokenledger.functions import register
from tokenledger.functions import text as X
from tokenledger.operators import budget, calibration, context, dashboard, duplicates, pricing, roi, rules, turns, usage
from tokenledger.plans import checks, queries
from tokenledger.settings import DEFAULTS, Settings
from tokenledger.sources import readers, samples, sinks
from tokenledger.streaming import jobs

SF = "/root/testdata/sf0.001"
TURNS = "source string, project string, session_id string, seq long, response_id string, model string, ts timestamp, input_tokens long, output_tokens long, cache_read_tokens long, snippet string, file string"
#: Checked here; the others are checked by the driver's comparison on a larger folder.
SOME = ("usage_by_model", "usage_grouping_sets", "session_detail", "insights", "cheaper_model", "turn_receipt", "budget_replay", "budget_hard_block", "guardrail_findings", "model_roi", "compact_context", "tool_tiering", "turn_extract", "agent_store_turns", "edit_ops_read", "usage_log_record", "export_csv", "stream_session_state")


def rows(frame):
    clean = lambda x: None if x is None or str(x) in ("NaT", "<NA>") or x != x else round(float(x), 9) if isinstance(x, float) else x if isinstance(x, (int, str, bool)) else str(x)
    return sorted((tuple(clean(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql_check(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("events", "customer", "part", "documents", "conversations", "lineitem", "orders", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, check = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(check.columns)
    assert rows(ours) == rows(check)


def test_every_query_but_the_approximate_one_has_a_check():
    import __spark_entry__ as entry

    mine = {n for n in entry.queries() if n in queries.QUERIES or n in samples.QUERIES or n in jobs.QUERIES}
    assert mine - set(entry.oracle_sql()) == {"history_duplicates_lsh"}
    assert set(checks.CHECKS) <= set(queries.QUERIES)


def turn(seq, model="opus", tokens=(1000, 100), cache=None, session="s", response="", source="legacy", project="p", ts="2024-01-01 10:00:00"):
    return (source, project, session, seq, response, model, datetime.datetime.fromisoformat(ts) if ts else None, *tokens, cache, f"ask {seq}", "f.py")


def one(df):
    return df.first().asDict()


def test_prices_costs_and_suggestions(spark):
    df = spark.createDataFrame([("gpt-4o-mini", 0, 0), ("copilot/GPT-4.1-mini", 0, 0), ("gemini-3-flash", 8028, 2000), ("", 1, 1), (None, 1, 1), ("claude-3-5-sonnet", 10_000, 1_000), ("gemini-1.5-flash", 10_000, 1_000)], "model string, input_tokens long, output_tokens long")
    p = {r["model"]: r["p"] for r in df.select("model", pricing.price_of(F.col("model")).alias("p")).collect()}
    assert p["gpt-4o-mini"]["price_key"] == "gpt-4o-mini" and p["copilot/GPT-4.1-mini"]["p_in"] == 4_000_000 and p["gemini-3-flash"]["price_key"] == "gemini"
    assert p[""]["price_key"] is p[None]["price_key"] is None and p[""]["p_out"] == 80_000_000
    assert {r["model"]: r["cost_usd"] for r in pricing.list_cost(df).collect()}["gemini-3-flash"] == pytest.approx(0.020035)
    c = {r["model"]: r["c"] for r in df.select("model", pricing.cheaper_of(F.col("model"), F.col("input_tokens"), F.col("output_tokens")).alias("c")).collect()}
    assert c["claude-3-5-sonnet"]["model"] == "gemini-1.5-flash" and c["claude-3-5-sonnet"]["best"] == 10_500_000_000
    assert c["gemini-1.5-flash"] is None and c["gpt-4o-mini"] is None
    book = Settings(price_overrides={"opus": (1, 2), "new": (3, 4)})
    assert [k for _, k, *_ in book.prices()][12] == "opus" and book.prices()[12][2:] == (1.0, 2.0) and book.prices()[-1][1] == "new"
    own = one(spark.createDataFrame([("new-opus",)], "model string").select(pricing.price_of(F.col("model"), book)["p_in"].alias("x")))
    assert own["x"] == 10_000_000  # the longer key wins
    named = spark.createDataFrame([("a_b",)], "model string").select(pricing.price_of(F.col("model"), Settings(price_overrides={"a%b": (9, 9), "x_b": (9, 9)}))["price_key"].alias("k"))
    assert one(named)["k"] is None  # keys are no patterns


def test_cache_splits(spark):
    df = spark.createDataFrame([turn(1, cache=400), turn(2, cache=5000), turn(3)], TURNS)
    cost = {r["seq"]: r["cost"] for r in pricing.in_dollars(pricing.price_turns(df)).collect()}
    assert cost[1] == pytest.approx(0.0171) and cost[2] == pytest.approx(0.0015 + 0.0075) and cost[3] == pytest.approx(0.0225)
    assumed = {r["seq"]: r["cost"] for r in pricing.in_dollars(pricing.price_turns(df, Settings(assumed_cache_fraction=0.5))).collect()}
    assert assumed[1] == cost[1] and assumed[3] == pytest.approx(0.015 * 0.55 + 0.0075)


def test_union_keeps_unknown_and_dedup_keeps_the_first(spark):
    legacy = spark.createDataFrame([turn(5, response="a"), turn(6), turn(7)], TURNS).drop("cache_read_tokens")
    agent = spark.createDataFrame([turn(1, response="a", cache=3, source="agent"), turn(2, response="b", cache=3, source="agent")], TURNS)
    every = turns.union_turns(legacy, agent)
    assert every.where("cache_read_tokens IS NULL").count() == 3
    assert sorted(r["seq"] for r in turns.dedup_turns(every).collect()) == [2, 5, 6, 7]
    assert turns.dedup_turns(every.where("false")).count() == 0


def test_usage_adds_up(spark):
    df = pricing.price_turns(spark.createDataFrame([turn(1, cache=9), turn(2, "o3", project="", ts=None), turn(3, "o3", session="t", ts="2024-01-02 00:00:00")], TURNS))
    cells, total = usage.usage_cells(df), one(usage.usage_totals(df))
    shown = pricing.in_dollars(cells).toPandas()
    assert shown["turns"].sum() == total["turns"] == 3 and shown["cost"].sum() == pytest.approx(total["cost"])
    assert (shown["input_cost"] + shown["output_cost"]).sum() == pytest.approx(total["cost"])
    sets = usage.usage_grouping_sets(cells).toPandas()
    assert sets[(sets["no_model"] == 1) & (sets["no_project"] == 1) & (sets["no_day"] == 1)]["cost"].iloc[0] == pytest.approx(total["cost"])
    assert {r["project"] for r in usage.usage_by_project(df).collect()} == {"p", "unknown"}
    assert [r["title"] for r in usage.usage_sessions(df, df, spark.createDataFrame([("p", "t", "T")], "project string, session_id string, title string")).orderBy("session_id", "project").collect()] == ["ask 2", "ask 1", "T"]
    detail = usage.session_detail(df, 1)
    found = dashboard.search_sessions(usage.usage_sessions(df, df), detail, " ASK 3 ")
    assert [(r["session_id"], len(r["hits"])) for r in found.collect()] == [("t", 1)]
    assert dashboard.filter_cells(cells, date_from="2024-01-02").count() == 2  # the undated cell passes
    none = cells.where("false")
    assert one(dashboard.cards(none))["cost_per_turn"] == 0 and one(dashboard.trend_delta(none, none))["change_pct"] is None
    assert dashboard.insights(none, usage.usage_sessions(df.where("false"), df)).count() == 0 and usage.peak_day(usage.daily_cost(none)).count() == 0


def test_formats(spark):
    x = spark.createDataFrame([(0.0,), (0.00123,), (0.5,), (4.6,), (1234.0,)], "x double")
    show = lambda style: [r[0] for r in x.select(X.format_usd(F.col("x"), style)).collect()]
    assert show("price") == ["$0", "$0.0012", "$0.500", "$4.60", "$1234.00"] and show("axis")[1:] == ["$0.001", "$0.500", "$4.60", "$1.2k"]
    n = spark.createDataFrame([(999,), (1500,), (12_345,), (2_500_000,)], "n long")
    assert [r[0] for r in n.select(X.format_tokens(F.col("n"))).collect()] == ["999", "1.5k", "12.3k", "2.5M"]
    assert [r[0] for r in n.select(X.format_tokens(F.col("n"), "panel")).collect()] == ["999", "1.5k", "12k", "2500k"]
    assert one(spark.createDataFrame([(r"C:\A\b.py", "a/b/ c ")], "p string, m string").select(X.norm_path(F.col("p")).alias("p"), X.normalize_model(F.col("m")).alias("m"))) == {"p": "c:/a/b.py", "m": "c"}
    register(spark)
    assert spark.sql("SELECT token_estimate('12345') t, prompt_jaccard(array('a'), array('a', 'b')) j, token_cost(1000000, 0, 2.0, 8.0) c").first() == (2, 0.5, 2.0)


def test_receipts(spark):
    df = spark.createDataFrame([("gemini-3-flash", 8028, 0, 3613), ("o3", 100, 10, 0)], "model string, input_tokens long, output_tokens long, tool_result_tokens long")
    got = {r["model"]: r for r in pricing.turn_receipts(df).collect()}
    assert got["gemini-3-flash"]["projected_usd"] == pytest.approx(0.020035) and got["o3"]["billed_output"] == 25 and got["o3"]["credits"] == 1
    learnt = spark.createDataFrame([("o3", 4.0), ("gemini-3-flash", None)], "model string, multiplier double")
    assert {r["model"]: r["billed_output"] for r in pricing.turn_receipts(df, DEFAULTS, learnt).collect()} == {"o3": 40, "gemini-3-flash": 0}


def test_nearest_rank_and_multipliers(spark):
    rank = lambda xs: one(calibration.nearest_rank(spark.createDataFrame([(x,) for x in xs], "g long"), "g"))["value"]
    assert (rank(range(1, 11)), rank([7]), rank([])) == (10, 7, None)
    log = spark.createDataFrame([("s", i, i, "o3" if i % 2 else "base", 100, 900 if i % 2 else 100, 5, bool(i % 2), False) for i in range(16)], "session_id string, seq long, turn_index long, model string, input_tokens long, output_tokens long, cost_units long, reasoning boolean, duplicate boolean")
    models = spark.createDataFrame([("O3-pro",), ("other",)], "model string")
    multipliers = lambda log: {r["model"]: r["multiplier"] for r in calibration.calibrated_multiplier(models, calibration.calibrate_models(log), calibration.baseline_ratio(log)).collect()}
    assert multipliers(log) == {"O3-pro": 5.0, "other": None} and multipliers(log.where("seq < 14"))["O3-pro"] is None
    assert one(calibration.snowball_threshold(log.where("seq < 3")))["threshold"] == DEFAULTS.snowball_tokens
    assert one(calibration.duplicate_rate(log.where("false")))["duplicate_rate"] == 0


BUDGET = "session_id string, project string, seq long, ts timestamp, model string, input_tokens long, output_tokens long, is_reset boolean"


def spent(spark, sizes, resets=()):
    at = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([("s", "p", i, at, "none", n, 0, i in resets) for i, n in enumerate(sizes)], BUDGET)


def replay(df, **settings):
    return [(r["session_used"], r["level"], r["budget"]) for r in budget.budget_replay(df, Settings(**settings)).orderBy("seq").collect()]


def test_budgets_count_the_request_itself(spark):
    # 30 000 used, and a request of 30 000 with 2 000 expected
    assert replay(spent(spark, [30_000, 30_000])) == [(0, "ok", None), (30_000, "over", "session")]
    assert replay(spent(spark, [38_000])) == [(0, "warn", "session")] and replay(spent(spark, [48_000])) == [(0, "over", "session")]
    assert replay(spent(spark, [48_000]), daily_budget=50_000) == [(0, "over", "session")] and replay(spent(spark, [48_000]), session_budget=10**6, daily_budget=50_000) == [(0, "over", "daily")]
    assert [x[0] for x in replay(spent(spark, [30_000, 10_000, 10_000], resets=(1,)))] == [0, 0, 10_000]
    blocked = budget.budget_replay(spent(spark, [30_000, 30_000, 10_000]), Settings(hard_block=True)).orderBy("seq").collect()
    assert [(r["session_used"], r["blocked"]) for r in blocked] == [(0, False), (30_000, True), (30_000, False)]


def test_running_sums_over_blocks_are_plain_running_sums(spark):
    df = spark.createDataFrame([("k", i * 7, i) for i in range(200)], "k string, seq long, v long")
    got = [r["before"] for r in budget.running_before(df, ["k"], "seq", F.col("v"), "before", 50).orderBy("seq").collect()]
    assert got == [sum(range(i)) for i in range(200)]


PROMPTS = "session_id long, seq long, prompt string, model string, context_tokens long, ref_count long, ref_ids array<string>, asked_at long, project string"


def findings(spark, said, **settings):
    s = Settings(**settings)
    df = spark.createDataFrame([(1, i, p.get("prompt", "x"), p.get("model", "gpt-4o-mini"), p.get("context", 10), p.get("refs", 0), p.get("ids", []), p.get("at", i), "w") if "session" not in p else (p["session"], i, p["prompt"], "gpt-4o-mini", 10, 0, [], p["at"], "w") for i, p in enumerate(said)], PROMPTS)
    out = rules.evaluate_rules(df, duplicates.session_duplicates(df, s), duplicates.history_duplicates(df, duplicates.build_prompt_index(df, None), s), s)
    return [[f["rule"] for f in r["findings"]] for r in out.orderBy("seq").collect()]


def test_rules(spark):
    said = [
        {"prompt": "plain", "refs": 9, "ids": ["a", "The Workspace"]}, {"prompt": "other", "refs": 6}, {"prompt": "third", "context": 5_000}, {"prompt": "write it in <20 lines"}, {"prompt": "write it, be concise"}, {"prompt": "write x<20 lines"},
        {"prompt": "/src/a.py look"}, {"prompt": "mail a@b.cc"}, {"prompt": "hello", "model": "claude-opus-4"}, {"prompt": "debug the thing", "model": "sonnet"}, {"prompt": "rename the thing", "model": "sonnet", "context": 1000}, {"prompt": "hm", "model": "unheard-of"},
    ]
    got = findings(spark, said, sensitive_patterns=("(?i)A@B", "(broken"))
    assert got[:8] == [["whole_workspace"], ["many_references"], ["snowball"], ["no_cap"], [], [], ["cache_order"], ["sensitive"]]
    assert got[8] == ["overkill", "reasoning"] and got[9] == [] and got[10] == ["overkill"] and "unknown_price" in got[11]
    assert findings(spark, said[7:8]) == [[]]
    assert findings(spark, said[1:3], max_refs=3, snowball_tokens=10_000) == [["many_references"], []]


def test_repeats_of_prompts(spark):
    long = "please sort all these very long words here now"
    said = [{"prompt": long}, {"prompt": long.upper() + "!", "context": 9_000}, {"prompt": long + " again", "context": 9_010}, {"session": 2, "prompt": long + " today", "at": 50}]
    # the second is skipped, so the third grows from the first's context
    assert findings(spark, said) == [[], ["duplicate", "snowball"], ["duplicate", "snowball"], ["asked_before"]]
    assert findings(spark, said, block_duplicates=False)[2] == ["duplicate"]
    assert findings(spark, said, dup_threshold=0.99)[2] == ["asked_before", "snowball"]
    earlier = spark.createDataFrame([(2, 0, long, "m", 1, 0, [], 5, "w")], PROMPTS)
    assert duplicates.history_duplicates(earlier, duplicates.build_prompt_index(earlier, None)).count() == 0  # not its own past


def test_near_sets_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    base = [[f"w{rng.randrange(30)}" for _ in range(12)] for _ in range(6)]
    said = [(i % 3, i, " ".join(w if rng.random() > 0.08 else f"z{rng.randrange(9)}" for w in rng.choice(base))) for i in range(90)]
    df = spark.createDataFrame(said, "session_id long, seq long, prompt string")
    got = {r["seq"]: round(r["similarity"], 9) for r in duplicates.session_duplicates(df, Settings(dup_threshold=0.7)).collect()}
    sets, want = {i: set(t.split()) for _, i, t in said}, {}
    for s, i, _ in said:
        best = max((len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for q, j, _ in said if q == s and j < i), default=0)
        if best >= 0.7:
            want[i] = round(best, 9)
    assert got == want


def test_edit_verdicts(spark):
    ops = [("e", "create", "/ws/app/gone.py", f"q{i}") for i in range(4)] + [("e", "edit", "/ws/app/busy.py", f"q{i}") for i in range(3)] + [("e", "edit", "/ws/app/quiet.py", ""), ("e", "edit", "/ws/application/x.py", "q1"), ("e", "edit", "/WS/app/lost.py", "q2")]
    df = spark.createDataFrame(ops, "session_id string, type string, fs_path string, request_id string")
    known = spark.createDataFrame([("q0", "gpt-4o-mini"), ("q1", "GPT-4o")], "request_id string, model string")
    there = spark.createDataFrame([("/ws/app/busy.py",), ("/ws/app/quiet.py",)], "fs_path string")
    files = roi.edit_roi_files(df, known, there, "\\ws\\App\\")
    assert {r["fs_path"]: (r["verdict"], r["iterations"]) for r in files.collect()} == {"/ws/app/gone.py": ("discarded", 4), "/ws/app/busy.py": ("rework", 3), "/ws/app/quiet.py": ("kept", 1), "/WS/app/lost.py": ("pending", 1)}
    costs = spark.createDataFrame([("gpt-4o-mini", 0.1, 5), ("gpt-4o", 1.0, 2)], "model string, avg_cost double, ordinal long")
    got = roi.model_roi(files, costs).collect()  # one row a model, priced by the first fitting one
    assert [(r["model"], r["iterations"], r["est_cost"]) for r in got] == [("GPT-4o", 7, 7.0), ("gpt-4o-mini", 7, 7.0)]


def test_context_jobs(spark):
    said = [(1, 0, "tool_result", "a" * 501), (1, 1, "tool_result", "b" * 500), (1, 2, "text", "t"), (1, 3, "tool_result", "c" * 900), (1, 4, "tool_result", "d" * 900), (2, 0, "tool_result", "e" * 900)]
    df = spark.createDataFrame(said, "conv_id long, turn long, kind string, text string")
    cut = lambda **s: [(r["chars_saved"]) for r in context.compact_context(df, Settings(**s)).orderBy("conv_id", "turn").collect()]
    assert cut() == [0] * 6 and cut(max_context_tokens=300) == [101, 0, 0, 0, 0, 0] and cut(max_context_tokens=300, enable_compaction=False) == [0] * 6
    capped = context.cap_tool_results(df, Settings(max_tool_result_chars=500)).orderBy("conv_id", "turn").collect()
    assert capped[0]["text"] == "a" * 500 + "\n…[truncated: 1 characters left out]" and capped[1]["text"] == "b" * 500
    assert [r["context_tokens"] for r in context.conversation_context(df).orderBy("conv_id", "turn").collect()] == [126, 251, 251, 476, 701, 225]
    tools = spark.createDataFrame([(i, "red bolt" if i == 7 else "x", None, "schema") for i in range(9)], "ordinal long, name string, description string, input_schema string")
    ask = spark.createDataFrame([(1, 0, "A red, RED bolt"), (1, 1, "zz")], "session_id long, seq long, prompt string")
    tiers = lambda n, local=0: {r["seq"]: (r["kept_ids"], r["tokens_saved"]) for r in context.tier_tools(ask, tools, Settings(max_tools=n), local).collect()}
    assert tiers(3) == {0: ([0, 1, 7], 11), 1: ([0, 1, 2], 13)} and tiers(4, 1) == tiers(3) and tiers(64)[1] == (list(range(9)), 0)
    files = spark.createDataFrame([("a/b.py", "One\r\ntwo (x)"), ("a/c/d.py", "(X) é" * 60), ("big.py", "(x)" * 90_000), ("n.py", None)], "path string, content string")
    assert [(r["path"], r["line"], len(r["text"])) for r in context.corpus_grep(files, "(x)").collect()] == [("a/b.py", 2, 7), ("a/c/d.py", 1, 200)]
    assert context.corpus_grep(files, "^o.e$", True).first()["line"] == 1 and context.corpus_grep(files, "(x)", glob="a/*.py").count() == 1
    assert [r["path"] for r in context.corpus_find(files, "**/*.{py,js}", ("a/c/**",)).collect()] == ["a/b.py", "big.py", "n.py"]


def test_chat_sessions(spark, tmp_path):
    folder = tmp_path / "w1" / "chatSessions"
    folder.mkdir(parents=True)
    (folder / "s1.jsonl").write_text('\n{"v": {"customTitle": "One", "requests": [{"modelId": "v/m ", "timestamp": 0, "message": "hi", "result": {"metadata": {"promptTokens": null}}}, {"message": {"text": "no"}, "result": {"metadata": {}}}]}}\nnot json\n{"v": {"customTitle": "Two", "requests": [{"message": {"text": "yo"}, "result": {"metadata": {"promptTokens": "12", "outputTokens": 5, "resolvedModel": "r", "responseId": "x"}}}]}}\n')
    raw = readers.read_chat_sessions(spark, str(tmp_path))
    got = readers.extract_turns(raw).orderBy("seq").collect()
    assert [(r["model"], r["input_tokens"], r["output_tokens"], r["snippet"], r["ts"]) for r in got] == [("m", 0, 0, "hi", None), ("r", 0, 5, "yo", None)]
    assert readers.session_titles(raw).first()["title"] == "Two" and readers.prompt_history(raw).count() == 3
    whole = spark.read.text(str(folder), wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    assert readers.bad_lines(whole).first()["bad"] == 1


def test_agent_store_files(spark, tmp_path):
    for name, broken in (("s1", False), ("s2", True)):
        (tmp_path / name).mkdir()
        if broken:
            (tmp_path / name / "session.db").write_bytes(b"no database")
            continue
        db = sqlite3.connect(tmp_path / name / "session.db")
        db.execute("CREATE TABLE turn_usage (turn_id TEXT, usage TEXT)")
        db.execute("CREATE TABLE session_metadata (key TEXT, value TEXT)")
        db.executemany("INSERT INTO turn_usage VALUES (?, ?)", [("", '{"inputTokens": 5, "cacheReadTokens": 9, "model": "v/m"}')] * 2 + [("a", '{"inputTokens": "7", "outputTokens": 0}'), ("b", ""), ("c", "{bad"), ("d", '{"outputTokens": 1}')])
        db.executemany("INSERT INTO session_metadata VALUES (?, ?)", [("copilot.workingDirectories", '["/w/x"]'), ("copilot.workingDirectory", "/y")])
        db.commit()
        db.close()
    store = readers.read_agent_store(spark, str(tmp_path))
    assert {(r["session_id"], r["kind"]) for r in store.collect()} == {("s1", "turn_usage"), ("s1", "session_metadata"), ("s2", "corrupt")}
    assert sorted((r["response_id"], r["model"], r["input_tokens"], r["output_tokens"], r["cache_read_tokens"]) for r in readers.agent_turns(store).collect()) == [("d", "unknown", 0, 1, None), ("s1:turn:0", "m", 5, 0, 9), ("s1:turn:1", "m", 5, 0, 9)]
    assert readers.working_dirs(store).first()["working_dir"] == "/w/x" and readers.agent_titles(store).where("session_id = 's1'").first()["title"] == "(agent session)"


def test_other_files(spark, tmp_path):
    for name, text in (("h1/workspace.json", '{"folder": "file:///w/My%20App/"}'), ("h2/workspace.json", "{"), ("e1/state.json", '{"timeline": {"operations": [{"uri": {"fsPath": "/a"}}, {"type": "create", "requestId": "q", "uri": {}}]}}'), ("e2/state.json", "oops"), ("t/a.json", '{"requests": [{"requestId": "q", "modelId": "v/m"}, {"requestId": "r", "modelId": ""}]}'), ("t/b.json", '{"requests": [{"requestId": "q", "modelId": "v/n"}]}')):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {tuple(r) for r in readers.read_workspaces(spark, str(tmp_path)).collect()} == {("h1", "My App"), ("h2", "unknown")}
    assert [tuple(r) for r in readers.read_edit_ops(spark, str(tmp_path)).collect()] == [("e1", "edit", "/a", "")]
    assert [tuple(r) for r in readers.read_request_models(spark, str(tmp_path / "t")).collect()] == [("q", "n")]


def test_scope_of_open_folders(spark):
    sessions = spark.createDataFrame([(1, "/W/a/"), (2, "/w/b")], "id long, working_dir string")
    folders = lambda *x: spark.createDataFrame([(u,) for u in x], "uri string")
    ids = lambda f: sorted(r["id"] for r in turns.scope_open_folders(sessions, f).collect())
    assert ids(folders("/w/%61")) == [1] and ids(folders()) == [1, 2] and ids(folders("/q")) == []


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id")
    for k in range(3):
        events.where(f"event_id % 3 = {k}" if k else "event_id % 3 = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = jobs._turns(spark, str(tmp_path))
    got = jobs.run_to_table(jobs.stream_daily(stream), "update", ["day", "model"]).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    assert rows(got) == rows(con.execute(jobs.ORACLES["stream_daily"]).df())


def test_tables_are_refreshed_by_batch_number(spark):
    reads = []
    table = jobs.refreshed(lambda x: reads.append(1) or x.range(1), 25)
    for n in range(30):
        table(spark, n)
    assert len(reads) == 2


def test_records_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1), "m", 1, 2, 0.1234565, "s", 1)], "ts timestamp, model string, input_tokens long, output_tokens long, cost_usd double, session_id string, turn_index long")
    line = sinks.usage_records(df, "p").first()["value"]
    assert '"p.suggested_cheaper_model":null' in line and '"timestamp":"2024-01-01T00:00:00.000Z"' in line
    sinks.write_usage_log(df, str(tmp_path / "log"), "p")
    sinks.write_usage_log(df, str(tmp_path / "log"), "p")
    assert readers.read_usage_log(spark, str(tmp_path / "log"), "p").count() == 2
