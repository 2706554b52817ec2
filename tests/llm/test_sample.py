"""Training samples: bounded in rows and characters, without null ids, one row an id, the same at every run."""

from tokenledger.llm.classify import sample
from tokenledger.llm.language_id import identify, train

SCHEMA = "doc_id long, text string, lang string"


def test_sample(spark):
    rows = [(i, "a" * 10, "en") for i in range(50)] + [(3, "a", "de"), (3, "a", "de"), (None, "b", "en"), (60, "c" * 51, "en"), (61, None, "en")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sample(docs, 100, 1000, 1).collect()
    ids = [r["doc_id"] for r in got]
    assert sorted(ids) == [*range(50), 61]
    assert {r["doc_id"]: r["text"] for r in got}[3] == "a"
    assert [r["doc_id"] for r in sample(docs.repartition(3), 7, 1000, 1).collect()] == ids[:7]
    assert sum(len(r["text"] or "") for r in sample(docs, 100, 205, 1).collect()) <= 205
    assert sample(docs.where("false"), 5, 100, 1).count() == 0
    labels = spark.createDataFrame([(3, 1), (5, 0), (60, 1), (99, 1)], "doc_id long, toxic int")
    assert sorted((r["doc_id"], r["toxic"]) for r in sample(docs, 100, 1000, 1, labels).collect()) == [(3, 1), (5, 0)]


def test_sample_by_language(spark):
    rows = [(i, "a" * 10, "en") for i in range(50)] + [(60, "b" * 10, "de"), (3, "c", "de"), (None, "d", "de")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r["doc_id"], r["lang"]) for r in sample(docs, 4, 1000, 1, by="lang").collect()]
    assert sorted(x for x in got if x[1] == "de") == [(3, "de"), (60, "de")] and len(got) == 6
    assert [(r["doc_id"], r["lang"]) for r in sample(docs.repartition(3), 4, 1000, 1, by="lang").collect()] == got
    assert sorted(r["lang"] for r in sample(docs, 4, 205, 1, by="lang").collect()) == ["de", "de", "en", "en", "en", "en"]


def test_rare_languages_are_learnt(spark):
    rows = [(i, "abcd bcda dabc " * 9, "xx") for i in range(2_000)] + [(5_000 + i, "efgh fghe hefg " * (9 + 90_000 * (i == 3)), "yy") for i in range(8)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = train(docs, 40)
    assert model["langs"] == ["xx", "yy"] and model["limit"]["yy"] < 100
    got = identify(docs.where("doc_id >= 5000"), model).collect()
    assert {(r["lang_pred"], r["rejected"]) for r in got} == {("yy", False)}
