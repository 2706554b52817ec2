"""The corpus pipeline's stages: what goes, what stays, repeated rows, clashing columns, empty tables."""

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score double, n_lines long, size long, t string"
ALPHABETS = {"xx": "abcd", "yy": "efgh"}


def docs(spark, texts):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5, 7, 9, "t") for i, (t, lang) in enumerate(texts)], SCHEMA)


def say(i, lang, n=40):
    a = ALPHABETS[lang]
    return " ".join("".join(a[(i * 7 + k * k + j * (k + i)) % 4] for j in range(5 + k % 3)) for k in range(n))


def test_stages(spark, tmp_path):
    texts = [(say(i, "xx" if i % 2 else "yy"), "xx" if i % 2 else "yy") for i in range(40)]
    texts += [(None, "xx"), ("123", None), (texts[3][0] + " abcda", "xx"), (texts[5][0] + "\n" + say(99, "xx", 20), "xx"), (say(98, "yy", 12) + " " + say(50, "yy", 30), "yy")]
    frame = docs(spark, texts)
    frame = frame.unionByName(frame.where("doc_id = 7"))
    columns = frame.columns
    bench = tmp_path / "benchmark.parquet"
    spark.createDataFrame([(1, say(98, "yy", 12))], "item_id long, text string").write.parquet(str(bench))

    kept = pipeline.language(spark, frame, str(tmp_path))
    assert kept.columns == columns and sorted({r["doc_id"] for r in kept.collect()} ^ set(range(45))) == [40, 41]
    kept = pipeline.lines(spark, kept, str(tmp_path))
    assert kept.columns == columns
    by_id = {r["doc_id"]: r for r in kept.collect()}
    assert by_id[43]["text"] == say(99, "xx", 20) and by_id[43]["n_chars"] == len(by_id[43]["text"]) and by_id[43]["n_lines"] == 7
    kept = pipeline.near_duplicates(spark, kept, str(tmp_path))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == columns and ids.count(7) == 1 and 42 not in ids and 3 in ids and set(range(40)) <= set(ids)
    kept = pipeline.clean(spark, kept, str(tmp_path))
    assert kept.columns == columns and 44 not in [r["doc_id"] for r in kept.collect()]
    mixed = pipeline.mix(spark, kept, str(tmp_path))
    rows = mixed.collect()
    assert {"text", "copies", "taken"} <= set(mixed.columns) and all(r["copies"] > 0 and r["taken"] == r["copies"] * r["size"] for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)


def test_equal_ids_of_different_texts_stay(spark, tmp_path):
    one, other = say(1, "xx"), say(2, "xx")
    frame = docs(spark, [(one, "xx"), (one + " abcd", "xx"), (other, "xx")]).withColumn("doc_id", __import__("pyspark").sql.functions.expr("CASE WHEN doc_id = 2 THEN 1 ELSE doc_id END"))
    got = pipeline.near_duplicates(spark, frame, str(tmp_path))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(0, one), (1, other)]


def test_empty_tables(spark, tmp_path):
    none = docs(spark, [("x", "xx")]).where("false")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
