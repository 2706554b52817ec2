"""Training-data operators against brute force on small inputs with nulls, empty texts, ties and repeated rows."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tokenledger.llm import decontamination, html_text, jaccard, language_id, line_dedup, mixing, neighbours, substring_dedup, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n string"


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, "extra") for i, t in enumerate(texts)], SCHEMA)


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("bits", [64, 0])  # 0: all runs of windows have the hashes of any other
def test_substring_dedup(spark, bits):
    rng = random.Random(3)
    shared = [words(rng, 30) for _ in range(4)]
    texts = [None, "", "é" * 70, "ab" * 60] + [" ".join(rng.choice([*shared, words(rng, 20, 999)]) for _ in range(3)) for _ in range(40)]
    size = 60
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[j : j + size] for b in data for j in range(len(b) - size + 1))
    for row in substring_dedup.remove_repeats(frame(spark, texts), size, bits).collect():
        b = data[row["doc_id"]]
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if seen[b[j : j + size]] > 1:
                gone[j : j + size] = b"\1" * size
        assert (row["n_bytes"], row["n_removed"]) == (len(b), sum(gone))
        assert row["n_spans"] == sum(x and not (j and gone[j - 1]) for j, x in enumerate(gone))
        assert row["kept_sha256"] == hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()
    assert substring_dedup.remove_repeats(frame(spark, ["x" * 50]).where("false"), size).count() == 0
    twice = frame(spark, ["q" + words(rng, 30, 999)])
    assert {r["n_removed"] == r["n_bytes"] for r in substring_dedup.remove_repeats(twice.union(twice), size, bits).collect()} == {True}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_dedup(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdé ü") for _ in range(rng.randint(5, 25))) for _ in range(20)]

    def edited():
        line = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(line))
            line[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        return "".join(line)

    texts = [None, "", "\n\n"] + ["\n".join(edited() for _ in range(rng.randint(0, 5))) for _ in range(50)]
    first, lines = {}, []
    expect = {}
    for i, t in enumerate(texts):
        kept = []
        for p, line in enumerate(t.split("\n") if t is not None else []):
            key = line.strip(" ")
            if len(key) < 8:
                kept.append(line)
                continue
            if key not in first:
                first[key] = (any(distance(key, x) <= 2 for x in lines), (i, p))
                lines.append(key)
            if not first[key][0] and first[key][1] == (i, p):
                kept.append(line)
        expect[i] = hashlib.sha256("\n".join(kept).encode()).hexdigest()
    got = line_dedup.dedup_lines(frame(spark, texts), 8, 2, keep=["lang", "n"]).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in got} == expect
    assert {r["n"] for r in got} == {"extra"}


def test_short_lines_are_removed_as_exact_repeats(spark):
    texts = ["All rights reserved.\n\n}\nTh.", " All rights reserved. \n\n}\nWh.\nThis line has thirty letters..", "All right reserved.\n}\nThis line had thirty letters.."]
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_near"]) for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert got == {0: (texts[0], 0, 0), 1: ("\nWh.\nThis line has thirty letters..", 2, 0), 2: ("All right reserved.", 2, 1)}


def test_letters_are_counted_only_of_lines_that_meet(spark, monkeypatch):
    """Of 40 lines without a common segment and two near ones, letters of the two alone are counted."""
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefghij") for _ in range(40)) for _ in range(40)]
    texts = ["\n".join(lines[:25]), "\n".join(lines[25:]), lines[7][:20] + "zz" + lines[7][22:]]
    counted, save = [], line_dedup.save

    def seen(df, name):
        out = save(df, name)
        counted.append(out.where("counts IS NOT NULL").count() if "counts" in out.columns else 0)
        return out

    monkeypatch.setattr(line_dedup, "save", seen)
    assert {r["doc_id"]: r["n_near"] for r in line_dedup.dedup_lines(frame(spark, texts)).collect()} == {0: 0, 1: 0, 2: 1}
    assert sum(counted) == 2


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (2, 60)])
def test_jaccard_components(spark, width, percent):
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 60)).split() for _ in range(8)]
    texts = [None, "", " \t", "One", "one", "two words", "TWO words"]
    for _ in range(80):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    got = jaccard.jaccard_components(frame(spark, texts), width, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(0, words(rng, 25)), (1, "Alpha beta gamma"), (2, None), (3, ""), (None, words(rng, 12, 999))]
    texts = [None, "", "x alpha, BETA; gamma y alpha beta", words(rng, 5) + " " + items[0][1][30:] + " end", items[0][1].upper(), words(rng, 40), "alpha beta"]
    grams = {}
    for key, t in items:
        w = (t or "").lower().split()
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(key)
    expect = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().replace(",", "").replace(";", "").split()
        hit, ids = set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in grams:
                    hit |= set(range(s, s + n))
                    ids |= {str(x) for x in grams[tuple(w[s : s + n])] if x is not None}
        expect[i] = (len(w), len(hit), ",".join(sorted(ids)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts)
    got = decontamination.contamination(docs.union(docs), bench).collect()
    assert len(got) == 2 * len(texts)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got} == expect
    assert decontamination.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.choice([0, 3, 10, 40])), "en", rng.choice(["a", "b", "c", None, "a", "a"]), "x") for i in range(2_000)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None)], SCHEMA)
    got = mixing.mix_sources(docs).toPandas()
    again = mixing.mix_sources(docs.repartition(7)).toPandas()
    assert len(got) == len(rows) + 1 and (got["taken"] <= 3 * got["size"]).all()
    assert sorted(map(repr, got[["doc_id", "taken"]].values.tolist())) == sorted(map(repr, again[["doc_id", "taken"]].values.tolist()))
    got["source"] = got["source"].fillna("~")
    for source, part in got.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 0.05 * part["target"].iloc[0] + 40, source
    assert mixing.mix_sources(docs.where("false")).count() == 0


def test_caps_are_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 0)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 0
    assert got["b"] / got["c"] == pytest.approx(2) and sum(got.values()) == pytest.approx(210)


def test_arc_to_warc_round_trip(spark, tmp_path):
    for version in (1, 2):
        records = list(warc.read_arc(warc.write_arc([("http://a/", "20010203040506", b"HTTP/1.0 200 OK\r\n\r\nbody\n"), ("http://b/", "2001", b"")], version)))
        assert [r["body"] for r in records] == [b"HTTP/1.0 200 OK\r\n\r\nbody\n", b""]
        fields, block = next(warc.read_warc(warc.to_warc(records[0]) + b"\r\n\r\n"))
        assert fields["warc-date"] == "2001-02-03T04:05:06Z" and block == records[0]["body"]
    with pytest.raises(ValueError, match="cut short"):
        list(warc.read_arc(warc.write_arc([("http://a/", "2001", b"12345")], 1)[:-3]))
    pages = spark.createDataFrame([(3, "http://x/ y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "u", ""), (4, "u", "a\r\n\r\nb")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    got = {r["page_id"]: tuple(r)[1:] for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    e = "<p>é</p>".encode()
    assert got == {1: (len(e), digest(e), "response", None), 3: (len(e), digest(e), "revisit", 1), 2: (0, digest(b""), "response", None), 5: (0, digest(b""), "revisit", 2), 4: (6, digest(b"a\r\n\r\nb"), "response", None)}


def test_main_text(spark):
    page = '<html><head><title>t</title><script>"</p>"</script></head><body><nav>menu</nav><div class="cookie notice">ok</div><article><h1>A &amp; B</h1><p>one <b>two<br>three<p>four\n five</p><form>mail</form><div class="comments"><p>me</p></div></article><footer>end</footer></body></html>'
    bare = "<body><div class=menu>go</div><div id=content><p>text {}</p></div><p>All the same</p></body>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, None, "")] + [(10 + i, f"http://g/{i}", bare.format(i)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "A & B\n\none two three\n\nfour five" and got[2] == got[3] == ""
    assert got[12] == "text 2"


def test_classifiers(spark):
    rng = random.Random(6)
    mark = {"xx": "abcd", "yy": "efgh"}
    rows, labels = [], []
    for i in range(300):
        lang = rng.choice(list(mark))
        text = " ".join("".join(rng.choice(mark[lang]) for _ in range(5)) for _ in range(20))
        toxic = i % 3 == 0
        rows.append((i, text + (" scumbag" if toxic else "") if i else None, lang, "s", "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (999, "123 !?", None, "s", "x")], SCHEMA)
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.train(docs), ["doc_id", "lang"]).collect()}
    assert all(r["lang_pred"] == r["lang"] for k, r in got.items() if k not in (0, 999))
    assert got[0]["lang_pred"] == got[999]["lang_pred"] == "und" and got[999]["rejected"]
    trained = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, trained).collect()}
    assert np.mean([(scores[i] >= 0.5) == bool(y) for i, y in labels[1:]]) > 0.97
    assert set(r["score"] for r in toxicity.toxicity(docs, {"model": None, "thresholds": {}}).collect()) == {0.0}


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (0, x[0].tolist())]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 5).collect()
    for q in range(0, 300, 20):
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        score = x @ x[q]
        best = sorted((j for j in range(300) if j != q), key=lambda j: (-score[j], j))[:5]
        assert [round(float(score[j]), 9) for _, j in mine] == [round(float(score[j]), 9) for j in best]
