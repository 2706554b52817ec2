"""The operators' methods held against plain versions: suffix sort, tiles, templates, neighbour graph, language models, convolution."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tokenledger.llm import html_text, jaccard, language_id, neighbours, substring_dedup, toxicity


@pytest.mark.parametrize("collide", [False, True])
def test_suffixes_are_sorted_and_verified(monkeypatch, collide):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    data[200:300] = data[:100]
    at, key = rng.integers(0, 399, 60), rng.integers(0, 3, 60)
    size = np.minimum(rng.integers(1, 120, 60), 400 - at)
    if collide:  # every span has the hash of any other
        monkeypatch.setattr(substring_dedup.Spans, "hash", lambda self, a, b: np.zeros(len(a), np.uint64))
    s = substring_dedup.Suffixes(data, substring_dedup.Spans(data), at, size, key, 1)
    said = [data[a : a + n].tobytes() for a, n in zip(at, size, strict=True)]
    assert [(key[i], said[i]) for i in s.order] == sorted((k, x) for k, x in zip(key, said, strict=True))
    for k in range(1, 60):
        i, j = s.order[k - 1], s.order[k]
        n = next((x for x in range(min(size[i], size[j])) if said[i][x] != said[j][x]), min(size[i], size[j])) if key[i] == key[j] else 0
        assert s.common[k] == n


def test_windows_of_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 5)
    rng, size = random.Random(9), 40
    word = lambda: "".join(rng.choice("abc") for _ in range(9))
    core = "".join(word() for _ in range(4))
    texts = [word() * rng.randint(0, 1) + core + rng.choice(["x", "yz", ""]) + word() for _ in range(30)]
    seen = Counter(t[j : j + size] for t in texts for j in range(len(t) - size + 1))
    want = {}
    for i, t in enumerate(texts):
        gone = set()
        for j in range(len(t) - size + 1):
            if seen[t[j : j + size]] > 1:
                gone |= set(range(j, j + size))
        want[i] = len(gone)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs, size).collect()} == want


def test_linked_sets_share_a_tile():
    rng = np.random.default_rng(1)
    for percent in (60, 80, 90):
        for _ in range(300):
            n = int(rng.integers(1, 120))
            more = int(n * 100 / percent) - n
            mine = int(rng.integers(0, more + 1))
            draw = lambda k: rng.integers(1, 2**63, k, dtype=np.uint64)
            common = draw(n)
            a, b = (np.unique(np.concatenate([common, draw(k)])) for k in (mine, more - mine))
            key, which = jaccard.tile_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
            assert set(key[which == 0]) & set(key[which == 1])


def test_bitmaps_never_rule_out_a_link():

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in rng.integers(1, 300, 40)]
    maps = jaccard._Bitmaps(pa.array([jaccard.bitmap(x) for x in sets], pa.binary()), np.array([len(x) for x in sets]))
    i, j = np.nonzero(np.ones((40, 40)))
    assert (maps.most(i, j) >= [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]).all()


def test_tiles_above_a_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "ROWS", 3)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(40)] = f"z{rng.randrange(1000)}"
        texts.append(" ".join(w[: rng.randint(34, 40)]))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    name = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    name[a] = name[b] = min(name[a], name[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["component_id"] for r in jaccard.jaccard_components(docs, 3, 80).orderBy("doc_id").collect()] == name


@pytest.mark.parametrize("cut", [1, 2, 3, 50])
def test_shared_keys_over_batches(cut):
    rng = random.Random(cut)
    rows = sorted((rng.randrange(12), rng.randrange(4)) for _ in range(40))
    hot = {3, 5}
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64()), pa.array([k in hot for k, _ in part], pa.bool_())], ["key", "node", "hot"]) for part in (rows[i : i + cut] for i in range(0, len(rows), cut))]
    got = [(r["key"], r["node"]) for b in jaccard._shared(iter(batches)) for r in b.to_pylist()]
    nodes = {k: {n for j, n in rows if j == k} for k, _ in rows}
    assert got == [(k, n) for k in sorted(nodes) for n in sorted(nodes[k]) if len(nodes[k]) > 1 or k in hot]


@pytest.mark.parametrize("least", [2, 1_000])
def test_tiles_with_and_without_hot_keys(spark, monkeypatch, least):
    monkeypatch.setattr(jaccard, "HOT_SAMPLE", 2)
    monkeypatch.setattr(jaccard, "HOT_LEAST", least)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[: i % 50], f"z{i}", *base[i % 50 + 1 :]]) for i in range(40)] * 2 + ["", None, "other words alone"]
    keys, nodes = [], []
    for t in {t for t in texts if t}:
        data = np.frombuffer(t.encode(), np.uint8)
        h, at = jaccard.shingle_sets(data, np.array([0, len(data)]), 3)
        key, _ = jaccard.tile_keys(h, at, 80)
        keys += key.tolist()
        nodes += [int(jaccard._group_sums(h, at)[0])] * len(key)
    held = {}
    for k, n in zip(keys, nodes, strict=True):
        held.setdefault(k, set()).add(n)
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = sorted(tuple(r) for r in jaccard.shared_keys(frame, 3, 80).collect())
    assert got == sorted((k, n) for k, s in held.items() if len(s) > 1 for n in s)


def site(body, n=12, host="h"):
    return [(i, f"http://{host}/{i}", f"<body>{body(i)}</body>") for i in range(n)]


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def main_texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html_text.extract(pages_frame(spark, rows)).collect()}


def test_classes_are_tokens_of_one_occurrence_vector(spark):
    def body(i):
        rows = "".join(f"<li>{i} {k}</li>" for k in range(1 + i % 3))
        return f'<div id="post-{i}" class=top><ul>{rows}</ul></div><div class="story"><p>long text of page {i} {"x" * 80}</p><noscript>kept</noscript><div class="related-work">also</div><div class="share-buttons">no</div></div><p>Same</p>'

    rows = site(body)
    tokens, classes = html_text.classes_of(pages_frame(spark, [*rows, (99, "http://h/copy", rows[3][2])]))  # a copy is no further page
    vectors: dict = {}
    for i, _, text in rows:
        for token, n in Counter(html_text.Page(text).tokens()).items():
            vectors.setdefault(token, [0] * 12)[i] = n
    want, got = {}, {}
    for token, vector in vectors.items():
        want.setdefault(tuple(vector), set()).add(token)
    for r in tokens.collect():
        got.setdefault(r["class"], set()).add((r["path"], r["token"]))
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))
    assert {(r["members"], r["support"], r["pages"]) for r in classes.collect()} == {(len(v), sum(map(bool, k)), 12) for k, v in want.items()}
    # what each page says inside the slot is the template's
    assert main_texts(spark, rows)[3] == f"long text of page 3 {'x' * 80}"


def test_all_slots_and_nothing_of_the_template(spark):
    said = lambda i, part: f"{part} of page {i}: " + " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(40 + i % 5))
    menu = lambda i: '<div class="x1"><a>Home</a><p>All about us</p></div>'
    two = site(lambda i: f'{menu(i)}<div class="wrap"><div class="pa"><p>{said(i, "first")}</p><p>Read on below.</p></div><div class="teaser"><p>t{i}</p></div><div class="pb"><p>{said(i, "second")}</p></div></div><div class="end"><p>Made by us</p></div>')
    got = main_texts(spark, two)
    assert all(got[i] == f"{said(i, 'first')}\n\n{said(i, 'second')}" for i in range(12))
    # the same pages by themselves: no template, so that all is taken
    alone = main_texts(spark, [(i, f"http://h{i}/", text) for i, _, text in two])
    assert sum(alone[i] != got[i] for i in range(12)) == 12
    # an own text between the slots of a wrapper keeps the wrapper whole
    own = site(lambda i: f'{menu(i)}<div class="wrap"><p>{said(i, "lead")}</p><div class="pa"><p>{said(i, "first")}</p></div></div>')
    assert all(t == f"{said(i, 'lead')}\n\n{said(i, 'first')}" for i, t in main_texts(spark, own).items())
    # pages that are copies but for a number keep their text
    near = site(lambda i: f'{menu(i)}<div class="pa"><p>{said(1, "first")}</p><p>{said(2, "second")}</p><p>No. {i}</p></div>')
    assert all(t == f"{said(1, 'first')}\n\n{said(2, 'second')}\n\nNo. {i}" for i, t in main_texts(spark, near).items())
    # article elements: the template takes its own lines out, and brings in the slot beside
    tagged = site(lambda i: f'<article><p>{said(i, "first")}</p><p>Share this with friends</p></article><div class="more"><p>{said(i, "second")}</p></div>')
    assert all(t == f"{said(i, 'first')}\n\n{said(i, 'second')}" for i, t in main_texts(spark, tagged).items())


def test_classes_that_do_not_nest_are_no_template(spark):
    a, b = '<div class="a1"></div>', '<div class="b1"></div>'
    mixed = lambda i: (a + b if i % 4 else b + a) + f'<div class="s"><p>words of page {i} {"y" * 60}</p></div>'
    rows = site(mixed)
    pages = pages_frame(spark, rows)
    own = {p for p in html_text.Page(rows[0][2]).path}
    found, n = html_text.templates(pages)
    assert n == 0 and found.count() == 0 and own  # one class, in two orders
    # two classes, of which one goes on behind the other's start
    crossed = lambda i: '<i class="ka"></i>' + ('<i class="ma"></i>' if i % 3 else "") + '<i class="kb"></i>' + ('<i class="mb"></i>' if i % 3 else "") + f'<div class="s"><p>words of page {i} {"y" * 60}</p></div>'
    rows = site(crossed)
    found, n = html_text.templates(pages_frame(spark, rows))
    tokens, classes = html_text.classes_of(pages_frame(spark, rows))
    whole = classes.where("support = 12").first()["members"]
    assert n == whole and {r["members"] for r in classes.where("support = 8").collect()} == {2}
    assert html_text.extract(pages.where("false")).count() == 0


def test_neighbours_over_several_leaves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 60)
    monkeypatch.setattr(neighbours, "BLOCK", 90)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16))
    x[::100] *= 3_000
    x[50:60] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2_000, [1.0, 2.0])]  # a shorter vector
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 10).toPandas()
    x = np.concatenate([x, [[1.0, 2.0] + [0.0] * 14]])
    ids = np.append(np.arange(900), 2_000)
    hit = total = 0
    for q, part in got.groupby("query_id"):
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:10]])
        hit, total = hit + len(best & set(part["vec_id"])), total + 10
    assert got["query_id"].nunique() == 46 and hit / total >= 0.95
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.nearest(empty).count() == 0


def test_kneser_ney_by_dictionary():
    model = language_id.fit({"a": ["abcabca"], "b": ["xyzxyz"]})
    grams = lambda text, k: [tuple(text[i : i + k]) for i in range(len(text) - k + 1)]
    text = [32] * 3 + [ord(c) for c in "abcabca"] + [32] * 3
    def p(run):  # noqa: E306
        k = len(run)
        counts = Counter(grams(text, k)) if k == 4 else Counter(g[1:] for g in set(grams(text, k + 1)) if True)
        if k < 4:  # continuation counts come from the distinct runs one longer
            longer = set(grams(text, 4))
            for _ in range(4 - k):
                counts = Counter(g[1:] for g in longer)
                longer = set(counts)
        low = p(run[1:]) if k > 1 else language_id.UNKNOWN
        total = sum(n for g, n in counts.items() if g[:-1] == run[:-1])
        if not total:
            return low
        kinds = sum(g[:-1] == run[:-1] for g in counts)
        return (max(counts[run] - 0.75, 0) + 0.75 * kinds * low) / total
    run = tuple(ord(c) for c in "abca")
    h = language_id._rows(np.array([run], np.uint64))[0]
    u, logs = model["orders"][3]
    assert logs[np.searchsorted(u, h), 0] == pytest.approx(np.log2(p(run)), abs=1e-5)
    for text, empty in (("١٢٣ १२", True), ("ℂ 𠀀", False), ("", True), ("naïve", False)):
        assert (len(language_id._chars(text)) == 0) is empty
    long = "abc, def! " * 50_000
    whole, blocks = language_id.entropies(model, long, 1 << 30), language_id.entropies(model, long, 999)
    assert whole[1] == blocks[1] and np.allclose(whole[0], blocks[0])


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.train(docs)).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in got} == {("und", 0.0, True)}
    assert language_id.identify(docs.where("false"), language_id.train(docs)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity(docs, toxicity.train(docs, labels)).collect()] == [0.0, 0.0]


def test_convolution_by_loops():
    rng = np.random.default_rng(5)
    data = np.frombuffer(b"one two three four", np.uint8)
    ids, at = toxicity.tokens(data, np.array([0, len(data)]))
    model = {"embed": rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), "kernels": [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], "biases": [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS], "out": rng.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32), "bias": np.zeros(1, np.float32)}
    model["embed"][0] = 0
    vectors = [model["embed"][a] + model["embed"][b] for a, b in ids] + [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
    pooled = []
    for w, kernel, bias in zip(toxicity.WIDTHS, model["kernels"], model["biases"], strict=True):
        for f in range(toxicity.FILTERS):
            best = max(sum(vectors[i + j] @ kernel[j][:, f] for j in range(w) if i + j < len(vectors)) for i in range(len(vectors)))
            pooled.append(max(best + bias[f], 0))
    want = 1 / (1 + np.exp(-(np.array(pooled) @ model["out"])))
    assert toxicity.score(model, ids, at)[0] == pytest.approx(want, abs=1e-4)
    assert toxicity.score(model, ids, at, toxicity._tables(model))[0] == pytest.approx(want, abs=1e-4)
