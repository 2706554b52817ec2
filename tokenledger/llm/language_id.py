"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.classify import fold, sample
from tokenledger.llm.common import mix, table

ORDER = 4
#: Training documents and their characters in all, dealt evenly to the languages: each gets TRAIN_ROWS / languages documents
#: (LEAST_ROWS at least) of TRAIN_CHARS / languages characters, whatever its share of the corpus. A quarter of them calibrate
#: the rejection; of a text only the first twentieth of its language's characters is learnt from.
TRAIN_ROWS, LEAST_ROWS = 4_000, 8
TRAIN_CHARS = 12_000_000
DISCOUNT = 0.75
UNKNOWN = 1e-7
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache
def _kinds() -> np.ndarray:
    """For each code point 2 for letters, 1 for marks (accents and vowel signs), else 0, by Unicode category."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def _chars(text: str) -> np.ndarray:
    """Code points, lower case, every run of anything but letters and marks as one space; none if there is no letter."""
    t = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[t]
    if not (kind == 2).any():
        return np.zeros(0, np.uint64)
    out = np.where(kind > 0, t, 32).astype(np.uint64)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep]


def _hashes(c: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the runs of order characters, the run's length included; 0 never comes up."""
    n = len(c) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, order, np.uint64)
    for j in range(order):
        h = mix(h * _STEP + c[j : j + n])
    return h | np.uint64(1)


def _rows(runs: np.ndarray) -> np.ndarray:
    """The hashes of _hashes for runs given one a row."""
    h = np.full(len(runs), runs.shape[1], np.uint64)
    for j in range(runs.shape[1]):
        h = mix(h * _STEP + runs[:, j])
    return h | np.uint64(1)


def _padded(text: str) -> np.ndarray:
    c = _chars(text)
    return np.concatenate([np.full(ORDER - 1, 32, np.uint64), c]) if len(c) else c


def fit(texts: dict[str, list[str]]) -> dict:
    """Model: per order a sorted array of hashes and the log2 probabilities in each language.

    The highest order uses counts, the lower ones how many characters precede a
    run, all with one absolute discount, interpolated down to an even share.
    An n-gram that a language lacks but another has gets its own backed-off
    value, so scoring needs one search for each order.
    """
    langs = sorted(texts)
    if not langs:
        return {"langs": [], "orders": []}
    grams: dict[int, list] = {k: [] for k in range(1, ORDER + 1)}
    per = []
    for lang in langs:
        counts = {}
        streams = [x for x in map(_padded, texts[lang]) if len(x)]
        text = np.concatenate([*streams, np.full(ORDER - 1, 32, np.uint64)]) if streams else np.zeros(0, np.uint64)
        left = None
        for k in range(ORDER, 0, -1):
            n = len(text) - k + 1
            win = np.lib.stride_tricks.sliding_window_view(text, k) if n > 0 else np.zeros((0, k), np.uint64)
            h = _hashes(text, k)
            if k == ORDER:
                u, first, c = np.unique(h, return_index=True, return_counts=True)
            else:  # continuation counts: distinct characters in front, from the distinct runs one longer
                win = left[:, 1:]
                u, first, c = np.unique(_rows(win), return_index=True, return_counts=True)
            runs = np.array(win[first]) if len(u) else np.zeros((0, k), np.uint64)
            counts[k] = (u, c.astype(float), runs)
            left = runs
            grams[k].append((u, runs))
        per.append(counts)
    model = {"langs": langs, "orders": []}
    below: list = [None] * len(langs)  # (hashes, probabilities) of the order below, over the joint arrays
    for k in range(1, ORDER + 1):
        u = np.concatenate([g[0] for g in grams[k]])
        runs = np.concatenate([g[1] for g in grams[k]])
        u, first = np.unique(u, return_index=True)
        runs = runs[first]
        prob = np.zeros((len(u), len(langs)))
        context = _rows(runs[:, :-1]) if k > 1 else np.zeros(len(u), np.uint64)
        ending = _rows(runs[:, 1:]) if k > 1 else None
        for i in range(len(langs)):
            cu, cc, cr = per[i][k]
            own = np.zeros(len(u))
            if len(cu):
                at = np.minimum(np.searchsorted(cu, u), len(cu) - 1)
                own = np.where(cu[at] == u, cc[at], 0)
            if k > 1:
                low_u, low_p = below[i]
                at = np.minimum(np.searchsorted(low_u, ending), len(low_u) - 1)
                low = np.where(low_u[at] == ending, low_p[at], UNKNOWN)
            else:
                low = np.full(len(u), UNKNOWN)
            names, inv = np.unique(context, return_inverse=True)
            total = np.bincount(inv, own, len(names))[inv]
            kinds = np.bincount(inv, own > 0, len(names))[inv]
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(total > 0, (np.maximum(own - DISCOUNT, 0) + DISCOUNT * kinds * low) / total, low)
            prob[:, i] = np.maximum(p, UNKNOWN / 100)
        below = [(u, prob[:, i]) for i in range(len(langs))]
        model["orders"].append((u, np.log2(prob).astype(np.float32)))
    return model


def _blocks(text: str, block: int) -> Iterator[np.ndarray]:
    """The padded characters of a text in blocks, each led by the last ORDER - 1 characters before it."""
    before = np.full(ORDER - 1, 32, np.uint64)
    for at in range(0, len(text), block):
        c = _chars(text[at : at + block])
        c = c[1:] if len(c) and c[0] == before[-1] == 32 and at else c
        if len(c):
            yield np.concatenate([before, c])
            before = np.concatenate([before, c])[-(ORDER - 1) :]


def entropies(model: dict, text: str, block: int = 1 << 17) -> tuple[np.ndarray, int]:
    """Bits a character in each language, and the number of characters; a miss backs off to shorter runs, at a bit's cost."""
    total, n = np.zeros(len(model["langs"])), 0
    for part in _blocks(text, block):
        m = len(part) - ORDER + 1
        n += m
        missing = np.arange(m)
        for k in range(ORDER, 0, -1):
            u, logs = model["orders"][k - 1]
            if not len(missing) or not len(u):
                continue
            h = _hashes(part, k)[missing + ORDER - k]
            pos = np.minimum(np.searchsorted(u, h), len(u) - 1)
            hit = u[pos] == h
            seen = np.bincount(pos[hit], minlength=len(u)) if hit.sum() * 4 > len(u) else None
            total -= seen @ logs if seen is not None else logs[pos[hit]].sum(0)
            total += hit.sum() * (ORDER - k)
            missing = missing[~hit]
        total += len(missing) * (-np.log2(UNKNOWN))
    return total / max(n, 1), n


def train(docs: DataFrame, rows: int = TRAIN_ROWS, seed: int = 7) -> dict:
    """Fit on documents of docs (doc_id, text, lang), rows and TRAIN_CHARS characters in all, and calibrate each language's rejection.

    Each value of lang has its own even part of the sample, by hash rank within
    it (LEAST_ROWS documents at least, if it has so many), so rare languages
    are learnt like frequent ones at every size. A quarter of the sample is held back: a text is rejected if its bits a
    character exceed 1.25 times the largest of the held-back texts of the
    language it looks most like, widened for short texts.
    """
    langs = max(1, docs.where("lang IS NOT NULL").select("lang").distinct().count())
    chars = max(1, TRAIN_CHARS // langs)
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", F.substring("text", 1, max(1, chars // 20)).alias("text"), "lang")
    got = sample(known, max(LEAST_ROWS, rows // langs), chars, seed, by="lang").collect()
    got = [r for r in got if len(_chars(r["text"]))]
    part: dict[str, list[str]] = {}
    for r in got:
        part.setdefault(r["lang"], []).append(r["text"])
    model = fit({k: [t for i, t in enumerate(v) if i % 4 != 3] for k, v in part.items()})
    limit = {}
    for lang, texts in part.items():
        i = model["langs"].index(lang)
        bits = [b[i] for t in texts[3::4] for b, n in [entropies(model, t)] if n >= 40]
        limit[lang] = 1.25 * max(bits) if bits else float("inf")
    return model | {"limit": limit}


def _predict(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    langs = model["langs"]
    for batch in batches:
        pred, score, bits, reject = [], [], [], []
        for value in batch.column(0).field("text"):
            per, n = entropies(model, value.as_py() or "") if langs else (np.zeros(0), 0)
            if not n:
                pred.append("und"), score.append(0.0), bits.append(None), reject.append(True)
                continue
            best = int(per.argmin())
            share = np.exp2(np.maximum((per[best] - per) * n, -1_000))
            pred.append(langs[best]), score.append(float(1 / share.sum())), bits.append(float(per[best]))
            reject.append(bool(per[best] > model["limit"][langs[best]] * (1 + 10 / n)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(reject, pa.bool_())], ["row", "lang_pred", "score", "bits", "rejected"])


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """row (all columns of docs as a struct, so no name can clash), lang_pred, score, bits (a character), rejected.

    Scores are the best language's share of the likelihood of the whole text.
    Null, empty or letterless texts: 'und', score 0, rejected; so are all texts
    if nothing was learnt. Repeated rows: each is returned; lang and source
    are not read. Long texts are scored whole, in blocks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    schema = T.StructType([rows.schema["row"], *T._parse_datatype_string("lang_pred string, score double, bits double, rejected boolean").fields])
    return rows.mapInArrow(lambda it: _predict(it, shared.value), schema)


def identify(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (default doc_id), lang_pred, score, bits, rejected of scored(); keep has none of these names."""
    keep = keep or ["doc_id"]
    out = scored(docs.select(*keep, *([] if "text" in keep else ["text"])), model)
    return out.select(*[F.col("row").getField(k).alias(k) for k in keep], "lang_pred", "score", "bits", "rejected")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learnt from the texts and languages of the folds 1 to 4 of 5."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 5) != 0))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
