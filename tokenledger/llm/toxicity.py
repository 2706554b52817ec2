"""Convolutional text classifier for toxicity: hashed word embeddings, several widths, max pooling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.classify import fold, sample
from tokenledger.llm.common import table, text_chunks, word_hashes, word_spans

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 12
#: Labelled documents used at most, and their words (a longer sample is cut by whole documents).
TRAIN_ROWS, TRAIN_WORDS = 6_000, 4_000_000
#: Their characters at most; longer texts than a twentieth of it are not learnt from.
TRAIN_CHARS = 24_000_000
EPOCHS, RATE, OPENING = 6, 0.01, 4

_SPLIT = np.ones(256, bool)
_SPLIT[48:58] = _SPLIT[65:91] = _SPLIT[97:123] = False
_SPLIT[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(embedding rows of the words and of their openings, document offsets).

    ASCII punctuation and white space part words; row 0 is no word. A word's
    embedding is the sum of its own row and that of its first bytes, which
    inflected and compound words share.
    """
    data = _LOWER[data]
    start, end, doc = word_spans(data, offsets, _SPLIT)
    hashed = [word_hashes(data, start, to) for to in (end, np.minimum(end, start + OPENING))]
    ids = (np.stack([hashed[0], hashed[1] * np.uint64(3) + np.uint64(1)], 1) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
    return ids, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))])


def _padded(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents followed by max(WIDTHS) rows of no word, so that no filter sees two of them."""
    pad = max(WIDTHS)
    n = np.diff(at)
    to = np.concatenate([[0], np.cumsum(n + pad)])
    out = np.zeros((to[-1], 2), np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)) * pad, n)] = ids
    return out, to


def _tables(model: dict) -> dict:
    """The embeddings through each filter position: a filter's response is a sum of table rows."""
    return {(w, j): model["embed"] @ kernel[j] for w, kernel in zip(WIDTHS, model["kernels"], strict=True) for j in range(w)}


def _pooled(model: dict, ids: np.ndarray, to: np.ndarray, where: bool = False, tables: dict | None = None):
    pooled, best = [], []
    for width, kernel, bias in zip(WIDTHS, model["kernels"], model["biases"], strict=True):
        n = len(ids) - width + 1
        x = np.zeros((len(ids), kernel.shape[2]), np.float32)
        for j in range(width):
            if tables is not None:
                x[:n] += tables[width, j][ids[j : j + n, 0]]
                x[:n] += tables[width, j][ids[j : j + n, 1]]
            else:
                x[:n] += model["embed"][ids[j : j + n]].sum(1) @ kernel[j]
        top = np.maximum.reduceat(x, to[:-1], axis=0)
        if where:
            hit = x == np.repeat(top, np.diff(to), axis=0)
            pos = np.where(hit, np.arange(len(ids))[:, None], len(ids))
            best.append(np.minimum.reduceat(pos, to[:-1], axis=0))
        pooled.append(np.maximum(top + bias, 0))
    return np.concatenate(pooled, 1), best


def score(model: dict, ids: np.ndarray, at: np.ndarray, tables: dict | None = None) -> np.ndarray:
    if len(at) < 2:
        return np.zeros(0)
    pooled, _ = _pooled(model, *_padded(ids, at), tables=tables)
    z = pooled @ model["out"] + model["bias"]
    return 1 / (1 + np.exp(-np.clip(z.astype(float), -40, 40)))


def fit(ids: np.ndarray, at: np.ndarray, label: np.ndarray, seed: int = 3) -> dict:
    """Adam on the logistic loss, classes weighted alike within a factor of 4, on one fixed order of batches."""
    rng = np.random.default_rng(seed)
    model = {
        "embed": rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), "kernels": [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        "biases": [np.zeros(FILTERS, np.float32) for _ in WIDTHS], "out": rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), "bias": np.zeros(1, np.float32),
    }
    model["embed"][0] = 0
    state: dict = {}
    step = 0

    def adam(key, value, grad):
        m, v = state.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)

    weight = np.where(label == 1, min(4.0, max(1.0, (label == 0).sum() / max(1, label.sum()))), 1.0).astype(np.float32)
    size = np.diff(at)
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for batch in np.array_split(order, max(1, len(order) // 64)):
            step += 1
            if not len(batch):
                continue
            own = np.concatenate([ids[at[i] : at[i + 1]] for i in batch]) if size[batch].sum() else ids[:0]
            x, to = _padded(own, np.concatenate([[0], np.cumsum(size[batch])]))
            pooled, best = _pooled(model, x, to, True)
            z = np.clip(pooled @ model["out"] + model["bias"], -30, 30)
            g = ((1 / (1 + np.exp(-z)) - label[batch]) * weight[batch] / len(batch)).astype(np.float32)
            back = np.outer(g, model["out"]) * (pooled > 0)
            adam("out", model["out"], pooled.T @ g + 1e-4 * model["out"])
            adam("bias", model["bias"], g.sum(keepdims=True))
            touched, grads = [], []
            for i, width in enumerate(WIDTHS):
                gb = back[:, i * FILTERS : (i + 1) * FILTERS]
                rows = best[i]
                kernel_grad = np.zeros_like(model["kernels"][i])
                for j in range(width):
                    word = x[np.minimum(rows + j, len(x) - 1)]
                    kernel_grad[j] = np.einsum("bfd,bf->df", model["embed"][word].sum(2), gb)
                    down = (gb[:, :, None] * model["kernels"][i][j].T[None]).reshape(-1, DIM)
                    touched += [word[:, :, 0].ravel(), word[:, :, 1].ravel()]
                    grads += [down, down]
                adam(("k", i), model["kernels"][i], kernel_grad + 1e-4 * model["kernels"][i])
                adam(("b", i), model["biases"][i], gb.sum(0))
            rows, inv = np.unique(np.concatenate(touched), return_inverse=True)
            total = np.zeros((len(rows), DIM), np.float32)
            np.add.at(total, inv, np.concatenate(grads))
            m, v = state.setdefault("embed", (np.zeros_like(model["embed"]), np.zeros_like(model["embed"])))
            m[rows] += 0.1 * (total - m[rows])
            v[rows] += 0.02 * (total * total - v[rows])
            model["embed"][rows] -= RATE * m[rows] / (np.sqrt(v[rows]) + 1e-6)
            model["embed"][0] = 0
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = 5) -> dict:
    """Fit on at most rows labelled documents; a fifth of them set each language's threshold.

    A threshold is the smallest at which half of the flagged held-back texts
    of that language or more are toxic (0.5 for a language without toxic
    ones); it decides and is never an input of a score.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    text = docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else []))
    got = sample(text, rows, TRAIN_CHARS, seed, known).toArrow().combine_chunks()
    if not got.num_rows:
        return {"model": None, "thresholds": {}}
    ids, at = [], [np.zeros(1, np.int64)]
    for batch in got.to_batches():
        for _, _, data, offsets in text_chunks(batch):
            a, b = tokens(data, offsets)
            ids.append(a), at.append(b[1:] + at[-1][-1])
    ids, at = np.concatenate(ids), np.concatenate(at)
    n = max(1, min(got.num_rows, int(np.searchsorted(at, TRAIN_WORDS, "right")) - 1))
    label = got["toxic"].to_numpy()[:n].astype(np.float32)
    at = at[: n + 1]
    held = np.arange(n) % 5 == 4
    pick = np.flatnonzero(~held)
    size = np.diff(at)
    model = fit(np.concatenate([ids[at[i] : at[i + 1]] for i in pick]) if len(pick) else ids[:0], np.concatenate([[0], np.cumsum(size[pick])]), label[pick])
    thresholds = {}
    if "lang" in got.column_names and held.any():
        rest = np.flatnonzero(held)
        s = score(model, np.concatenate([ids[at[i] : at[i + 1]] for i in rest]), np.concatenate([[0], np.cumsum(size[rest])]))
        lang = np.array([x or "" for x in got["lang"].to_pylist()[:n]])[rest]
        for name in np.unique(lang):
            p, y = s[lang == name], label[rest][lang == name]
            order = np.argsort(-p)
            good = np.cumsum(y[order]) * 2 >= np.arange(1, len(order) + 1)
            thresholds[str(name)] = float(max(0.5, p[order][good].min())) if good.any() else 0.5
    return {"model": model, "thresholds": thresholds}


def _score(batches: Iterator[pa.RecordBatch], model: dict | None) -> Iterator[pa.RecordBatch]:
    tables = _tables(model) if model else None
    for batch in batches:
        for first, rows, data, offsets in text_chunks(batch, limit=1_000_000):
            s = score(model, *tokens(data, offsets), tables) if model else np.zeros(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(s)], ["key", "score"])


def toxicity(docs: DataFrame, trained: dict, keep: list[str] | None = None) -> DataFrame:
    """docs' columns keep (default doc_id) and score, from 0 to 1; toxic where the language's threshold is reached, if lang is kept.

    Null and empty texts have the score of no words; repeated rows are each
    returned; without any label all scores are 0. Texts are read whole.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(trained["model"])
    rows = docs.select(F.struct(*keep).alias("key"), F.col("text").alias("text"))
    out = rows.mapInArrow(lambda it: _score(it, shared.value), "key " + rows.schema["key"].dataType.simpleString() + ", score double")
    out = out.select(*[F.col("key").getField(k).alias(k) for k in keep], "score")
    if "lang" in keep:
        least = F.lit(0.5)
        for name, value in sorted(trained["thresholds"].items()):
            least = F.when(F.coalesce("lang", F.lit("")) == name, value).otherwise(least)
        out = out.withColumn("toxic", F.col("score") >= least)
    return out


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learnt from the labels of the folds 0 and 2 of 3."""
    docs = table(spark, sf_dir, "documents")
    trained = train(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    out = toxicity(docs.select("doc_id", "text"), trained)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
