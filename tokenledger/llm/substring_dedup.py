"""Removal of long repeated byte strings: suffixes at anchors, sorted by comparisons of prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import _TABLE, bounded, discard, mix, powers, save, table, text_chunks

#: The odd base of the prefix hashes.
BASE = 0x2545F4914F6CDD1D
#: Members of a group from which it is dealt again, by ranges of offsets and what these have in common.
HOT = 2_000
#: Members up to which all of them are broadcast.
MEMBERS = 1_000_000


class Spans:
    """Hashes of any span of some bytes, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * powers(BASE, len(data)), out=self.sums[1:])
        self.back = powers(pow(BASE, -1, 1 << 64), len(data) + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


class Suffixes:
    """Texts read from some places of some bytes onwards (step 1) or backwards (step -1), as far as size tells, sorted within keys.

    Two are compared by the length of what they have in common, found by
    binary search on the prefix hashes, and the byte behind it: a number of
    steps that grows with the logarithm of their length. order: the sorted
    suffixes; common: what each has in common with the one before it, 0 at the
    first of a key. Neighbours that the hashes call equal are compared byte by
    byte; where one pair is not, all are sorted by their bytes instead.
    """

    def __init__(self, data: np.ndarray, spans: Spans, at: np.ndarray, size: np.ndarray, key: np.ndarray, step: int):
        self.data, self.spans, self.at, self.size, self.key, self.step = data, spans, at, size, key, step
        self.order = self._sorted()
        a, b = self.order[:-1], self.order[1:]
        same = key[a] == key[b]
        self.common = np.zeros(len(at), np.int64)
        self.common[1:][same] = self.extension(a[same], b[same])
        if not self._verified():
            said = [data[x : x + n].tobytes() if step > 0 else data[x - n : x].tobytes()[::-1] for x, n in zip(at, size, strict=True)]
            self.order = np.array(sorted(range(len(at)), key=lambda i: (key[i], said[i])), np.int64)
            for k in range(1, len(at)):
                x, y = (said[i] for i in self.order[k - 1 : k + 1])
                n = min(len(x), len(y))
                apart = np.flatnonzero(np.frombuffer(x[:n], np.uint8) != np.frombuffer(y[:n], np.uint8))
                self.common[k] = 0 if key[self.order[k - 1]] != key[self.order[k]] else int(apart[0]) if len(apart) else n

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The longest common beginnings of the suffixes i and j, by binary search."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        a, b = self.at[i], self.at[j]
        while (low < high).any():
            n = (low + high + 1) // 2
            same = self.spans.hash(a, a + n) == self.spans.hash(b, b + n) if self.step > 0 else self.spans.hash(a - n, a) == self.spans.hash(b - n, b)
            low, high = np.where(same, n, low), np.where(same, high, n - 1)
        return low

    def _before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the suffixes i stand before j: by key, by the byte behind what they share, the shorter and then the lower number first."""
        out = self.key[i] < self.key[j]
        tied = np.flatnonzero(self.key[i] == self.key[j])
        a, b = i[tied], j[tied]
        n = self.extension(a, b)
        ended = (n == self.size[a]) | (n == self.size[b])
        to = (lambda x: self.at[x] + n) if self.step > 0 else (lambda x: self.at[x] - n - 1)
        last = len(self.data) - 1
        x, y = (self.data[np.clip(to(z), 0, last)] for z in (a, b))
        shorter = (self.size[a] < self.size[b]) | (self.size[a] == self.size[b]) & (a < b)
        out[tied] = np.where(ended, shorter, x < y)
        return out

    def _sorted(self) -> np.ndarray:
        """Mergesort from the bottom up: all runs of a width are merged at once, each element placed by binary search in the other run."""
        n = len(self.at)
        order = np.argsort(self.key, kind="stable")
        width = 1
        while width < n:
            place = np.arange(n)
            start = place // (2 * width) * (2 * width)
            left = place - start < width
            other = np.where(left, start + width, start)
            low, high = np.minimum(other, n), np.minimum(np.where(left, start + 2 * width, start + width), n)
            first = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                behind = self._before(order[mid], order[open_])
                low[open_], high[open_] = np.where(behind, mid + 1, low[open_]), np.where(behind, high[open_], mid)
            merged = np.empty(n, np.int64)
            merged[np.where(left, place, place - width) + (low - first)] = order
            order, width = merged, 2 * width
        return order

    def _verified(self) -> bool:
        """Whether neighbours have in common, byte by byte, what the hashes say."""
        n = self.common[1:]
        shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = (np.repeat(self.at[x], n) + (shift if self.step > 0 else -1 - shift) for x in (self.order[:-1], self.order[1:]))
        return bool((self.data[a] == self.data[b]).all())

    def classes(self, length: int) -> np.ndarray:
        """A number for each suffix: equal for those of one key that have length bytes in common."""
        out = np.empty(len(self.at), np.int64)
        out[self.order] = np.cumsum(self.common < length) if length else np.cumsum(np.concatenate([[True], self.key[self.order[1:]] != self.key[self.order[:-1]]]))
        return out


def repeated_windows(data: np.ndarray, begin: np.ndarray, lo: np.ndarray, hi: np.ndarray, pos: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """For each member and each number of bytes from a window's start to the anchor (0 to length / 2), whether another member of its key has the same window.

    The members' bytes, from lo to hi + length, begin at begin in data. The
    windows of two members at one distance before the anchor are equal if the
    members share that many bytes before their anchors and the rest behind.
    """
    spans = Spans(data)
    at = begin + pos - lo
    right = Suffixes(data, spans, at, hi + length - pos, key, 1)
    left = Suffixes(data, spans, at, pos - lo, key, -1)
    out = np.zeros((len(lo), length // 2 + 1), bool)
    for before in range(length // 2 + 1):
        mine = np.flatnonzero((lo <= pos - before) & (pos - before <= hi))
        if len(mine) < 2:
            continue
        kind = right.classes(length - before)[mine] * (len(lo) + 1) + left.classes(before)[mine]
        _, which, many = np.unique(kind, return_inverse=True, return_counts=True)
        out[mine, before] = many[which] > 1
    return out


def _least_at(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of width elements the position of its smallest, the first of equals; by doubling."""
    value, at, have = g, np.arange(len(g), dtype=np.int64), 1
    while have < width:
        step = min(have, width - have)
        a, b = value[: len(value) - step], value[step:]
        right = b < a
        at = np.where(right, at[step:], at[: len(at) - step])
        value = np.where(right, b, a)
        have += step
    return at


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """Anchors of the windows of length bytes of concatenated documents.

    A window's anchor is the smallest hash among its runs of length / 2 bytes,
    so equal windows have equal anchors at equal offsets. Consecutive windows
    of one anchor are one row: (document, anchor, first window, last window,
    anchor hash, and two hashes of all bytes of the windows: the polynomial one and an independent one).
    """
    gram = length // 2
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    spans = Spans(data)
    start = np.arange(len(data) - gram + 1)
    g = spans.hash(start, start + gram)
    at = _least_at(g, length - gram + 1)
    doc = np.searchsorted(offsets, np.arange(len(at)), "right") - 1
    inside = np.flatnonzero(np.arange(len(at)) + length <= offsets[doc + 1])
    if not len(inside):
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(inside), bool)
    new[1:] = (at[inside[1:]] != at[inside[:-1]]) | (doc[inside[1:]] != doc[inside[:-1]])
    first = inside[new]
    last = inside[np.append(np.flatnonzero(new)[1:], len(inside)) - 1]
    anchor, owner = at[first], doc[first]
    said = memoryview(np.ascontiguousarray(data))
    own = np.fromiter((xxhash.xxh64_intdigest(said[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)), np.uint64, len(first))
    return owner, anchor, first, last, g[anchor], spans.hash(first, last + length), own


_ANCHORS = "doc long, gram long, pos int, lo int, hi int, run long, run2 long"


def _scan(batches: Iterator[pa.RecordBatch], length: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0)
        for at, rows, data, offsets in text_chunks(batch, limit=500_000):
            doc, anchor, first, last, g, h, h2 = anchored_runs(data, offsets, length)
            base, mask = offsets[doc] if len(doc) else doc, np.uint64((1 << bits) - 1)
            h, h2 = h & mask, h2 & mask
            arrays = [keys.slice(at, rows).take(pa.array(doc)), pa.array(g.view(np.int64)), *(pa.array((x - base).astype(np.int32)) for x in (anchor, first, last)), pa.array(h.view(np.int64)), pa.array(h2.view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "gram", "pos", "lo", "hi", "run", "run2"])


_BYTES = "gram long, run long, run2 long, x int, y int, bytes binary"


def _run_bytes(batches: Iterator[pa.RecordBatch], length: int, rows: int = 5_000) -> Iterator[pa.RecordBatch]:
    """The bytes of runs of windows, some thousand at a time; of each document (text, members) in turn."""
    for batch in batches:
        for i, text in enumerate(batch.column(0)):
            data, members = (text.as_py() or "").encode("utf-8", "surrogatepass"), batch.column(1)[i].values
            for at in range(0, len(members), rows):
                part = members.slice(at, rows)
                gram, run, run2, pos, lo, hi = (pa.array(part.field(k)) for k in ("gram", "run", "run2", "pos", "lo", "hi"))
                said = [data[a : b + length] for a, b in zip(lo.to_pylist(), hi.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([gram, run, run2, pc.subtract(lo, pos), pc.subtract(hi, pos), pa.array(said, pa.binary())], ["gram", "run", "run2", "x", "y", "bytes"])


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text, members in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            data, rows = (text.as_py() or "").encode("utf-8", "surrogatepass"), members.as_py()
            for at in range(0, len(rows), 5_000):
                part = rows[at : at + 5_000]
                column = lambda k, t, part=part: pa.array([r[k] for r in part], t)
                yield pa.RecordBatch.from_arrays(
                    [column("gram", pa.int64()), pa.array([key.as_py()] * len(part), pa.int64()), column("pos", pa.int32()), column("lo", pa.int32()), column("hi", pa.int32()), column("done", pa.bool_()), column("kinds", pa.int64()), pa.array([data[r["lo"] : r["hi"] + length] for r in part], pa.binary())],
                    ["gram", "doc", "pos", "lo", "hi", "done", "kinds", "bytes"],
                )


def _repeated(batches: Iterator[pa.RecordBatch], length: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Windows that occur at two or more members of a tile, as spans of the members that are not done; tiles lie together, in order."""
    held: list[pa.RecordBatch] = []

    def tile(rows: pa.Table) -> pa.RecordBatch:
        buffers = rows["bytes"].combine_chunks().cast(pa.large_binary())
        lo, hi, pos = (rows[k].to_numpy().astype(np.int64) for k in ("lo", "hi", "pos"))
        done, key = rows["done"].to_numpy(), rows["tile"].to_numpy()
        begin = np.concatenate([[0], np.cumsum(hi - lo + length)])[:-1]
        data = np.frombuffer(b"".join(x.as_py() for x in buffers), np.uint8)
        hit = repeated_windows(data, begin, lo, hi, pos, key, length) & ~done[:, None]
        row, before = np.nonzero(hit[:, ::-1])  # windows of a member from its first on
        start = pos[row] - (hit.shape[1] - 1 - before)
        new = np.ones(len(row), bool)
        new[1:] = (np.diff(start) != 1) | (np.diff(row) != 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1 if len(first) else first
        out = [rows["doc"].combine_chunks().take(pa.array(row[first])), pa.array(start[first]), pa.array(start[last] + length)]
        return pa.RecordBatch.from_arrays(out, ["doc", "s", "e"])

    size = 0
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if size > limit and held[-1].column(0)[-1].as_py() != key[a]:
                yield tile(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += (held[-1].column(5).nbytes or 0) + 1
    if held:
        yield tile(pa.Table.from_batches(held))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, gone, runs, digest, kept = [], [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            left, at, removed, count = [], 0, 0, 0
            end = -1
            for s, e in sorted((x["s"], x["e"]) for x in (spans.as_py() or ())):
                if s > end:
                    left.append(data[max(at, 0) : s])
                    count += 1
                removed += max(0, e - max(s, end))
                end = max(end, e)
                at = end
            left.append(data[at:])
            rest = b"".join(left)
            size.append(len(data)), gone.append(removed), runs.append(count), digest.append(hashlib.sha256(rest).hexdigest()), kept.append(rest)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _unlike(text: DataFrame, alike: DataFrame, length: int) -> DataFrame:
    """Of the kinds of alike (gram, run, run2, x, y: runs of equal hashes; doc, pos, lo, hi) those whose runs differ in bytes.

    Runs are grouped by kind and bytes, before the shuffle as well, so a run
    that many documents of a task have is sent once. The members grow with the
    copies in the corpus: they are shuffled to their texts at every size.
    """
    per = alike.groupBy("doc").agg(F.collect_list(F.struct("gram", "run", "run2", "pos", "lo", "hi")).alias("members"))
    rows = text.select("doc", "text").join(per.hint("shuffle_merge"), "doc").select("text", "members")
    said = rows.mapInArrow(lambda it: _run_bytes(it, length), _BYTES).distinct()
    kinds = said.groupBy("gram", "run", "run2", "x", "y").count()
    return save(kinds.where("count > 1").drop("count"), "repeats-unlike")


def remove_repeats(docs: DataFrame, length: int = 400, hash_bits: int = 64) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    Removed is every byte covered by a string of length bytes that also starts
    elsewhere. Each window of that length is anchored at its smallest hash of
    half the length, and anchors whose half length occurs once are done with:
    what is left are the suffixes at anchors, dealt out by their first bytes.
    Runs of windows of one anchor that are equal as a whole are repeated
    throughout. Two hashes (of hash_bits bits; fewer only bring more work) find
    them, and a grouping by their bytes verifies them: where runs of equal
    hashes differ, all of them go on as unlike ones. These, and one run for
    each kind of equal ones, meet by anchor and are sorted there, onwards and
    backwards from the anchor (see Suffixes); what neighbours have in common
    tells which windows occur twice. Groups of HOT or more are dealt again by
    ranges of offsets and the bytes common to such a range.

    Null text: no bytes. Texts under length: nothing removed. Repeated rows
    are documents of their own. Null doc_id and clashing column names: fine,
    rows are known by an own key. No rows: no rows.
    """
    text = docs.select(F.xxhash64("doc_id", "text").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = text.select("doc", "text").mapInArrow(lambda it: _scan(it, length, hash_bits), _ANCHORS)
    found = save(found, "repeats-found")
    # counts are combined before the shuffle, and a common anchor's rows may be split in the join
    twice = save(found.groupBy("gram").count().where("count > 1").select("gram"), "repeats-grams")
    runs = save(found.join(bounded(twice), "gram"), "repeats-anchors")
    discard(found), discard(twice)
    kind = ["gram", "run", "run2", "x", "y"]
    runs = runs.select("*", F.expr("lo - pos").alias("x"), F.expr("hi - pos").alias("y"))
    kinds = save(runs.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos", "lo", "hi")).alias("one")), "repeats-kinds")
    alike = save(runs.join(kinds.where("n > 1").select(*kind), kind, "left_semi"), "repeats-alike")
    discard(runs)
    lying = _unlike(text, alike, length)
    if lying.limit(1).count():
        apart = alike.join(lying, kind, "left_semi").select(*kind, F.lit(1).cast("long").alias("n"), F.struct("doc", "pos", "lo", "hi").alias("one"))
        kinds = kinds.join(lying, kind, "left_anti").unionByName(apart)
        alike = alike.join(lying, kind, "left_anti")
    covered = alike.select("doc", F.col("lo").cast("long").alias("s"), (F.col("hi") + length).cast("long").alias("e"))
    several = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1")
    part = kinds.join(several, "gram").select("gram", "one.*", (F.col("n") > 1).alias("done"), "kinds")
    per = save(part.groupBy("doc").agg(F.collect_list(F.struct("gram", "pos", "lo", "hi", "done", "kinds")).alias("members")), "repeats-members")
    members = per.agg(F.coalesce(F.sum(F.size("members")), F.lit(0))).first()[0]  # of 33 bytes each
    rows = text.select("doc", "text").join(F.broadcast(per) if members <= MEMBERS else per, "doc").select("doc", "text", "members")
    rows = rows.mapInArrow(lambda it: _contexts(it, length), "gram long, doc long, pos int, lo int, hi int, done boolean, kinds long, bytes binary").dropDuplicates(["gram", "doc", "pos"])
    tiles = rows.where(F.col("kinds") < HOT).select(F.xxhash64("gram").alias("tile"), "doc", "pos", "lo", "hi", "bytes", "done")
    step = length // 16 + 1  # offsets from anchors go from 0 to length / 2: 8 ranges
    hot = rows.where(F.col("kinds") >= HOT).withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("a", F.expr(f"greatest(lo, pos - (range + 1) * {step} + 1)")).withColumn("b", F.expr(f"least(hi, pos - range * {step})")).where("a <= b")
    core = F.expr(f"substring(bytes, pos - range * {step} - lo + 1, {length - step + 1})")
    hot = hot.select(F.xxhash64("gram", "range", core).alias("tile"), "doc", "pos", F.col("a").alias("lo"), F.col("b").alias("hi"), F.expr(f"substring(bytes, a - lo + 1, b - a + {length})").alias("bytes"), "done")
    tiles = tiles.unionByName(hot)
    tiles = tiles.repartition("tile").sortWithinPartitions("tile")
    some = save(tiles.mapInArrow(lambda it: _repeated(it, length), "doc long, s long, e long"), "repeats-spans")
    # coverage of equal rows (one key) is that of each of them; a text that occurs as two rows is repeated as a whole
    twice = text.where(F.octet_length("text") >= length).groupBy("doc").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).cast("long").alias("e")).where("n > 1").select("doc", F.lit(0).cast("long").alias("s"), "e")
    spans = covered.unionByName(some).unionByName(twice).groupBy("doc").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    spans = save(spans, "repeats-covered")
    for done in (kinds, alike, lying, per, some):
        discard(done)
    out = text.join(spans, "doc", "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strings of 400 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"), 400).drop("kept")
