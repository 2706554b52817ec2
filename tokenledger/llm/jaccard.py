"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import bounded, components, discard, mix, save, table, text_chunks, word_hashes, word_spans

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Set hashes that a task remembers, so as to deal the keys of equal sets once.
SEEN = 200_000
#: One text in so many, by hash, tells which keys are hot: those of at least HOT_LEAST sets among them and of a share
#: of their keys of one in HOT_KEYS or more, so that there are no more than HOT_KEYS; a hot key goes to HOT_PARTS tasks.
HOT_SAMPLE, HOT_LEAST, HOT_KEYS, HOT_PARTS = 64, 16, 20_000, 64
#: Nodes of a tile that are held against each other at once; larger tiles are dealt out as pairs of blocks.
BLOCK = 4_096
#: Bytes of text that a task takes into arrays at once, and nodes that it holds against a tile's others at once.
TEXT_BYTES, ROWS = 400_000, 48
#: Rows of tiles that a task takes at once, and rows up to which a tile is compared together with others.
TILE_ROWS, SMALL = 20_000, 64


@lru_cache
def bands(percent: int, top: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower edges of the size bands, and the parts and the spare parts of each.

    Sets that reach percent similarity lie in one band or in neighbouring
    ones. If the smaller is in band i, they differ in at most d elements, so
    of d + 1 + spare parts of the hash range at least spare + 1 are equal; if
    one of the two sets has at most spare parts without elements, an equal part
    with elements is among them. spare is what a set of the band exceeds
    rarely; a band whose sets are too small for that has 0 parts.
    """
    low = [1]
    while low[-1] < top:
        low.append(max(low[-1] + 1, (low[-1] - 1) * 100 // percent + 1))
    parts, spares = [], []
    for least, nxt in zip(low, low[1:], strict=False):
        high = nxt - 1
        d = (100 - percent) * (high + high * 100 // percent) // (100 + percent)
        k, spare = d + 1, 0
        for _ in range(40):
            empty = k * (1 - 1 / k) ** least
            need = int(np.ceil(empty + 2 * empty**0.5))
            if spare >= need or need > d:
                break
            spare = need
            k = d + 1 + spare
        if spare < need:
            k, spare = 0, 0
        parts.append(k), spares.append(spare)
    return np.array(low[:-1], np.int64), np.array(parts, np.int64), np.array(spares, np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents one after another, offsets)."""
    data = FOLD[data]
    start, end, doc = word_spans(data, offsets, SPACE)
    words = word_hashes(data, start, end)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= width:
        run = np.zeros(len(words) - width + 1, np.uint64)
        for j in range(width):
            run = mix(run ^ words[j : j + len(run)])
        whole = doc[: len(run)] == doc[width - 1 :]
        h, owner = run[whole], doc[: len(run)][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])
        whole = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            more = count[short] > j
            whole[more] = mix(whole[more] ^ words[first[short[more]] + j])
        h, owner = np.concatenate([h, mix(whole + count[short].astype(np.uint64))]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=n))])


def _group_sums(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h), dtype=np.uint64)])
    return mix(total[at[1:]] - total[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64)).view(np.int64)


def bitmap(h: np.ndarray) -> bytes:
    """Parity bitmap: bit h mod size is the parity of the elements that fall on it.

    Two bitmaps, the longer folded to the shorter's size, differ in no more
    bits than the sets differ in elements.
    """
    bits = 128
    while bits < min(2 * len(h), 4096):
        bits *= 2
    return np.packbits(np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) % 2 == 1).tobytes()


class _Bitmaps:
    """Parity bitmaps of some sets, folded to every length that a pair may need."""

    def __init__(self, bits: pa.BinaryArray, n: np.ndarray):
        ends = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
        data, self.n, self.size = np.frombuffer(bits.buffers()[2], np.uint8), n, np.diff(ends)
        self.at, self.level = {}, {}
        rows, held = np.zeros(0, np.int64), None
        length = int(self.size.max(initial=0))
        while length >= int(self.size.min(initial=1 << 30)):
            own = np.flatnonzero(self.size == length)
            new = data[ends[own][:, None] + np.arange(length)].view(np.uint64)
            held = new if held is None else np.concatenate([held[:, : held.shape[1] // 2] ^ held[:, held.shape[1] // 2 :], new])
            rows = np.concatenate([rows, own])
            self.at[length], self.level[length] = np.zeros(len(n), np.int64), held
            self.at[length][rows] = np.arange(len(rows))
            length //= 2

    def most(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of sets the largest number of common elements that their bitmaps and sizes allow."""
        apart, short = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        for length, held in self.level.items():
            mine, place = np.flatnonzero(short == length), self.at[length]
            step = max(1, (8 << 20) // length)
            for at in range(0, len(mine), step):
                k = mine[at : at + step]
                apart[k] = np.bitwise_count(held[place[i[k]]] ^ held[place[j[k]]]).sum(1)
        return np.minimum((self.n[i] + self.n[j] - apart) // 2, np.minimum(self.n[i], self.n[j]))


def _tiles(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.Table]:
    """Some thousand rows at a time: whole tiles (first column), or any rows, a tile's first row before the rest of it."""
    held, lead = [], None
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) < TILE_ROWS:
            continue
        rows = pa.Table.from_batches(([lead] if lead else []) + held)
        key = rows.column(0).to_numpy()
        start = int(np.flatnonzero(key != key[-1])[-1] + 1) if key[0] != key[-1] else 0
        if whole:
            held = rows.slice(start).combine_chunks().to_batches()
            if start:
                yield rows.slice(0, start)
        else:
            lead, held = rows.slice(start, 1).combine_chunks().to_batches()[0], []
            yield rows
    rows = ([lead] if lead else []) + held
    if rows:
        yield pa.Table.from_batches(rows)


def _pairs(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows (i < j) of tiles, many small tiles at once, a large one in parts."""
    small = size <= SMALL
    tile = np.repeat(np.arange(len(size)), size)
    left = np.repeat(size, size) - (np.arange(len(tile)) - start[tile]) - 1  # rows behind this one in its tile
    left[~small[tile]] = 0
    for step in range(1, int(left.max(initial=0)) + 1):
        i = np.flatnonzero(left >= step)
        yield i, i + step
    for k in np.flatnonzero(~small):
        for at in range(int(start[k]), int(start[k] + size[k]), ROWS):
            i = np.arange(at, min(at + ROWS, start[k] + size[k]))
            behind = start[k] + size[k] - i - 1
            first = np.repeat(i, behind)
            yield first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(behind) - behind, behind)


def _open_pairs(batches: Iterator[pa.RecordBatch], percent: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of a tile's nodes that bitmaps don't rule out, cut: whether more of their kind are open; tiles lie together, nodes in order.

    most None: pairs of the tile's first node. Else pairs of different
    components, and of each two components of a tile the most likely ones,
    most at most.
    """
    for rows in _tiles(batches, most is not None):
        rows = rows.combine_chunks()
        key, node, part, n = (rows.column(k).to_numpy() for k in ("tile", "node", "component", "n"))
        maps = _Bitmaps(rows["bits"].combine_chunks() if isinstance(rows["bits"], pa.ChunkedArray) and rows["bits"].num_chunks != 1 else rows["bits"].chunk(0), n)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        lead = np.repeat(start, size)
        found = _pairs(start, size) if most else [(lead, np.arange(len(key)))]
        held, count = [np.zeros((3, 0))], 0

        def best(held=held, part=part, lead=lead):
            """Of the pairs of each two components of a tile the most likely; whether there were more."""
            i, j, odds = np.concatenate(held, axis=1)
            i, j = i.astype(np.int64), j.astype(np.int64)
            x, y = np.minimum(part[i], part[j]), np.maximum(part[i], part[j])
            order = np.lexsort((j, i, -odds, y, x, lead[i]))
            x, y, i, j, odds = (v[order] for v in (x, y, i, j, odds))
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (lead[i[1:]] != lead[i[:-1]])
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(x)))
            rank = np.arange(len(x)) - np.repeat(first, many)
            keep = rank < most + 1  # one more tells that some are cut
            held[:] = [np.stack([i, j, odds])[:, keep]]
            return np.repeat(many > most, many)[keep], rank[keep] < most

        for i, j in found:
            ok = part[i] != part[j] if most else node[i] != node[j]
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            top = maps.most(i, j)
            both = n[i] + n[j]
            ok = 100 * top >= percent * (both - top)
            if ok.any():
                held.append(np.stack([i[ok], j[ok], top[ok] / (both - top)[ok]]))
                count += int(ok.sum())
            if most and count > 500_000:
                best()
                count = held[0].shape[1]
        cut, shown = best() if most else (None, None)
        i, j, _ = np.concatenate(held, axis=1).astype(np.int64)
        i, j, cut = (i[shown], j[shown], cut[shown]) if most else (i, j, np.zeros(len(i), bool))
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cut)], ["a", "b", "cut"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for first, rows, data, offsets in text_chunks(batch, limit=TEXT_BYTES):
            h, at = shingle_sets(data, offsets, width)
            bits = pa.array([bitmap(h[at[i] : at[i + 1]]) if at[i + 1] > at[i] else None for i in range(rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.slice(first, rows), texts.slice(first, rows), pa.array(np.diff(at)), pa.array(_group_sums(h, at)), bits], ["doc_id", "t", "n", "node", "bits"])


def tile_keys(h: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, index of the set) of sorted sets one after another: the tiles in which each set meets those that it may link with.

    For its band and the one below, a set has a key for each part of the hash
    range that holds elements of it. A set with more parts without elements
    than the band has to spare also meets its like by its first elements:
    linked sets of n elements share one of the n - ceil(percent n) + 1 smallest.
    """
    low, parts, spares = bands(percent)
    size = np.diff(at)
    band = np.searchsorted(low, size, "right") - 1
    prefix = size + (-percent * size // 100) + 1
    keys, sets = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for below in (0, 1):
        mine = np.where((size > 0) & (band >= below), band - below, -1)
        owner = np.repeat(np.arange(len(size)), size)
        ok = mine[owner] >= 0
        g, own, rank = h[ok], owner[ok], (np.arange(len(h)) - at[owner])[ok]
        if not len(g):
            continue
        b = mine[own]
        part = ((g >> np.uint64(32)) * parts[b].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        new = np.ones(len(g), bool)
        new[1:] = (own[1:] != own[:-1]) | (part[1:] != part[:-1])
        start = np.flatnonzero(new)
        total = np.add.reduceat(mix(g), start)
        tiled = parts[b[start]] > 0
        keys.append(mix(mix(total + part[start].astype(np.uint64)) + b[start].astype(np.uint64))[tiled]), sets.append(own[start][tiled])
        filled = np.bincount(own[start], minlength=len(size))
        bare = (mine >= 0) & (parts[mine] - filled > spares[mine]) | (mine >= 0) & (parts[mine] == 0)
        pick = bare[own] & (rank < prefix[own])
        keys.append(mix(g[pick] * np.uint64(3) + b[pick].astype(np.uint64))), sets.append(own[pick])
    return np.concatenate(keys).view(np.int64), np.concatenate(sets)


def _keys(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for _, rows, data, offsets in text_chunks(batch, limit=TEXT_BYTES):
            h, at = shingle_sets(data, offsets, width)
            nodes, size = _group_sums(h, at), np.diff(at)
            new = np.zeros(rows, bool)
            for i in np.flatnonzero(size):
                if nodes[i] not in seen:
                    seen.add(nodes[i])
                    new[i] = True
            if len(seen) > SEEN:
                seen.clear()
            key, which = tile_keys(h[np.repeat(new, size)], np.concatenate([[0], np.cumsum(size[new])]), percent)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(nodes[new][which])], ["key", "node"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, hot) sorted by key and node the distinct ones whose key has another node, or is hot; one row is held over a batch's end."""
    last, sent = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)], False
    for batch in batches:
        key, node, hot = (np.concatenate([held, batch.column(i).to_numpy(zero_copy_only=False)]) for i, held in enumerate(last))
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, hot = key[new], node[new], hot[new]
        keep = hot.copy()
        same = key[1:] == key[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] &= not sent
        sent = bool(keep[-1]) or (sent and len(key) == 1)
        last = [x[-1:] for x in (key, node, hot)]
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep])], ["key", "node"])


def _arrays(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch, limit=TEXT_BYTES):
            h, at = shingle_sets(data, offsets, width)
            yield pa.RecordBatch.from_arrays([pa.array(_group_sums(h, at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))], ["node", "items"])


def _exact(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sorted arrays x and y intersect enough; a share of a batch at once."""
    for batch in batches:
        a, b, x, y = (batch.column(k) for k in range(4))
        sizes = np.stack([np.diff(v.offsets.to_numpy()) for v in (x, y)]).astype(np.int64)
        ends, at, keep = np.cumsum(sizes.sum(0)), 0, np.zeros(batch.num_rows, bool)
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, "right")))
            values = np.concatenate([v.slice(at, to - at).flatten().to_numpy().view(np.uint64) for v in (x, y)])
            pair = np.concatenate([np.repeat(np.arange(at, to), s[at:to]) for s in sizes])
            order = np.lexsort((values, pair))
            values, pair = values[order], pair[order]
            both = np.bincount(pair[1:][(values[1:] == values[:-1]) & (pair[1:] == pair[:-1])] - at, minlength=to - at)
            keep[at:to] = 100 * both >= percent * (sizes[:, at:to].sum(0) - both)
            at = to
        yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])


def shared_keys(text: DataFrame, width: int, percent: int) -> DataFrame:
    """key, node: of texts the tiles of two nodes or more, each node of a tile once.

    The keys are shuffled once and read in order, one row held at a time. The
    keys of a part of the texts tell the hottest ones, which certainly have
    several nodes: their rows are dealt over many tasks and need no company.
    """
    def keys(part: DataFrame) -> DataFrame:
        return part.select("text").mapInArrow(lambda it: _keys(it, width, percent), "key long, node long")

    some = keys(text.where(F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(HOT_SAMPLE)) == 0)).distinct().groupBy("key").agg(F.count("*").alias("times"))
    some = save(some.where(F.col("times") >= HOT_LEAST), "jaccard-hot")
    least = (some.agg(F.sum("times")).first()[0] or 0) / HOT_KEYS
    hot = some.where(F.col("times") >= least).select("key", F.lit(True).alias("hot"))
    dealt = keys(text).join(bounded(hot), "key", "left").select("key", "node", F.coalesce("hot", F.lit(False)).alias("hot"))
    dealt = dealt.repartition("key", F.when(F.col("hot"), F.pmod("node", F.lit(HOT_PARTS))).otherwise(0)).sortWithinPartitions("key", "node")
    tiles = save(dealt.mapInArrow(_shared, "key long, node long"), "jaccard-tiles")
    discard(some)
    return tiles


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, t (hash of the text), n_shingles, n_links, component_id.

    Sets of hashed word shingles (all words as one shingle if there are fewer)
    link when their Jaccard similarity reaches percent. Tiles: each set
    belongs to a band of sizes and meets, for its band and the one below, the
    sets that share a key with it (see tile_keys); linked sets always do. Equal
    sets are one node. Bitmaps bound the overlap of a tile's nodes from above,
    and sorted arrays decide: first for the tile's first node alone, then in
    rounds for the most likely pairs of each two components that still meet in
    a tile, with more pairs a round until none is left out. So no link between
    components is lost, and the pairs of a group of near copies are not
    enumerated. n_links counts the verified links of the document's set, those
    to equal sets not included.

    Null, empty or blank text: n_shingles 0, linked with nothing. Null doc_id:
    its own row, never a component's name unless alone. Repeated rows: each is
    returned. No rows: no rows. Other columns are ignored.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    all_sets = save(text.mapInArrow(lambda it: _sets(it, width), "doc_id long, t long, n long, node long, bits binary"), "jaccard-sets")
    sets = all_sets.select("doc_id", "t", "n", "node")
    nodes = save(all_sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"), F.min(F.struct("doc_id", "t")).alias("of"), F.first("bits").alias("bits")), "jaccard-nodes")
    tiles = shared_keys(text, width, percent)
    bits = nodes.select("node", "n", "bits")

    def open_pairs(part: DataFrame, most: int | None) -> DataFrame:
        """Of part (tile, node, component) the pairs of _open_pairs."""
        held = part.join(bits, "node").select("tile", "node", "component", "n", "bits")
        pairs = held.repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(lambda it: _open_pairs(it, percent, most), "a long, b long, cut boolean")
        return pairs.groupBy("a", "b").agg(F.max("cut").alias("cut"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of nodes those that link."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = save(nodes.join(ends, "node").select(F.col("of.doc_id").alias("d"), F.col("of.t").alias("u")), "jaccard-wanted")
        small = bounded(wanted)
        mine = text.join(small, text["doc_id"].eqNullSafe(small["d"]) & (text["t"] == small["u"]), "left_semi").select("text")
        items = save(mine.mapInArrow(lambda it: _arrays(it, width), "node long, items array<long>").dropDuplicates(["node"]), "jaccard-items")
        both = pairs.join(items.toDF("a", "x"), "a").join(items.toDF("b", "y"), "b").select("a", "b", "x", "y")
        out = save(both.mapInArrow(lambda it: _exact(it, percent), "a long, b long"), "jaccard-links")
        discard(wanted), discard(items)
        return out

    tested = save(open_pairs(tiles.select(F.col("key").alias("tile"), "node", F.col("node").alias("component")), None), "jaccard-pairs")
    known, most = verified(tested.select("a", "b")), 1
    named = components(known)
    while True:
        part = tiles.join(named.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        apart = part.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("x <> y").select("key", "blocks")
        dealt = part.join(apart, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "node", "component")
        found = save(open_pairs(dealt, most), "jaccard-pairs")
        rest = save(found.join(tested.select("a", "b"), ["a", "b"], "left_anti").select("a", "b"), "jaccard-rest")
        if rest.limit(1).count():
            more = verified(rest)
            if more.limit(1).count():
                known = known.unionByName(more)
                named = components(known)
        if not found.where("cut").limit(1).count():
            break
        tested, most = tested.select("a", "b").unionByName(rest), most * 64
    degree = known.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    label = nodes.select("node", "least").join(named.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    label = label.join(label.groupBy("component").agg(F.min("least").alias("component_id")), "component").join(degree, "node", "left").select("node", "n_links", "component_id")
    label = save(label, "jaccard-labels")
    discard(nodes), discard(tiles)
    out = sets.join(label, (sets["node"] == label["node"]) & (sets["n"] > 0), "left")
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, 3-word shingles, similarity of 90 % or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")


_SETS = r"""
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)"""
ORACLE_SQL = rf"""
WITH RECURSIVE {_SETS},
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
