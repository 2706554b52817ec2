"""Helpers shared by the training-data operators: shared storage, bounded
broadcasts, connected components and byte-level access to Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the corpus operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table of a few longs a row may be broadcast (about 16 MB).
BROADCAST_ROWS = 500_000
#: Bytes of an Arrow batch that a saved table's tasks take at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a new one of our own only where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tokenledger-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_BYTES for what runs inside: a task holds several copies of one."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by save() that nothing lazy refers to any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def few(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows (counted)."""
    return df.limit(limit + 1).count() <= limit


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most limit rows, else for a join that shuffles: its files tell less than its rows take in the driver."""
    return F.broadcast(df) if few(df, limit) else df.hint("merge")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component) of the nodes of edges (a, b): alternating large and small stars.

    Both steps are a grouped minimum (combined before the shuffle) joined back
    to the edges; no node's neighbours are ever gathered. Loops and repeated
    edges are ignored; no edges give no rows.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def next_of(e: DataFrame) -> DataFrame:
        out = save(star(star(e, True).distinct(), False).where("a <> b").distinct(), name)
        discard(e)
        return out

    e = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    was = state(e)
    while was[0]:
        e = next_of(e)
        now = state(e)
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = 2_000_000):
    """(first row, rows, bytes, offsets) of slices of a batch with about limit bytes of text, null as empty.

    A text longer than limit makes a slice of its own; no text is split.
    """
    text = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_string(text.type):
        text = text.cast(pa.large_string())
    text = text.fill_null("") if text.null_count else text
    n = len(text)
    ends = np.frombuffer(text.buffers()[1], np.int64, n + 1 + text.offset)[text.offset :]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to - at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups: rows of one key (first column) lie together."""
    held, last = [], None
    for batch in batches:
        key = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and key[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key[a]
    if held:
        yield pa.Table.from_batches(held)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray):
    """(start, end, document index) of the words of concatenated documents; space[byte] marks separators."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~space[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = 1 << 16
_P = 0x2545F4914F6CDD1D
_PINV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_CACHE: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _CACHE or len(_CACHE[base]) < n:
        _CACHE[base] = _powers(base, max(n, 1 << 19))
    return _CACHE[base][:n]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by prefix sums of a polynomial over random byte values."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_P, len(data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(_PINV, len(data) + 1)[start] + (end - start).astype(np.uint64))
