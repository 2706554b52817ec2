"""Fill-in-middle transformation by secondary sort: pieces of documents, sorted into place and streamed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import save, table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Units of a piece at most.
PIECE = 1 << 14
#: Bytes that are looked at at once, and that a batch of pieces holds, about.
BLOCK, BATCH = 1 << 20, 4 << 20

_HEAD = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
_HEADS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def unit_starts(data: np.ndarray, block: int = BLOCK) -> Iterator[np.ndarray]:
    """Offsets at which the units of UTF-8 text start (runs of ASCII letters, single other code points), block by block."""
    for at in range(0, len(data), block):
        part = data[at : at + block]
        low = part | 0x20
        letter = (low > 96) & (low < 123)
        begins = (part & 0xC0) != 0x80
        begins[1:] &= ~(letter[1:] & letter[:-1])
        if at and letter[0] and 96 < data[at - 1] | 0x20 < 123:
            begins[0] = False
        yield at + np.flatnonzero(begins)


def offsets_of(data: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The offsets of units, ascending numbers from 0; the text's length for those past the last."""
    out, seen = np.full(len(units), len(data), np.int64), 0
    for starts in unit_starts(data):
        a, b = np.searchsorted(units, (seen, seen + len(starts)))
        out[a:b] = starts[units[a:b] - seen]
        seen += len(starts)
    return out


def _chars(data: np.ndarray) -> int:
    return sum(int(((data[i : i + BLOCK] & 0xC0) != 0x80).sum()) for i in range(0, len(data), BLOCK))


def arranged(text: bytes, draws: tuple[int, int, int, int], piece: int = PIECE, plain_from: int = 90, spm_below: int = 20):
    """(n, form, prefix_chars, middle_chars, pieces in output order) of a text and its four draws."""
    data = np.frombuffer(text, np.uint8)
    n = sum(len(s) for s in unit_starts(data))
    plain = not text or draws[2] % 100 >= plain_from or any(s in text for s in (PREFIX, SUFFIX, MIDDLE))
    lo, hi = (0, 0) if plain else sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    units = np.unique(np.concatenate([np.arange(0, n, piece), [lo, hi, n]]).astype(np.int64))
    at = offsets_of(data, units)
    cut = lambda a, b: [text[x:y] for u, x, y in zip(units, at, at[1:], strict=False) if a <= u < b]
    if plain:
        return n, "plain", None, None, cut(0, n) or [b""]
    a, b = at[np.searchsorted(units, (lo, hi))]
    spm = draws[3] % 100 < spm_below
    first, second = ([SUFFIX, *cut(hi, n)], [PREFIX, *cut(0, lo)]) if spm else ([PREFIX, *cut(0, lo)], [SUFFIX, *cut(hi, n)])
    return n, "spm" if spm else "psm", _chars(data[:a]), _chars(data[a:b]), [*first, *second, MIDDLE, *cut(lo, hi)]


def fim_pieces(docs: DataFrame, seed: int = 1, piece: int = PIECE, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(k, at, piece, and with a document's first piece: doc_id, n, form, prefix_chars, middle_chars) of docs (doc_id, text).

    k numbers the rows, so that repeated ones stay apart; at is the piece's
    byte offset in the output, whose sentinels are pieces of their own. The
    draws are the first four 8-digit groups of the SHA-256 of seed:doc_id.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    rows = docs.select(F.monotonically_increasing_id().alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), h.alias("h"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(8)]
        held = 0

        def taken() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.binary(), *_HEADS]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["k", "at", "piece", "doc_id", "n", "form", "prefix_chars", "middle_chars"])

        for batch in batches:
            k, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            drawn = list(zip(*(batch.column(i).to_pylist() for i in range(3, 7)), strict=True))
            for i in range(len(k)):
                n, form, before, middle, pieces = arranged(texts[i].as_py(), drawn[i], piece, plain_from, spm_below)
                at = 0
                for p in pieces:
                    head = (ids[i], n, form, before, middle) if not at else (None,) * 5
                    for column, value in zip(out, (k[i], at, p, *head), strict=True):
                        column.append(value)
                    at += len(p)
                held += at + 64 * len(pieces)
                if held >= BATCH:
                    yield taken()
                    out, held = [[] for _ in range(8)], 0
        yield taken()

    return rows.select("k", "doc_id", "text", *draws).mapInArrow(cut, f"k long, at long, piece binary, {_HEAD}")


def _sorted_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Iterator[list]]]:
    """(first row, rows) of runs of rows with one k, row by row: k, at, piece, ..."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(rows, None)
    while row is not None:
        first = row

        def run(k=first[0]):
            nonlocal row
            while row is not None and row[0] == k:
                yield row
                row = next(rows, None)

        own = run()
        yield first, own
        for _ in own:  # what the caller left
            pass


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, n: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _placed(pieces: DataFrame) -> DataFrame:
    """One exchange by document for all who read it in a query; each sorts it for itself.

    The filter, which a join would add on its side alone, keeps the exchanges the same.
    """
    return pieces.where("k IS NOT NULL").repartition("k")


_MARKS = "k long, how string, output_sha256 string, p_at long, s_at long, m_at long"
_DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
_ARROW = {"long": pa.int64(), "string": pa.string()}


def _arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _output_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in output order to a row a document: its form, the output's digest, and where its sentinels are."""

    def rows() -> Iterator[tuple]:
        for first, pieces in _sorted_documents(batches):
            digest, marks = hashlib.sha256(), {}
            for _, at, piece, *_ in pieces:
                digest.update(piece)
                if len(piece) == 3 and piece in (PREFIX, SUFFIX, MIDDLE):
                    marks.setdefault(piece, at)
            marks = {} if first[5] == "plain" else marks
            yield first[0], first[5], digest.hexdigest(), marks.get(PREFIX), marks.get(SUFFIX), marks.get(MIDDLE)

    yield from _in_batches(rows(), _arrow_schema(_MARKS))


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, the output's first one and then those of the restored text in order, to a row a document."""

    def rows() -> Iterator[tuple]:
        for first, pieces in _sorted_documents(batches):
            digest = hashlib.sha256()
            if first[4] != "plain":
                next(pieces)  # a sentinel
            for row in pieces:
                digest.update(row[1])
            yield *first[2:], digest.hexdigest()

    yield from _in_batches(rows(), _arrow_schema(_DIGESTS))


def fim_texts(pieces: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, text): the transformed documents, assembled from fim_pieces."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "text"]
        for first, own in _sorted_documents(batches):
            text = b"".join(row[2] for row in own).decode()
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*first[3:8], text), [*_HEADS, pa.string()], strict=True)], names)

    return _placed(pieces).sortWithinPartitions("k", "at").mapInArrow(joined, f"{_HEAD}, text string")


def fim_digests(docs: DataFrame, **how) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    Texts are cut into pieces of at most PIECE units, keyed by document and by
    their place in the output. The pieces are dealt by document once (the
    exchange is shared) and sorted twice within partitions: by output place,
    where they stream into an incremental digest and show where the sentinels
    are, and, with nothing but those places and the form, by the place in the
    restored text. A task holds a batch of pieces and one open digest, however
    long its texts; a text is whole only where its pieces are cut.

    Null text: empty. Empty text: plain, n 0. Null doc_id: drawn by `seed:` alone.
    Repeated rows: each is returned. No rows: no rows. Other columns are ignored.
    """
    pieces = _placed(fim_pieces(docs, **how))
    marks = pieces.sortWithinPartitions("k", "at").mapInArrow(_output_marks, _MARKS)
    at, p, s, m, plain = *(F.col(c) for c in ("at", "p_at", "s_at", "m_at")), F.col("how") == "plain"
    part = F.when(plain, 0).when(at == 0, -1).when(at > m, 1).when((at > p) & ~((s > p) & (at > s)), 0).otherwise(2)
    texts = pieces.join(marks.hint("shuffle_hash"), "k").where(plain | (at == 0) | ((at != p) & (at != s) & (at != m)))
    # all columns of the pieces stay in use, so that both branches have the same exchange
    texts = texts.select("k", "piece", "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", part.alias("part"), "at").sortWithinPartitions("k", "part", "at").drop("part", "at")
    return texts.mapInArrow(_restored, _DIGESTS)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut at two drawn units; a tenth plain, a fifth of the others suffix first."""
    return save(fim_digests(table(spark, sf_dir, "documents")), "fim-digests")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
       WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:n], '') AS s FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256
FROM c
"""
