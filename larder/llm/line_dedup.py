"""Line dedup over the whole corpus, by range-partitioned line hashes.

Each document sends one row for each of its different line keys (128-bit hash, document, line
numbers). Rows are range-partitioned and sorted by (hash, document), so a key that a third of all
documents hold is spread over many partitions. Each partition streams its rows: a run of a key is
settled as soon as ``min_docs`` documents are seen, so at most that many rows wait. Only the first
and the last run of a partition can go on in another one; their counts (two rows a partition) and
waiting rows (fewer than min_docs each) are summed up by key afterwards. What comes back is not
text but a compressed keep bitmap for each document that loses or, with ``keep_first``, keeps lines.

Defined results: null or empty text is one empty line; a key shorter than ``min_chars`` code points
never counts; rows with equal id and equal text are one document (each still gets its result), rows
with equal id and other text are different documents; null ids are allowed; other columns pass
through ``drop_lines`` untouched, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

_BLANK = b" \t\n\x0b\x0c\r"
_KEYED = "h1 long, h2 long, doc long, th long, lines array<int>"
_SEEN = "kind int, h1 long, h2 long, n long, doc long, th long, lines array<int>"


def line_keys(text: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose key is long enough."""
    keys = ((i, x.strip(_BLANK).lower()) for i, x in enumerate(text.split(b"\n")))
    return [(i, k) for i, k in keys if len(k) >= min_chars and (min_chars <= 1 or len(k.decode()) >= min_chars)]


def _rows(min_chars: int):
    """A row for each document and different key, slice by slice."""

    def each(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        docs, ths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        for lo, _, data, offs in C.slices(batch.column(2)):
            body, h, of, lines, sizes = data.tobytes(), [], [], [], []
            for r in range(len(offs) - 1):
                own: dict[bytes, list[int]] = {}
                for i, k in line_keys(body[offs[r] : offs[r + 1]], min_chars):
                    own.setdefault(k, []).append(i)
                for k, at in own.items():
                    h.append(xxhash.xxh3_128_digest(k))
                    of.append(lo + r)
                    lines += at
                    sizes.append(len(at))
            if h:
                two, of = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2), np.array(of, np.int64)
                yield [pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(docs[of]), pa.array(ths[of]), C.nested(np.array(lines, np.int32), np.array(sizes, np.int64))]

    return lambda: each


def _changes(last: tuple, *columns: np.ndarray) -> np.ndarray:
    """Flags of rows that differ from the one before; last stands before the first (empty: nothing does)."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    new[0] = not last or last != tuple(int(c[0]) for c in columns)
    return new


def _stream(min_docs: int, keep_first: bool):
    """Over sorted rows: kind 0 is settled (its lines go), 1 waits for its key's total, 2 is a run's count at the border of a partition."""

    def out(kind: int, rows: pa.RecordBatch, n: int = 0) -> pa.RecordBatch:
        h1, h2, doc, th, lines = rows.columns
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h1), kind, np.int32)), h1, h2, pa.array(np.full(len(h1), n, np.int64)), doc, th, lines], names=["kind", "h1", "h2", "n", "doc", "th", "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the run that goes on: its last row, number of documents, rows that wait, whether it opened the partition.
        last, docs, wait, opened = (), 0, [], True

        def ended(border: bool) -> Iterator[pa.RecordBatch]:
            if border and last:
                empty = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], pa.int32()))
                yield out(2, pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*last[:2], 0, 0)] + [empty], names=_NAMES), docs)
                yield from (out(1, w) for w in wait)

        for batch in batches:
            if not batch.num_rows:
                continue
            # Repeated rows of a document count once.
            batch = batch.filter(pa.array(_changes(last, *(batch.column(i).to_numpy() for i in range(4)))))
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(4)]
            n = len(cols[0])
            new = _changes(last[:2], *cols[:2])
            if new[0]:
                yield from ended(opened)
                opened, docs, wait = not last, 0, []
            new[0] = True
            head = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            at = np.arange(n) - head[group]
            at[group == 0] += docs
            total = np.diff(np.append(head, n))
            total[0] += docs
            goes = total[group] >= min_docs
            if keep_first:  # the first row of a run that crosses a border must be compared: it waits
                goes &= at > 0
            if docs < min_docs <= total[0]:
                yield from (out(0, w) for w in wait[keep_first:])
                wait = wait[:keep_first]
            if goes.any():
                yield out(0, batch.filter(pa.array(goes)))
            docs = int(total[0])
            for g in sorted({0, len(head) - 1}):  # the run that came in and the one that goes on
                if g:
                    yield from ended(opened)
                    opened, docs, wait = False, int(total[g]), []
                last = tuple(int(c[head[g]]) for c in cols)
                wait += [batch.slice(i, 1) for i in np.flatnonzero(~goes & (group == g)).tolist()]
            last = tuple(int(c[-1]) for c in cols)
        yield from ended(True)

    return run


_NAMES = ["h1", "h2", "doc", "th", "lines"]


def _pack(lists: pa.ListArray) -> pa.Array:
    """zlib of packed bits, 1: the line stays; lines past the end stay."""
    out, flat = [], lists.flatten().to_numpy()
    ends = np.cumsum(lists.value_lengths().to_numpy())
    for at in np.split(flat, ends[:-1]):
        bits = np.ones(at.max() + 1, np.uint8)
        bits[at] = 0
        out.append(zlib.compress(np.packbits(bits).tobytes() + bytes([len(bits) % 8]), 1))
    return pa.array(out, pa.binary())


def unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    """Keep flags of n lines."""
    keep = np.ones(n, bool)
    if bitmap is not None:
        raw = zlib.decompress(bitmap)
        bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8))
        bits = bits[: len(bits) - (-raw[-1]) % 8]
        keep[: len(bits)] = bits.astype(bool)
    return keep


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """One row (doc, th, bitmap) for each document that loses lines; th is xxhash64 of the text.

    keep_first: a key's first document, in order of id, keeps its lines.
    """
    keyed = C.arrow_map(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text")), ["doc", "th", "text"], _KEYED, _rows(min_chars))
    keyed = keyed.repartitionByRange("h1", "h2", "doc", "th").sortWithinPartitions("h1", "h2", "doc", "th")
    seen = C.checkpoint(keyed.mapInArrow(_stream(min_docs, keep_first), _SEEN))
    # A key at a border: what waited goes if all partitions together saw enough documents. With keep_first its least document stays.
    totals = seen.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("total"))
    waiting = seen.where("kind = 1").join(F.broadcast(totals), ["h1", "h2"]).where(F.col("total") >= min_docs)  # two rows a partition at most
    if keep_first:
        least = seen.where("kind = 1").groupBy("h1", "h2").agg(F.min(F.struct("doc", "th")).alias("least"))
        waiting = waiting.join(F.broadcast(least), ["h1", "h2"]).where(F.struct("doc", "th") != F.col("least"))
    gone = seen.where("kind = 0").select("doc", "th", "lines").unionByName(waiting.select("doc", "th", "lines"))
    lists = gone.groupBy("doc", "th").agg(F.flatten(F.collect_list("lines")).alias("lines"))
    return C.arrow_map(lists, ["doc", "th", "lines"], "doc long, th long, bitmap binary", lambda: lambda b: [b.column(0), b.column(1), _pack(b.column(2))])


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> tuple[DataFrame, str]:
    """docs with the bitmap column (null: all lines stay) and that column's name."""
    d, t, name = C.free_name(docs, "_doc"), C.free_name(docs, "_th"), C.free_name(docs, "_bitmap")
    maps = keep_bitmaps(docs, id_col, text_col, **how).select(F.col("doc").alias(d), F.col("th").alias(t), F.col("bitmap").alias(name))
    keyed = docs.withColumn(d, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))).withColumn(t, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return keyed.join(maps, [d, t], "left").drop(d, t), name


def _kept(texts: pa.Array, bitmaps: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    """(lines, lines dropped, kept text) of each document."""
    maps = bitmaps.to_pylist()
    for lo, _, data, offs in C.slices(texts):
        body = data.tobytes()
        for r in range(len(offs) - 1):
            text = body[offs[r] : offs[r + 1]]
            if maps[lo + r] is None:
                yield text.count(b"\n") + 1, 0, text
            else:
                lines = text.split(b"\n")
                keep = unpack(maps[lo + r], len(lines))
                yield len(lines), int((~keep).sum()), b"\n".join([x for x, k in zip(lines, keep, strict=True) if k])


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with the common lines gone from text_col; a null text stays null."""
    both, name = with_bitmaps(docs, id_col, text_col, **how)

    at, of = both.columns.index(text_col), both.columns.index(name)

    def parts(batch: pa.RecordBatch):
        texts, maps = batch.column(at), batch.column(of)
        for lo, hi, _, _ in C.slices(texts):
            own = texts.slice(lo, hi - lo)
            kept = [x.decode() if n else t for (_, n, x), t in zip(_kept(own, maps.slice(lo, hi - lo)), own.to_pylist(), strict=True)]
            yield lo, hi, pa.array(kept, pa.string())

    return C.widened(both, {text_col: "string"}, parts).select(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents lose all their copies."""
    both, name = with_bitmaps(C.documents(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1)

    def each(b: pa.RecordBatch) -> list[pa.Array]:
        rows = [(n, gone, hashlib.sha256(x).hexdigest()) for n, gone, x in _kept(b.column(1), b.column(2))]  # the texts go one by one
        return [b.column(0), *map(pa.array, zip(*rows, strict=True))]

    return C.arrow_map(both, ["doc_id", "text", name], "doc_id long, n_lines long, n_dropped long, kept_sha256 string", lambda: each)


SQL = r"""
WITH l AS (SELECT doc_id, u.i, u.line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
             LATERAL (SELECT unnest(a) AS line, unnest(range(len(a))) AS i) u),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY doc_id
"""
