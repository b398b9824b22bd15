"""Benchmark decontamination with an FM-index of every training shard.

A shard is one Arrow batch of documents. Its words become symbols of the phrases' alphabet: a word
that no phrase holds can't be part of a match, so it is a separator, and runs between separators
shorter than the shortest phrase can't hold one, so they shrink to the separator. Over what is left
the shard gets a suffix array (prefix doubling), its Burrows-Wheeler transform in a wavelet matrix
with popcount ranks, and every ``SAMPLE``-th suffix position. All phrases are searched backwards at
once; each occurrence is located by LF steps to a sampled position; the spans are merged per
document. Documents never move: the whole operator is a map, whatever is frequent or copied.

The phrases are sent with the tasks. They are a test set, and its size is checked: items are dealt
into blocks of about ``block_windows`` windows at most (an item is never cut), each a pass of its own
over the documents. A pass ends, with its result written, before the next begins, so neither the driver
nor a worker holds more than one block.

Defined results: null or empty text has no words and no hits; an item without words is ignored, one
with fewer than n words is one window; equal windows of several items count for all of them; a
null item id is named by an empty text; equal
rows get equal results; other columns pass through, whatever their names; an empty benchmark or
documents table gives no hits or no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SAMPLE = 8


class FMIndex:
    """Of an integer sequence; counts and locates patterns, vectorised over patterns."""

    def __init__(self, seq: np.ndarray, sigma: int):
        # 0 ends the sequence; symbols count from 1.
        text = np.append(seq.astype(np.int64) + 1, 0)
        n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n, self.c = n, np.searchsorted(np.sort(text), np.arange(sigma + 2))
        self.levels = max(1, int(sigma).bit_length())
        self.bits, self.dirs, self.zeros = [], [], []
        x = bwt
        for level in reversed(range(self.levels)):
            bit = (x >> level & 1).astype(bool)
            words = np.packbits(np.append(bit, np.zeros(-n % 64 + 64, bool)), bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.dirs.append(np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))[:-1])
            self.zeros.append(n - int(bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])
        at = sa % SAMPLE == 0
        self.marks, self.mark_dir = self._pack(at)
        self.samples = sa[at]

    @staticmethod
    def _pack(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.packbits(np.append(flags, np.zeros(-len(flags) % 64 + 64, bool)), bitorder="little").view(np.uint64)
        return words, np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))[:-1]

    @staticmethod
    def _ones(words: np.ndarray, sums: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Set bits before i."""
        w = i >> 6
        return sums[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, sym: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before i."""
        lo, hi = np.zeros_like(i), i
        for k, level in enumerate(reversed(range(self.levels))):
            one = (sym >> level & 1).astype(bool)
            a, b = self._ones(self.bits[k], self.dirs[k], lo), self._ones(self.bits[k], self.dirs[k], hi)
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def back(self, i: np.ndarray) -> np.ndarray:
        """LF: the row of the suffix one place to the left."""
        sym, at = np.zeros_like(i), i
        lo = np.zeros_like(i)
        for k in range(self.levels):
            one = (self.bits[k][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a, b = self._ones(self.bits[k], self.dirs[k], lo), self._ones(self.bits[k], self.dirs[k], at)
            lo = np.where(one, self.zeros[k] + a, lo - a)
            at = np.where(one, self.zeros[k] + b, at - b)
            sym = sym << 1 | one
        return self.c[sym] + at - lo

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of patterns (rows, right-aligned, of the given sizes)."""
        m, width = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for step in range(width):
            live = np.flatnonzero((sizes > step) & (lo < hi))
            if not len(live):
                break
            sym = patterns[live, width - 1 - step].astype(np.int64) + 1
            lo[live], hi[live] = self.c[sym] + self.rank(sym, lo[live]), self.c[sym] + self.rank(sym, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffix rows."""
        out, steps, live = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        at = rows
        while len(live):
            hit = (self.marks[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            out[live[hit]] = self.samples[self._ones(self.marks, self.mark_dir, at[hit])] + steps[live[hit]]
            live, at = live[~hit], at[~hit]
            steps[live] += 1
            at = self.back(at)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of integers whose last is the least and unique, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        sa = np.argsort(key, kind="stable")
        key = key[sa]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(key[1:] != key[:-1])
        rank = np.empty(n, np.int64)
        rank[sa] = new
        if new[-1] == n - 1:
            return sa
        k *= 2


def scan(data: np.ndarray, offs: np.ndarray) -> C.Words:
    """Words of lower-cased ASCII letters, digits and all that isn't ASCII."""
    return C.Words(C.LOWER[data], offs, C.NOT_ALNUM)


class Phrases:
    """The windows of some items: their alphabet, symbol rows, and the items of each window."""

    def __init__(self, ids: list, texts: list[str | None], n: int):
        words = [scan(data, offs) for _, _, data, offs in C.slices(pa.array(texts, pa.string()), 1 << 40)]
        self.n, self.items = n, ids
        if not words or not len(words[0].start):
            self.alphabet, self.sizes = np.empty(0, np.uint64), np.empty(0, np.int64)
            return
        w = words[0]
        self.alphabet, sym = np.unique(w.hash, return_inverse=True)
        rows, of = [], []
        for i, (a, size) in enumerate(zip(w.first, w.counts, strict=False)):
            own = sym[a : a + size] + 1  # 0 is the separator
            for j in range(max(1, size - n + 1) if size else 0):
                part = own[j : j + n]
                rows.append(np.concatenate([np.zeros(n - len(part), np.int64), part]))
                of.append(i)
        table, which = np.unique(np.array(rows), axis=0, return_inverse=True)
        self.table, self.sizes = table, (table > 0).sum(1)
        # Windows of the same items share a set of them.
        own = np.unique(np.stack([which.ravel(), np.array(of)]), axis=1)
        parts = [tuple(x.tolist()) for x in np.split(own[1], np.flatnonzero(np.diff(own[0])) + 1)]
        number = {x: i for i, x in enumerate(dict.fromkeys(parts))}
        self.set_of = np.array([number[x] for x in parts])
        self.owner = np.concatenate([np.array(x) for x in number])  # item numbers by set
        self.owner_first = np.cumsum([0, *map(len, number)])

    def match(self, texts: pa.Array) -> tuple[list[C.Words], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word counts of the documents; (document, first word, word after the last, window) of each occurrence."""
        counts, syms, docs, at = [], [], [], []
        for lo, _, data, offs in C.slices(texts):
            w = scan(data, offs)
            counts.append(w.counts)
            if not len(self.sizes) or not len(w.start):
                continue
            i = np.searchsorted(self.alphabet, w.hash)
            known = self.alphabet[np.minimum(i, len(self.alphabet) - 1)] == w.hash
            # Runs of known words in one document, long enough for the shortest window.
            cut = np.ones(len(known) + 1, bool)
            cut[1:-1] = ~known[1:] | ~known[:-1] | (w.doc[1:] != w.doc[:-1])
            first = np.flatnonzero(cut[:-1] & known)
            size = np.append(np.flatnonzero(cut), len(known) + 1)
            size = size[np.searchsorted(size, first, "right")] - first
            long = size >= self.sizes.min()
            first, size = first[long], size[long]
            total = int(size.sum() + len(size))
            if not total:
                continue
            head = np.cumsum(size + 1) - size - 1
            pos = np.arange(total) - np.repeat(head, size + 1) + np.repeat(first, size + 1)
            pos[head + size] = -1
            syms.append(np.where(pos < 0, 0, i[pos] + 1))
            docs.append(np.where(pos < 0, -1, w.doc[pos] + lo))
            at.append(np.where(pos < 0, -1, pos - w.first[w.doc[pos]]))
        counts = np.concatenate(counts) if counts else np.empty(0, np.int64)
        none = np.empty(0, np.int64)
        if not syms:
            return counts, none, none, none, none
        seq, doc, word = map(np.concatenate, (syms, docs, at))
        index = FMIndex(seq, len(self.alphabet) + 1)
        lo, hi = index.search(self.table, self.sizes)
        found = np.flatnonzero(hi > lo)
        n = (hi - lo)[found]
        window = np.repeat(found, n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[found], n)
        pos = index.locate(rows)
        return counts, doc[pos], word[pos], word[pos] + self.sizes[window], window


_OUT = (T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType()), T.LongType())


def _finder(phrases: Phrases, has_spans: bool):
    """Adds spans (first word, word after the last, ...), items and the number of words to each row of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1 - 3 * has_spans)
            counts, doc, start, end, window = phrases.match(texts)
            n = batch.num_rows
            if len(window):
                sets = len(phrases.owner_first) - 1
                pair = np.unique(doc * sets + phrases.set_of[window])  # however often a document holds windows of the same items
                of, own = pair // sets, pair % sets
                size = phrases.owner_first[own + 1] - phrases.owner_first[own]
                flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(phrases.owner_first[own], size)
                pair = np.unique(np.repeat(of, size) * len(phrases.items) + phrases.owner[flat])
                item_doc, item = pair // len(phrases.items), pair % len(phrases.items)
            else:
                item_doc = item = np.empty(0, np.int64)
            names = [str(phrases.items[i]) for i in item]
            if has_spans:
                old = batch.column(batch.num_columns - 3)
                flat = old.flatten().to_numpy().reshape(-1, 2)
                own = np.repeat(np.arange(n), old.value_lengths().to_numpy() // 2)
                doc, start, end = np.concatenate([own, doc]), np.concatenate([flat[:, 0], start]), np.concatenate([flat[:, 1], end])
                old = batch.column(batch.num_columns - 2)
                pairs = sorted({*zip(item_doc.tolist(), names, strict=True), *zip(np.repeat(np.arange(n), old.value_lengths().to_numpy()).tolist(), old.flatten().to_pylist(), strict=True)})
                item_doc, names = np.array([p[0] for p in pairs], np.int64), [p[1] for p in pairs]
            doc, start, end = C.pad_spans(doc, start, end)
            spans = C.nested(np.stack([start, end], 1).astype(np.int32).ravel(), 2 * np.bincount(doc, minlength=n))
            items = C.nested(np.array(names, object), np.bincount(item_doc, minlength=n), pa.string())
            keep = batch.columns[: batch.num_columns - 3 * has_spans]
            yield pa.RecordBatch.from_arrays([*keep, spans, items, pa.array(counts)], names=[f"c{i}" for i in range(len(keep) + 3)])

    return run


def find_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = 10, item_id: str = "item_id", item_text: str = "text", block_windows: int = 200_000) -> tuple[DataFrame, tuple[str, str, str]]:
    """docs with merged hit spans (word numbers, flat), hit items (text, distinct) and word count, and those columns' names."""
    names = tuple(C.free_name(docs, x) for x in ("_spans", "_items", "_words"))
    # As many windows as bytes / 2 at most, so a block of so many bytes has no more than block_windows.
    bench = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * block_windows)))
    text = C.free_name(docs, "_text")
    out = docs.withColumn(text, F.col(text_col))
    for b in range(blocks):
        own = bench.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").toPandas()  # bounded: see above
        phrases = Phrases(own["id"].tolist(), own["text"].tolist(), n)
        schema = docs.withColumn(text, F.col(text_col)).schema
        for name, kind in zip(names, _OUT, strict=True):
            schema = schema.add(name, kind)
        out = (C.checkpoint(out) if b else out).mapInArrow(_named(_finder(phrases, b > 0), [f.name for f in schema]), schema)
    return out.drop(text), names


def _named(run, names: list[str]):
    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=names)

    return renamed


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = 10) -> DataFrame:
    """docs whose texts lose what stands from the first to the last byte of each merged span."""
    found, (spans, *_) = find_spans(docs, benchmark, text_col, n)

    at, of = found.columns.index(text_col), found.columns.index(spans)

    def parts(batch: pa.RecordBatch):
        texts, hits = batch.column(at), batch.column(of).to_pylist()
        for lo, hi, data, offs in C.slices(texts):
            w, body, out = scan(data, offs), data.tobytes(), texts.slice(lo, hi - lo).to_pylist()
            for r in range(hi - lo):
                flat = hits[lo + r]
                if flat:
                    kept, last = [], offs[r]
                    for s, e in zip(flat[::2], flat[1::2], strict=True):
                        kept.append(body[last : w.start[w.first[r] + s]])
                        last = w.end[w.first[r] + e - 1]
                    out[r] = b"".join([*kept, body[last : offs[r + 1]]]).decode()
            yield lo, hi, pa.array(out, pa.string())

    return C.widened(found, {text_col: "string"}, parts).select(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside any 10-word window of a benchmark item."""
    found, (spans, items, words) = find_spans(C.documents(spark, sf_dir).select("doc_id", "text"), C.documents(spark, sf_dir, "benchmark"))

    def each(b: pa.RecordBatch) -> list[pa.Array]:
        flat = b.column(1).flatten().to_numpy().reshape(-1, 2)
        hit = C.by_document(flat[:, 1] - flat[:, 0], np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy() // 2), b.num_rows)
        names = [sorted(set(x)) for x in b.column(2).to_pylist()]
        return [b.column(0), b.column(3), pa.array(hit), pa.array([len(x) for x in names], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array(hit > 0)]

    return C.arrow_map(found, ["doc_id", spans, items, words], "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", lambda: each)


SQL = r"""
WITH lowered AS (SELECT doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, 0 AS b FROM documents
  UNION ALL SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 1 FROM benchmark),
w AS (SELECT id, b, regexp_extract_all(coalesce(t, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM lowered),
items AS (SELECT DISTINCT id AS item_id, least(10, len(a)) AS k, array_to_string(a[i : i + least(10, len(a)) - 1], ' ') AS win
  FROM (SELECT id, a, unnest(range(1, greatest(1, len(a) - 9) + 1)) AS i FROM w WHERE b = 1 AND len(a) > 0)),
hits AS (SELECT d.id AS doc_id, d.i, x.k, x.item_id FROM
  (SELECT id, i, k, array_to_string(a[i : i + k - 1], ' ') AS win
   FROM (SELECT id, a, unnest(range(1, len(a) + 1)) AS i FROM w WHERE b = 0), (SELECT DISTINCT k FROM items) WHERE i + k - 1 <= len(a)) d
  JOIN items x ON d.win = x.win AND d.k = x.k),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, CAST(len(a) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered c ON c.doc_id = id LEFT JOIN named m ON m.doc_id = id WHERE b = 0
"""
