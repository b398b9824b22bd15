"""Language-model scores from a log-frequency Bloom filter.

The model is an interpolated bigram model over all training tokens. Each n-gram's count is quantised
to level 1 + floor(log_base(count)), and the filter holds (n-gram, 1) .. (n-gram, level), so repeated
membership probes, upwards until one fails, give the level back; a false positive can only raise it.
Every training unigram and bigram is held at every size of the corpus, so the whole filter has no
bound and is never put together: it stays in segments of the fingerprints' high bits.

How counts move: each batch counts, for each of its blocks of documents, the block's n-grams (sorted
fingerprints, cut into segments by their high bits) and sends packed runs, not rows, so a word that
every document holds costs one entry a block. A task per segment sums the runs, sets the segment's
bits of the filter, probes them, and answers each block with its n-grams' levels and its tokens'
exact counts, in the block's own order. Documents move once, to meet their block's answers.

Defined results: null and empty text is the end token alone; a null id teaches and isn't held out;
equal rows get equal results; without training tokens every count is 0; an empty table gives an
empty table. Blocks come from a row's file and place in it; what is no scan of files is written first.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BASE, BITS, HASHES = 1.5, 10, 4
UNIT = 1  # the least count that has a level
MOST = 64  # levels
BLOCK = 2048  # rows, or more where there would be more than BLOCKS blocks
BLOCKS = 1 << 22
PARTS = 20_000  # most tasks that segments and blocks are dealt to
SEGMENT_BITS = 20  # most segments, as a power of two: one for each two blocks until then
_END = np.uint64(0x243F6A8885A308D3)
_PAIR = np.uint64(0xD1B54A32D192ED03)
_RUN = "segment long, block long, fps binary, counts binary"
_ANSWER = "kind int, segment long, block long, levels binary, counts binary, n_distinct long, n_total long"


def _pack(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes: in sorted runs the high ones nearly vanish."""
    x = np.ascontiguousarray(x)
    return zlib.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def _unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints of all tokens, an end after each document; documents' first tokens, with the total last; documents)."""
    w = C.Words(C.LOWER[data], offs)
    n = len(offs) - 1
    first = w.first + np.arange(n + 1)
    out = np.full(first[-1], _END)
    out[np.arange(len(w.start)) + w.doc] = w.hash
    return out, first, np.repeat(np.arange(n), np.diff(first))


def pairs(fps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprint of each token with the one before it; the end stands before a document's first."""
    before = np.empty_like(fps)
    before[1:] = fps[:-1]
    if len(fps):
        before[first[:-1]] = _END
    return C.mix(before * _PAIR ^ fps)


def _runs(block: int, fps: np.ndarray, counts: np.ndarray, bits: int):
    """One run for each segment that has any."""
    cut = np.searchsorted(fps, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
    cut = np.append(cut, len(fps))
    for s in np.flatnonzero(np.diff(cut)):
        a, b = cut[s], cut[s + 1]
        yield int(s), block, _pack(fps[a:b]), _pack(counts[a:b].astype(np.uint64))


def _count(bits: int):
    """Batches of (block, held, text) to runs: a block's n-grams, with twice their training counts and one more for tokens."""

    def make():
        def each(batch: pa.RecordBatch):
            block, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            own: dict[int, list] = {}
            for lo, hi, data, offs in C.slices(batch.column(2)):
                fps, first, doc = tokens(data, offs)
                two = pairs(fps, first)
                teach = ~held[lo:hi][doc]
                b = block[lo:hi][doc]
                for x in np.unique(block[lo:hi]):
                    at = b == x
                    own.setdefault(int(x), []).append((fps[at], two[at], teach[at]))
            while own:
                x, parts = own.popitem()
                fps, two, teach = (np.concatenate(p) for p in zip(*parts, strict=True))
                some, which = np.unique(np.concatenate([fps, two]), return_inverse=True)
                n = np.bincount(which, weights=np.concatenate([teach, teach]), minlength=len(some)).astype(np.uint64) << np.uint64(1)
                n[which[: len(fps)]] |= np.uint64(1)
                rows = list(_runs(x, some, n, bits))
                for i in range(0, len(rows), 256):
                    c = list(zip(*rows[i : i + 256], strict=True))
                    yield [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.binary())]

        return each

    return make


def levels(n: np.ndarray, unit: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.minimum(np.where(n >= unit, 1 + np.floor(np.log(np.maximum(n, 1) / unit) / math.log(BASE) + 1e-9), 0), MOST).astype(np.int64)


def _places(fps: np.ndarray, level: int, size: np.ndarray | int):
    """The bits of (fingerprint, level), one array for each hash function."""
    h = C.mix(fps + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    step = h >> np.uint64(32) | np.uint64(1)
    for i in range(HASHES):
        yield (h + np.uint64(i) * step) % np.uint64(size) if np.isscalar(size) else (h + np.uint64(i) * step) % size


def segment_bits(fps: np.ndarray, n: np.ndarray, unit: int) -> np.ndarray:
    """The filter's bytes for these n-grams."""
    level = levels(n, unit)
    size = max(64, -(-int(level.sum()) * BITS // 64) * 64)
    bits = np.zeros(size, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        for at in _places(fps[level >= j], j, size):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


def _segment(table: pa.Table) -> pa.Table:
    block, fps, counts = table["block"].to_numpy(), table["fps"], table["counts"]
    blocks: dict[int, list] = {}
    for i in range(len(block)):
        blocks.setdefault(int(block[i]), []).append((_unpack(fps[i].as_py(), np.uint64), _unpack(counts[i].as_py(), np.uint64)))
    # A block's runs of several batches become one.
    every = {}
    for b, parts in blocks.items():
        some, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        both = np.concatenate([p[1] for p in parts])
        token = np.zeros(len(some), bool)
        token[which[both & np.uint64(1) > 0]] = True
        every[b] = some, np.bincount(which, weights=both >> np.uint64(1), minlength=len(some)), token
    known, which = np.unique(np.concatenate([x[0] for x in every.values()]), return_inverse=True)
    n = np.bincount(which, weights=np.concatenate([x[1] for x in every.values()]), minlength=len(known)).astype(np.int64)
    is_token = np.zeros(len(known), bool)
    is_token[which[np.concatenate([x[2] for x in every.values()])]] = True
    taught = n > 0
    level = Filter({0: segment_bits(known[taught], n[taught], UNIT).tobytes()}, 0).level(known).astype(np.uint8)
    segment, at = table["segment"][0].as_py(), 0
    rows = [(0, segment, 0, None, None, int((taught & is_token).sum()), int(n[is_token].sum()))]
    for b, (some, _, token) in every.items():
        mine = which[at : at + len(some)]
        at += len(some)
        rows.append((1, segment, b, _pack(level[mine]), _pack(n[mine[token]].astype(np.uint64)), 0, 0))
    c = list(zip(*rows, strict=True))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["kind", "segment", "block", "levels", "counts", "n_distinct", "n_total"])


class Filter:
    """All segments; probes many n-grams at once."""

    def __init__(self, segments: dict[int, bytes], bits: int):
        self.bits = bits
        size = np.array([len(segments.get(s, b"\0" * 8)) for s in range(1 << bits)], np.int64)
        self.start, self.size = (np.cumsum(size) - size) * 8, (size * 8).astype(np.uint64)
        self.body = np.frombuffer(b"".join(segments.get(s, b"\0" * 8) for s in range(1 << bits)), np.uint8)

    def level(self, fps: np.ndarray) -> np.ndarray:
        """Of each fingerprint: the number of levels present in a row from 1."""
        out = np.zeros(len(fps), np.int64)
        live = np.arange(len(fps))
        seg = (fps >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(fps), np.int64)
        for j in range(1, MOST + 1):
            there = np.ones(len(live), bool)
            size, start = self.size[seg[live]], self.start[seg[live]]
            for at in _places(fps[live], j, size):
                at = start + at.astype(np.int64)
                there &= (self.body[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            live = live[there]
            if not len(live):
                break
            out[live] = j
        return out


def expected(level: np.ndarray, unit: int) -> np.ndarray:
    """The count that a level stands for: the middle of its interval, 0 for level 0."""
    low = unit * BASE ** (level - 1.0)
    return np.where(level > 0, np.maximum(low, low * (1 + BASE) / 2 - 0.5), 0.0)


def _scorer(total: int, distinct: int, smooth: float):
    def run(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        order = np.argsort(answers["segment"].to_numpy(), kind="stable")
        read = lambda name, kind: np.concatenate([np.empty(0, kind), *(_unpack(answers[name][int(i)].as_py(), kind) for i in order)])
        count, level = read("counts", np.uint64).astype(np.float64), read("levels", np.uint8)
        parts = [tokens(data, offs) for _, _, data, offs in C.slices(docs["text"])]
        known = np.unique(np.concatenate([p[0] for p in parts]))
        every = np.unique(np.concatenate([known, *(pairs(fps, first) for fps, first, _ in parts)]))
        floor = total + 0.1 * (distinct + 1)
        base = np.log10((count + 0.1) / floor)
        many = expected(level, UNIT)
        one = many[np.searchsorted(every, known)]  # of a context, and for the lower order
        out = []
        for fps, first, doc in parts:
            n = len(first) - 1
            at = np.searchsorted(known, fps)
            both = many[np.searchsorted(every, pairs(fps, first))]
            end = one[np.searchsorted(known, _END)]
            before = np.empty(len(fps))
            before[1:] = one[at[:-1]]
            before[first[:-1]] = end
            low = (one[at] + 0.1) / (total + 0.1 * (distinct + 1))
            p = (np.minimum(both, before) + smooth * low) / (before + smooth)
            out.append((np.diff(first), np.bincount(doc, weights=count[at] > 0, minlength=n), np.bincount(doc, weights=base[at], minlength=n), np.bincount(doc, weights=np.log10(np.minimum(p, 1.0)), minlength=n)))
        n, hit, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([docs["id"], docs["held"], pa.array(n.astype(np.int64)), pa.array(hit.astype(np.int64)), pa.array(np.full(len(n), total, np.int64)), pa.array(b), pa.array(s)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text", smooth: float = 20.0) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); rows for which held is true teach nothing."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # not a file scan: written first, so that a row keeps its place
        text = C.free_name(docs, "_held")
        docs, held = C.checkpoint(docs.select(id_col, text_col, F.coalesce(held, F.lit(False)).alias(text))), F.col(text)
    size = docs.count()
    rows = max(BLOCK, size // BLOCKS)
    block = F.xxhash64("_metadata.file_path", F.expr(f"_metadata.row_index div {rows}"))
    kind = docs.schema[id_col].dataType.simpleString()
    each = docs.select(F.col(id_col).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).alias("text"), block.alias("block"))
    # About as many segments as blocks: a segment's task holds its share of the runs, whatever the size of the corpus.
    bits = min(SEGMENT_BITS, max(4, int(size // rows).bit_length()))
    # And a task for each block, so that a task's share keeps its size too.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(PARTS, int(size // rows)))
    runs = C.arrow_map(each, ["block", "held", "text"], _RUN, _count(bits))
    answers = C.checkpoint(runs.repartition(parts, "segment").groupBy("segment").applyInArrow(_segment, _ANSWER))
    stats = answers.where("kind = 0").agg(F.sum("n_distinct"), F.sum("n_total")).first()
    distinct, total = (stats[0] or 0), (stats[1] or 0)
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    back = answers.where("kind = 1").select("block", "segment", "levels", "counts")
    scored = each.repartition(parts, "block").groupBy("block").cogroup(back.repartition(parts, "block").groupBy("block")).applyInArrow(_scorer(total, distinct, smooth), schema)
    return scored.withColumnRenamed("id", id_col)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document; a tenth, by crc32 of the id, is held out."""
    return score(C.documents(spark, sf_dir), C.crc_mod("doc_id", 10) == 0)
