"""Exact substring dedup by seeds and their extension.

A window is ``n`` consecutive words. Winnowing picks one anchor in each window: of its n - k + 1
runs of k words the one with the least hash (the last of equals). The choice depends on the
window's words only, so equal windows have equal anchors at equal places, and no match is lost.
An anchor owns a run of neighbouring windows; their words to the left and right are its reach.

Seeds: occurrences join on the anchor's hash. Extension both ways: occurrences whose whole reach is
equal (128-bit hash of reach and place) agree in all their windows, so all but the earliest go, and
overlapping reaches merge to the maximal repeat. Where an anchor has several reaches, only the
earliest occurrence of each is extended window by window: its windows join on the window's 128-bit
hash, and all but the earliest go. No member of a group is ever paired with the others.

Each level settles what it can before it is shuffled: within a batch, only the earliest of equal
reaches (equal windows) is sent on, so a passage that a third of all documents hold costs a row for
each batch. Seeds are range-partitioned by (anchor, reach), which also spreads hot anchors; at a
partition's border an occurrence counts as earliest and falls to the exact window level.

Defined results: null or empty text, or one of fewer than n words, loses nothing. Rows of equal id
are one document; where their texts differ, equal starts are ordered by the text's hash; equal rows
lose the same words. A null id comes before all others. Other columns pass through
``remove_repeats`` untouched, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

_SEED = "kind int, a long, c long, doc long, pos long"
_BITS, _REACH = 24, 8
_MOST = (1 << _REACH) - 1
_NAME = 16  # low bits of a seed's a that belong to its reach; the others are the anchor's
# pos: start of the first owned window, then 24 bits of the text's hash, then the number of owned windows.


def _pos(start: np.ndarray, th: np.ndarray, size: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << (_BITS + _REACH) | th << _REACH | size


def _unpos(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> (_BITS + _REACH), pos >> _REACH & ((1 << _BITS) - 1), pos & ((1 << _REACH) - 1)


def anchors(w: C.Words, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first owned window, owned windows, anchor hash, reach hash of two lanes) of each anchor occurrence; positions count words of the slice."""
    at, gram = w.windows(k)
    width = n - k + 1
    if len(at) < width:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64), np.empty((0, 2), np.uint64))
    # Least hash of the next ``width`` runs, last of equals; runs of one document stand together.
    best, where = gram[: len(at) - width + 1].copy(), np.arange(len(at) - width + 1)
    for j in range(1, width):
        other = gram[j : j + len(best)]
        less = other <= best
        best[less] = other[less]
        where[less] = (np.arange(len(best)) + j)[less]
    ok = w.doc[at[: len(best)]] == w.doc[at[width - 1 :]]
    start, anchor = at[: len(best)][ok], where[ok]
    if not len(start):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64), np.empty((0, 2), np.uint64))
    new = np.ones(len(anchor), bool)
    # A run of owned windows is cut by their distance from the anchor, so that its length fits in _pos.
    part = (anchor - start) // _MOST
    new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(anchor)))
    s, g = start[head], anchor[head]
    place = C.mix((at[g] - s).astype(np.uint64))
    reach = np.stack([C.span_hash(w.lane(lane), s, s + size + n - 1) ^ place for lane in (0, 1)], 1)
    return s, size, gram[g], reach


def _sorted(*keys: np.ndarray) -> list[np.ndarray]:
    """The columns sorted by all of them, first key first, without repeated rows."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if len(order):
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        keys = [k[new] for k in keys]
    return keys


def _opens(*keys: np.ndarray) -> np.ndarray:
    """Flags of sorted rows that open a run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _settled(doc: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Rows of kind 0: window runs that go, merged per document; the key is spread and c is the run's length."""
    start, th, size = _unpos(pos)
    if len(doc):
        uniq, own = np.unique(np.stack([doc, th]), axis=1, return_inverse=True)
        own, start, end = C.pad_spans(own.ravel(), start, start + size)
        doc, th, size = uniq[0][own], uniq[1][own], end - start
    pos = _pos(start, th, np.zeros_like(start))
    key = C.mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ pos.astype(np.uint64)).view(np.int64)
    return [np.zeros(len(doc), np.int32), key, size.astype(np.int64), doc, pos]


def _rows(kind0: list[np.ndarray], kind1: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(np.concatenate(x)) for x in zip(kind0, [np.ones(len(kind1[0]), np.int32), *kind1], strict=True)]


def _seeds(n: int, k: int):
    """Anchor occurrences of a batch: kind 1 the earliest of each (anchor, reach), kind 0 the others' windows."""

    def make():
        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            docs, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = []
            for lo, _, data, offs in C.slices(batch.column(2)):
                w = C.Words(data, offs)
                s, size, a, c = anchors(w, n, k)
                d = w.doc[s]
                # a and c name the reach by 128 bits, a's high ones the anchor.
                a = a >> np.uint64(_NAME) << np.uint64(_NAME) | c[:, 1] >> np.uint64(64 - _NAME)
                found.append((a.view(np.int64), np.ascontiguousarray(c[:, 0]).view(np.int64), docs[lo + d], _pos(s - w.first[d], ths[lo + d], size)))
            a, c, doc, pos = _sorted(*map(np.concatenate, zip(*found, strict=True)))
            lead = _opens(a, c)
            return _rows(_settled(doc[~lead], pos[~lead]), [a[lead], c[lead], doc[lead], pos[lead]])

        return each

    return make


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over seeds sorted by (anchor, reach, document, place): kind 0 goes, kind 1 is to be compared by windows.

    Runs at a batch's border may go on beyond it; what opens them there is compared too, so no state is carried.
    """
    for batch in batches:
        kind, a, c, doc, pos = (batch.column(i).to_numpy() for i in range(5))
        old = kind == 0
        through = [x[old] for x in (kind, a, c, doc, pos)]
        a, c, doc, pos = _sorted(*(x[~old] for x in (a, c, doc, pos)))
        lead, head = _opens(a, c), _opens(a >> _NAME)
        group = np.cumsum(head) - 1
        reaches = np.bincount(group[lead]) if len(a) else np.empty(0, np.int64)
        several = reaches > 1
        several[[0, -1] if len(several) else []] = True
        ask = lead & several[group]
        gone = _settled(doc[~lead], pos[~lead])
        kind0 = [np.concatenate(x) for x in zip(through, gone, strict=True)]
        yield pa.RecordBatch.from_arrays(_rows(kind0, [x[ask] for x in (a, c, doc, pos)]), names=["kind", "a", "c", "doc", "pos"])


def _windows(n: int):
    """Joined documents to (kind, window hash or spread key, its second lane or a run's length, doc, pos): kind 1 the earliest of equal windows of a batch."""

    def make():
        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            docs, ths, asked = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            flat = asked.flatten()
            of = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy())
            kind, c, pos = (flat.field(i).to_numpy() for i in range(3))
            old = kind == 0
            gone = [np.zeros(old.sum(), np.int32), C.mix(c[old].astype(np.uint64) ^ C.mix(pos[old].astype(np.uint64) ^ docs[of[old]].astype(np.uint64))).view(np.int64), c[old], docs[of[old]], pos[old]]
            of, (start, _, size) = of[~old], _unpos(pos[~old])
            found = [(np.empty(0, np.int64),) * 4]
            for lo, hi, data, offs in C.slices(batch.column(2)):
                own = (of >= lo) & (of < hi)
                if not own.any():
                    continue
                w = C.Words(data, offs)
                d, s, m = of[own] - lo, start[own], size[own]
                at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(s, m)
                d = np.repeat(d, m)
                first = w.first[d] + at
                found.append((*(C.span_hash(w.lane(lane), first, first + n).view(np.int64) for lane in (0, 1)), docs[lo + d], _pos(at, ths[lo + d], np.ones_like(at))))
            h, h2, doc, pos = _sorted(*map(np.concatenate, zip(*found, strict=True)))
            lead = _opens(h, h2)
            more = _settled(doc[~lead], pos[~lead])
            kind0 = [np.concatenate(x) for x in zip(gone, more, strict=True)]
            return _rows(kind0, [h[lead], h2[lead], doc[lead], pos[lead]])

        return each

    return make


def _keyed(docs: DataFrame, id_col: str, text_col: str, d: str, t: str) -> DataFrame:
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit((1 << _BITS) - 1))
    return docs.withColumn(d, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))).withColumn(t, th)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 20) -> tuple[DataFrame, str]:
    """docs with the window runs that stand earlier too (array of first window << 32 | windows; null: none), and that column's name."""
    d, t, name = (C.free_name(docs, x) for x in ("_doc", "_th", "_repeats"))
    keyed = _keyed(docs, id_col, text_col, d, t)
    seeds = C.arrow_map(keyed.select(F.col(d).alias("doc"), F.col(t).alias("th"), F.col(text_col).alias("text")), ["doc", "th", "text"], _SEED, _seeds(n, -(-n // 2)))
    extended = seeds.repartitionByRange("a", "c").sortWithinPartitions("a", "c", "doc", "pos").mapInArrow(_extend, _SEED)
    th = F.shiftright("pos", _REACH).bitwiseAND(F.lit((1 << _BITS) - 1))
    asked = extended.groupBy("doc", th.alias("th")).agg(F.collect_list(F.struct("kind", "c", "pos")).alias(name))
    asked = asked.select(F.col("doc").alias(d), F.col("th").alias(t), name)
    # The same exchange of the documents serves this join and the last one.
    windows = C.arrow_map(keyed.join(asked, [d, t]), [d, t, text_col, name, *(c for c in docs.columns if c != text_col)], _SEED, _windows(n))
    later = windows.withColumn("rank", F.row_number().over(_by_window())).where("kind = 0 OR rank > 1")
    runs = later.groupBy("doc", th.alias("th")).agg(F.collect_list(F.shiftleft(F.shiftright("pos", _BITS + _REACH), 32).bitwiseOR(F.when(F.col("kind") == 0, F.col("c")).otherwise(1))).alias(name))
    runs = runs.select(F.col("doc").alias(d), F.col("th").alias(t), name)
    return keyed.join(runs, [d, t], "left").drop(d, t), name


def _by_window():
    from pyspark.sql import Window

    # Equal windows are one row a batch at most; settled rows have a key of their own each.
    return Window.partitionBy("kind", "a", "c").orderBy("doc", "pos")


def _covered(words: C.Words, lo: int, runs: pa.ListArray, n: int) -> np.ndarray:
    """Flags of the slice's words that the runs of its documents (from row lo) cover."""
    part = runs.slice(lo, len(words.offsets) - 1)
    of = np.repeat(np.arange(len(part)), part.value_lengths().fill_null(0).to_numpy())
    flat = part.flatten().to_numpy()
    start, size = flat >> 32, flat & 0xFFFFFFFF
    of, start, end = C.pad_spans(of, start, start + size + n - 1)
    step = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(step, words.first[of] + start, 1)
    np.add.at(step, words.first[of] + end, -1)
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 20) -> DataFrame:
    """docs whose texts lose each repeated run from its first word to the next kept word; others stay unchanged."""
    found, name = repeats(docs, id_col, text_col, n)

    at, of = found.columns.index(text_col), found.columns.index(name)

    def parts(batch: pa.RecordBatch):
        texts = batch.column(at)
        for lo, hi, data, offs in C.slices(texts):
            w, body, out = C.Words(data, offs), data.tobytes(), texts.slice(lo, hi - lo).to_pylist()
            gone = _covered(w, lo, batch.column(of), n)
            for r in range(hi - lo):
                a, b = w.first[r], w.first[r + 1]
                keep = ~gone[a:b]
                if not keep.all():
                    after = np.append(w.start[a:b], offs[r + 1])[1:]  # a word goes with the blanks after it
                    out[r] = (body[offs[r] : w.start[a]] + b"".join(body[s:e] for s, e in zip(w.start[a:b][keep], after[keep], strict=True))).decode()
            yield lo, hi, pa.array(out, pa.string())

    return C.widened(found, {text_col: "string"}, parts).select(*docs.columns)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside 20-word windows that start earlier too are removed."""
    found, name = repeats(C.documents(spark, sf_dir).select("doc_id", "text"), n=20)

    def each(b: pa.RecordBatch) -> list[pa.Array]:
        total, gone, kept = [], [], []
        for lo, _, data, offs in C.slices(b.column(1)):
            w = C.Words(data, offs)
            flags = _covered(w, lo, b.column(2), 20)
            total.append(w.counts)
            gone.append(C.by_document(flags, w.doc, len(offs) - 1))
            body = data.tobytes()
            for r in range(len(offs) - 1):
                words = body[offs[r] : offs[r + 1]].split()
                if gone[-1][r]:
                    words = [x for x, g in zip(words, flags[w.first[r] : w.first[r + 1]], strict=True) if not g]
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return [b.column(0), pa.array(np.concatenate(total)), pa.array(np.concatenate(gone)), pa.array(kept)]

    return C.arrow_map(found, ["doc_id", "text", name], "doc_id long, n_words long, n_removed long, kept_sha256 string", lambda: each)


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(a[i : i + 19], ' ')) AS h FROM (SELECT doc_id, a, unnest(range(1, len(a) - 18)) AS i FROM w WHERE len(a) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM g) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
x AS (SELECT doc_id, unnest(a) AS word, unnest(range(1, len(a) + 1)) AS p FROM w)
SELECT w.doc_id, CAST(len(a) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT x.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE gone.p IS NULL) AS kept
  FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p GROUP BY x.doc_id) k ON k.doc_id = w.doc_id
"""

