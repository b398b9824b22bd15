"""Phrase collocations of a corpus, by count-min sketches and an exact second pass.

First pass: each task adds the hashes of its n-grams (by language) to a count-min sketch, whose cells stop
at the least count that matters. Sketches travel as compressed chunks of cells, are summed up chunk by
chunk, and leave one bit a cell: whether it reached that count. A sketch never underestimates, so an
n-gram with a cell unset is rare for certain. Words and pairs are sketched first, longer n-grams after
them: only those whose pairs all passed, as most rare n-grams would otherwise fill the cells.

Second pass: n-grams whose cells are all set (and whose shorter n-grams all passed) are counted
exactly, first within a slice of texts, then by Spark's partial and final sums. Nothing frequent is
lost, and what a full sketch lets pass in vain is dropped by its exact count. So the sketch bounds no
result, only the rows that are shuffled: with far more n-grams than cells it lets more and more pass,
up to a row for each different n-gram of a slice.

Then candidates are scored from the exact counts of their parts, those that mostly stand inside a
longer one are dropped, and each language's first ``top`` are ranked.

Defined results: null texts are empty; null languages are ``und``; repeated rows count again, as they
are documents of their own; other columns are not read; an empty table gives an empty table. Memory
of a task: a sketch (``SKETCHES`` x 2^``BITS`` cells of a byte, for large corpora up to 2^``MOST_BITS``) and
one slice of texts or a longer one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

LEAST, MAX_WORDS, TOP = 30, 4, 2000
#: Hash functions of the sketch, and bits of a cell's number in each.
SKETCHES, BITS = 2, 24
#: Bytes of text for each cell, until a sketch has its most bits.
CELL_BYTES, MOST_BITS = 32, 26
#: Words of the n-grams that are sketched first.
SHORT = 2
CHUNK = 1 << 18
SLICE = 1 << 22
#: In how many parts a language's candidates are ranked before the first of all parts are.
SALTS = 64

ENDS = np.zeros(256, bool)  # of a piece
ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
BREAKS = ENDS.copy()
BREAKS[list(b" \t")] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Grams:
    """The words of a slice, lower-cased, and hashes of their runs; run k at i is there if pieces[i] == pieces[i + k - 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, salts: np.ndarray):
        self.data = C.LOWER[data]
        self.words = w = C.Words(self.data, offsets, BREAKS)
        ends = np.cumsum(ENDS[self.data])
        new = np.ones(len(w.start), bool)
        if len(new):
            new[1:] = (ends[w.start[1:]] != ends[w.end[:-1] - 1]) | (w.doc[1:] != w.doc[:-1])
        self.piece = np.cumsum(new)
        self.salts = salts[w.doc]

    def __len__(self) -> int:
        return len(self.piece)

    def inside(self, at: np.ndarray, k: int) -> np.ndarray:
        """Those of the places where k words of one piece begin."""
        at = at[at <= len(self) - k]
        return at[self.piece[at] == self.piece[at + k - 1]]

    def first(self, lane: int) -> np.ndarray:
        return C.mix(self.words.lane(lane) + self.salts)

    def longer(self, shorter: np.ndarray, at: np.ndarray, k: int, lane: int) -> np.ndarray:
        """Hashes of runs of k words at the places, from those of k - 1 words at the same places."""
        return C.mix(shorter * _STEP + self.words.lane(lane)[at + k - 1])

    def texts(self, at: np.ndarray, k: int) -> pa.Array:
        """The runs of k words at the places, with single spaces."""
        w = self.words
        # One byte after each word is kept, as a space; a word that ends with its document has none, but no run goes on there.
        keep = ~BREAKS[self.data]
        after = w.end[w.end < len(keep)]
        gap = after[BREAKS[self.data[after]]]
        keep[gap] = True
        place = np.cumsum(keep) - 1
        body = self.data.copy()
        body[gap] = 0x20
        body = body[keep]
        start, size = place[w.start[at]], place[w.end[at + k - 1] - 1] + 1 - place[w.start[at]]
        offsets = np.zeros(len(at) + 1, np.int32)
        np.cumsum(size, out=offsets[1:])
        flat = body[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(flat))


def _grams(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Grams]]:
    """Of a batch of (lang, text), slice by slice: (first row, row after the last, n-grams)."""
    langs = batch.column(0)
    own = {x: xxhash.xxh3_64_intdigest(x) for x in set(langs.to_pylist())}
    salts = np.array([own[x] for x in langs.to_pylist()], np.uint64)
    for lo, hi, data, offs in C.slices(batch.column(1), SLICE):
        yield lo, hi, Grams(data, offs, salts[lo:hi])


def cells(h: np.ndarray, sketch: int, bits: int) -> np.ndarray:
    """The cell of each hash in one of the sketches."""
    return (C.mix(h + np.uint64(sketch) * _STEP) >> np.uint64(64 - bits)).astype(np.int64)


def add_to(sketch: np.ndarray, h: np.ndarray, bits: int, least: int) -> None:
    """Adds hashes, one for each occurrence; cells stop at the least count."""
    for i, row in enumerate(sketch):
        at, n = np.unique(cells(h, i, bits), return_counts=True)
        row[at] = np.minimum(row[at] + n, least)


def runs_of(grams: Grams, sizes: range, lanes: tuple[int, ...], passed) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(k, places, hashes in each lane) of the n-grams of each size up to the last whose shorter ones all passed; passed(k, hashes) gives flags, or None for all."""
    at, h = np.arange(len(grams)), [grams.first(i) for i in lanes]
    for k in range(1, sizes[-1] + 1):
        if k > 1:
            # Both shorter runs must have passed.
            some = grams.inside(at[:-1][at[1:] == at[:-1] + 1], k)
            before = np.searchsorted(at, some)
            at, h = some, [grams.longer(x[before], some, k, i) for x, i in zip(h, lanes, strict=True)]
        ok = passed(k, h[0])
        if ok is not None:
            at, h = at[ok], [x[ok] for x in h]
        if not len(at):
            return
        if k in sizes:
            yield k, at, h


def sized(packed: list[np.ndarray]):
    """Flags of n-grams of k words by the sketches so far, the first of which knows the short ones."""
    bits = [(len(p) * 8 // SKETCHES).bit_length() - 1 for p in packed]

    def passed(k: int, h: np.ndarray) -> np.ndarray | None:
        i = 0 if k <= SHORT else 1
        return passes(packed[i], h, bits[i]) if i < len(packed) else None

    return passed


def _sketched(sizes: range, bits: int, least: int, before):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = sized([np.frombuffer(b.value, np.uint8) for b in before])
        sketch = np.zeros((SKETCHES, 1 << bits), np.uint8 if least < 256 else np.int64)
        try:
            for batch in batches:
                for _, _, grams in _grams(batch):
                    found = [h[0] for _, _, h in runs_of(grams, sizes, (0,), passed)]
                    if found:
                        add_to(sketch, np.concatenate(found), bits, least)
            flat = sketch.reshape(-1)
            for i in range(0, len(flat), CHUNK):
                part = flat[i : i + CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["chunk", "cells"])
        finally:
            C.tidy()

    return run


def _summed(least: int):
    """Over rows sorted by chunk: the sum of each chunk's cells, as a bit a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["chunk", "bits"])

        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(packed.as_buffer()), np.uint8 if least < 256 else np.int64)
                if chunk != now:
                    if now is not None:
                        yield bits()
                    now, total = chunk, np.zeros(len(part), np.int64)
                total += part
        if now is not None:
            yield bits()
        C.tidy()

    return run


def merged_sketch(docs: DataFrame, sizes: range, least: int = LEAST, bits: int = BITS, before: tuple = ()) -> np.ndarray:
    """Packed bits of the cells of all sketches, row after row, that reached the least count: SKETCHES x 2^bits / 8 bytes, whatever the corpus.
    before: broadcast sketches of shorter n-grams."""
    # A task sends a whole sketch, so they are a few for each core at most.
    few = docs.coalesce(max(8, 4 * docs.sparkSession.sparkContext.defaultParallelism))
    rows = few.mapInArrow(_sketched(sizes, bits, least, before), "chunk int, cells binary")
    sums = rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_summed(least), "chunk int, bits binary")
    chunk = min(CHUNK, SKETCHES << bits) // 8
    out = np.zeros((SKETCHES << bits) // 8, np.uint8)
    for r in sums.toLocalIterator():  # bounded, see above
        out[r.chunk * chunk : (r.chunk + 1) * chunk] = np.frombuffer(r.bits, np.uint8)
    return out


def passes(packed: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Flags of the hashes all of whose cells are set."""
    ok = np.ones(len(h), bool)
    for i in range(SKETCHES):
        at = cells(h, i, bits) + (i << bits)
        ok &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def distinct(h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each, how many of it) of pairs of hashes."""
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(h, kind="stable")
    a, b = h[order], other[order]
    new = np.ones(len(h), bool)
    new[1:] = a[1:] != a[:-1]
    if (~new[1:] & (b[1:] != b[:-1])).any():  # equal in one half only
        order = np.lexsort((other, h))
        a, b = h[order], other[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.flatnonzero(new)
    return order[head], np.diff(np.append(head, len(h)))


_COUNTED = "lang string, k int, phrase string, n long"


def _survivors(packed: tuple, max_words: int):
    """Of each slice: a row for each different n-gram that passes, and for each language one of k 0 with the number of its words."""

    def make():
        passed = sized([np.frombuffer(p.value, np.uint8) for p in packed])

        def each(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
            langs = batch.column(0)
            for lo, hi, grams in _grams(batch):
                own = langs.slice(lo, hi - lo)
                coded = own.dictionary_encode()
                words = np.bincount(coded.indices.to_numpy(), weights=grams.words.counts, minlength=len(coded.dictionary)).astype(np.int64)
                yield [coded.dictionary, pa.array(np.zeros(len(words), np.int32)), pa.array([""] * len(words)), pa.array(words)]
                for k, at, (h, g) in runs_of(grams, range(1, max_words + 1), (0, 1), passed):
                    one, n = distinct(h, g)
                    yield [own.take(pa.array(grams.words.doc[at[one]])), pa.array(np.full(len(one), k, np.int32)), grams.texts(at[one], k), pa.array(n.astype(np.int64))]

        return each

    return make


def sketch_bits(rows: DataFrame) -> int:
    """Bits of a cell's number for texts of that many bytes."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return min(MOST_BITS, max(BITS, (size // CELL_BYTES).bit_length()))


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, bits: int | None = None) -> DataFrame:
    """(lang, k, phrase, n) of all phrases of k words that occur so often; and of k 0 the number of each language's words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits, sent = bits or sketch_bits(rows), ()
    for sizes in (range(1, min(SHORT, max_words) + 1), range(SHORT + 1, max_words + 1)):
        if sizes:
            sent += (docs.sparkSession.sparkContext.broadcast(merged_sketch(rows, sizes, least, bits, sent).tobytes()),)
    some = C.arrow_map(rows, ["lang", "text"], _COUNTED, _survivors(sent, max_words))
    return some.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("k") == 0))


def _part(phrase: Column, k: Column, begin: Column, end: Column) -> Column:
    """Words begin to end (from 0, end excluded) of a phrase of k words."""
    return F.call_function("substring_index", F.call_function("substring_index", phrase, F.lit(" "), end), F.lit(" "), begin - end)


def score(counts: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, k, a, cut, l, r, score) of the candidates: of the lowest-scoring cut, ties to the first. Whole-number arithmetic of 38 digits."""
    phrases = counts.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"))
    slots = F.flatten(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.array(F.struct((2 * c - 2).alias("slot"), _part(F.col("phrase"), F.col("k"), F.lit(0), c).alias("part")), F.struct((2 * c - 1).alias("slot"), _part(F.col("phrase"), F.col("k"), c, F.col("k")).alias("part")))))
    cut = phrases.select("lang", "phrase", "k", "a", F.explode(slots).alias("s")).select("lang", "phrase", "k", "a", "s.slot", "s.part")
    # A part that very many phrases share makes one large partition of the left side, which Spark splits as this is a plain join.
    known = counts.where(f"k BETWEEN 1 AND {max_words - 1}").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "n")
    met = cut.join(known, (F.col("lang") == F.col("_lang")) & (F.col("part") == F.col("_phrase")))
    wide = met.groupBy("lang", "phrase", "k", "a").agg(*(F.max(F.when(F.col("slot") == i, F.col("n"))).alias(f"_n{i}") for i in range(2 * max_words - 2)))

    def of(c: int) -> Column:
        left, right = F.col(f"_n{2 * c - 2}"), F.col(f"_n{2 * c - 1}")
        value = F.expr(f"cast(a as decimal(20,0)) * 2000000 div (cast(_n{2 * c - 2} as decimal(20,0)) + cast(_n{2 * c - 1} as decimal(20,0)))")
        return F.when(F.col("k") > c, F.struct(value.alias("score"), F.lit(c).alias("cut"), left.alias("l"), right.alias("r")))

    best = F.array_min(F.array_compact(F.array(*map(of, range(1, max_words)))))
    return wide.withColumn("_best", best).select("lang", "phrase", "k", "a", "_best.cut", "_best.l", "_best.r", "_best.score")


def subsumed(candidates: DataFrame, max_words: int = MAX_WORDS, percent: int = 80) -> DataFrame:
    """(lang, phrase) of the candidates inside a longer one that has at least so many percent of their count; candidates: (lang, phrase, k, a)."""
    k = F.col("k")
    longer = candidates.where("k >= 3")
    # Each contiguous part of two words or more.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), k - 1), lambda n: F.transform(F.sequence(F.lit(0), k - n), lambda b: _part(F.col("phrase"), k, b, b + n))))
    most = longer.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    both = candidates.select("lang", "phrase", "a").join(most, ["lang", "phrase"])
    return both.where(F.col("_most").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * percent).select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, percent: int = 80, top: int = TOP, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, count and name."""
    counts = C.checkpoint(frequent(docs, text_col, lang_col, max_words, least, bits))
    scored = C.checkpoint(score(counts, max_words))
    left = scored.join(subsumed(scored, max_words, percent), ["lang", "phrase"], "left_anti")
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    parts = left.withColumn("_salt", salt).withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_nth") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = counts.where("k = 0").select("lang", "n")
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of 2 to 4 words that occur 30 times or more in their language."""
    return collocations(C.documents(spark, sf_dir))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x for x in regexp_split_to_array(piece, '[\x20\x09]+') if x <> ''] AS a FROM p),
s AS (SELECT lang, sum(len(a))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest([array_to_string(a[i : i + k - 1], ' ') for i in range(1, len(a) - k + 2)]) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(a) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS t FROM f WHERE k >= 2),
o AS (SELECT lang, phrase, a, cut, array_to_string(t[1 : cut], ' ') AS first, array_to_string(t[cut + 1 : k], ' ') AS rest FROM c CROSS JOIN (SELECT unnest([1, 2, 3]) AS cut) u WHERE cut < k),
x AS (SELECT o.lang, o.phrase, o.a, cut, l.a AS l, r.a AS r, (2000000::HUGEINT * o.a // (l.a + r.a))::BIGINT AS score FROM o JOIN f l ON l.lang = o.lang AND l.phrase = first JOIN f r ON r.lang = o.lang AND r.phrase = rest),
b AS (SELECT lang, phrase, a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM x GROUP BY ALL),
q AS (SELECT lang, phrase, max(longer) AS longer FROM (SELECT lang, array_to_string(t[i : i + m - 1], ' ') AS phrase, a AS longer FROM c CROSS JOIN (SELECT unnest([2, 3]) AS m) v CROSS JOIN (SELECT unnest([1, 2, 3]) AS i) z WHERE m < k AND i + m - 1 <= k) GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN q USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d) JOIN s USING (lang) WHERE rank <= 2000
"""
