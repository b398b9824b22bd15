"""Language identification by rank-order profiles of character n-grams.

A text's profile is its ``PROFILE`` most frequent n-grams (1 to 3 characters of lower-cased words
between blanks), ranked by count and then by code. A language's profile is that of its training texts
together. The out-of-place distance of a text to a language sums, over the text's n-grams, how far
the two ranks are apart, and the most if the language lacks the n-gram; the least distance wins.
The score is 1 - least distance / second least (1 if only one language was learned).

Profiles are fitted on at most ``per_language`` texts of each language, those of least hash of the
text, so the fit costs the same at every size; the limit is a parameter and concerns the fit alone.
All texts are scored whole. The profiles are languages x PROFILE rows.

Defined results: a text without a letter (null and empty ones too) is ``und`` with score 0; so is
all if nothing could be learned; ties go to the language first in order; equal rows get equal
results; an empty table gives an empty table. Letters are those of str.isalpha.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common as C

PROFILE = 400
SIZES = (1, 2, 3)
_BITS = 21  # of a code point


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point (its first character), and whether it is a letter; for the basic plane."""
    low = np.arange(0x10000, dtype=np.uint32)
    alpha = np.zeros(0x10000, bool)
    for i in range(0x10000):
        if not 0xD800 <= i < 0xE000:
            c = chr(i)
            low[i] = ord(c.lower()[0])
            alpha[i] = unicodedata.category(c)[0] == "L"
    return low, alpha


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, code, count) of all n-grams of a slice, sorted by document; documents' first rows; whether each has a letter."""
    low, alpha = _tables()
    n = len(offs) - 1
    text = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=at[1:])
    edge = at[offs]  # documents' borders in characters
    small = np.minimum(text, 0xFFFF)
    letter = alpha[small] & (text < 0x10000)
    # The higher planes: rare enough to look at one by one.
    for i in np.flatnonzero(text >= 0x10000):
        letter[i] = chr(text[i]).isalpha()
    chars = np.where(letter, np.where(text < 0x10000, low[small], text), 0x20).astype(np.uint64)
    # A blank between documents; all that isn't a letter is a blank, and n-grams hold one only at their ends.
    padded = np.full(len(chars) + n + 1, 0x20, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(edge))
    place = np.arange(len(chars)) + doc + 1
    padded[place] = chars
    owner = np.zeros(len(padded), np.int64)
    owner[place] = doc
    has = np.zeros(n, bool)
    has[doc[letter]] = True
    blank = padded == 0x20
    found = []
    for size in SIZES:
        m = len(padded) - size + 1
        code = np.zeros(m, np.uint64)
        ok = np.ones(m, bool)
        for j in range(size):
            code = code << np.uint64(_BITS) | padded[j : j + m]
            if size == 1 or 0 < j < size - 1:
                ok &= ~blank[j : j + m]
        if size == 2:
            ok &= ~(blank[:m] & blank[1:])
        own = np.where(blank[:m], owner[1 : m + 1] if size > 1 else 0, owner[:m])
        found.append((own[ok], code[ok]))
    own, code = (np.concatenate(x) for x in zip(*found, strict=True))
    # One sort of 64-bit keys: a rank of the code within the slice, and the document above it.
    codes, rank = _dense(code)
    key, count = np.unique(own.astype(np.int64) << 32 | rank, return_counts=True)
    own, code = key >> 32, codes[key & 0xFFFFFFFF]
    return own, code, count, np.searchsorted(own, np.arange(n + 1)), has


def _dense(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.unique(code)
    return codes, np.searchsorted(codes, code)


def _top(own: np.ndarray, code: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, code, rank) of each document's most frequent n-grams."""
    order = np.lexsort((code, -count, own))
    rank = np.arange(len(own)) - first[own]
    keep = rank < PROFILE
    return own[keep], code[order][keep], rank[keep]


def profiles(docs: DataFrame, text_col: str, lang_col: str, per_language: int) -> dict[str, list[int]]:
    """Language to its n-grams, most frequent first."""
    some = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    some = _least(some, per_language)
    one = C.arrow_map(some, ["lang", "text"], "lang string, code long, n long", lambda: _by_language)
    total = one.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    out: dict[str, list[int]] = {}
    for lang, code in total.withColumn("rank", rank).where(F.col("rank") <= PROFILE).orderBy("lang", "rank").select("lang", "code").collect():
        out.setdefault(lang, []).append(code)
    return out


def _least(some: DataFrame, per_language: int) -> DataFrame:
    """At most so many different texts of each language, by least hash; only hashes are sorted, each shard's least ones first."""
    hashed = some.withColumn("h", F.xxhash64("text"))
    local = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h")
    ranked = hashed.groupBy("lang", "h").agg(F.lit(1).alias("one")).withColumn("r", F.row_number().over(local)).where(F.col("r") <= per_language)
    chosen = ranked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_language)
    most = chosen.groupBy("lang").agg(F.max("h").alias("most"))  # a row a language
    return hashed.join(F.broadcast(most), "lang").where("h <= most").groupBy("lang", "h").agg(F.first("text").alias("text")).drop("h")


def _by_language(batch: pa.RecordBatch) -> list[pa.Array]:
    langs = np.array(batch.column(0).to_pylist(), object)
    names, of = np.unique(langs.astype(str), return_inverse=True)
    out = []
    for lo, hi, data, offs in C.slices(batch.column(1)):
        own, code, count, *_ = grams(data, offs)
        out.append((of[lo:hi][own], code.astype(np.int64), count))
    of, code, count = (np.concatenate(x) for x in zip(*out, strict=True))
    pair, which = np.unique(np.stack([of, code]), axis=1, return_inverse=True)
    return [pa.array(names[pair[0]], pa.string()), pa.array(pair[1]), pa.array(np.bincount(which.ravel(), weights=count).astype(np.int64))]


def _classifier(table: dict[str, list[int]]):
    """Scores batches: a matrix of the languages' ranks by known n-gram, PROFILE where missing."""
    langs = sorted(table)
    known = np.unique(np.array([c for v in table.values() for c in v], np.uint64))
    ranks = np.full((len(langs), len(known) + 1), -1, np.int64)
    for i, lang in enumerate(langs):
        ranks[i, np.searchsorted(known, np.array(table[lang], np.uint64))] = np.arange(len(table[lang]))
    names = np.array([*langs, "und"], object)

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        pred, score = [], []
        for _, _, data, offs in C.slices(batch.column(1)):
            n = len(offs) - 1
            *counted, has = grams(data, offs)
            own, code, rank = _top(*counted)
            if not langs:
                has[:] = False
            else:
                i = np.searchsorted(known, code)
                i = np.where(known[np.minimum(i, len(known) - 1)] == code, i, len(known))
                far = np.empty((len(langs), n))
                for k in range(len(langs)):
                    there = ranks[k, i]
                    far[k] = np.bincount(own, weights=np.where(there < 0, PROFILE, np.abs(there - rank)), minlength=n)
                best = far.argmin(0)
                two = np.partition(far, 1, axis=0)[:2] if len(langs) > 1 else np.stack([far[0] * 0, far[0] * 0 + 1])
                s = 1 - two[0] / np.maximum(two[1], 1)
            pred.append(np.where(has, best, len(langs)) if langs else np.zeros(n, np.int64))
            score.append(np.where(has, s, 0.0) if langs else np.zeros(n))
        return [batch.column(0), pa.array(names[np.concatenate(pred)], pa.string()), pa.array(np.concatenate(score))]

    return lambda: each


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 3000) -> DataFrame:
    """(id, lang_pred, score) of every row of docs, learned from train."""
    table = profiles(train, text_col, lang_col, per_language)
    kind, text = docs.schema[id_col].dataType.simpleString(), C.free_name(docs, "_text")
    return C.arrow_map(docs.select(F.col(id_col), F.col(text_col).alias(text)), [id_col, text], f"`{id_col}` {kind}, lang_pred string, score double", _classifier(table))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; held_out ones taught nothing."""
    docs = C.documents(spark, sf_dir)
    held = C.crc_mod("doc_id", 4) == 2
    found = identify(docs, docs.where(~F.coalesce(held, F.lit(False))))
    return found.select("doc_id", F.coalesce(C.crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
