"""Matching texts against a lexicon that fits in memory: automata, built once a task, that each text walks once.

Whole phrases are found by one automaton over the words. Approximate matches need no window over all
runs either: a phrase that bears d edits is cut into d + 1 pieces, of which a run within d edits holds
one unchanged, at most d places off; a second automaton finds the pieces, and only the runs around a
found piece are measured. The lexicon is sent to the workers behind a check of its rows and bytes;
beyond it ``analysis`` joins instead.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

# Acceptance of approximate matches, their shortest phrase.
FUZZY = 0.84
FUZZY_LEAST = 5
#: Most phrases, and bytes of phrases, that are sent to every worker.
MOST_PHRASES, MOST_BYTES = 200_000, 32_000_000
#: Remembered texts of a task, and their longest.
REMEMBERED, REMEMBERED_CHARS = 50_000, 100
#: Bytes of text that are worked on at once.
SLICE = 1 << 21

_WIDE, _OTHER = re.compile(r"[^\x00-\x7f]+"), re.compile("[^a-z]+")
_BLANKED = {i: " " for i in range(128) if not 97 <= i < 123}
_CLAIM = re.compile(X.CLAIM, re.ASCII)


@functools.lru_cache(1 << 14)
def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def _lowered(text: str) -> str:
    text = text.lower()
    return text if text.isascii() else _WIDE.sub(lambda m: "".join(map(_bare, m[0])), text)


def fold(text: str) -> str:
    """X.fold of one text: lower case without accents and compatibility forms, blanks collapsed."""
    return " ".join(_lowered(text).split())


def match_words(folded: str) -> str:
    """X.match_words of one text."""
    return " ".join((folded.translate(_BLANKED) if folded.isascii() else _OTHER.sub(" ", folded)).split())


def claims(folded: str) -> bool:
    return "gluten" in folded and _CLAIM.search(folded) is not None


def text_claims(text: str) -> bool:
    """claims() of a whole text, whose blanks matter only if it names gluten."""
    lowered = _lowered(text)
    return "gluten" in lowered and claims(" ".join(lowered.split()))


def enough_letters(text: str, least: int) -> bool:
    return len(text) >= least and sum(map(str.isalpha, text)) >= least


def allowed_edits(length: int, least: float) -> int:
    """Edits that a phrase of so many characters bears; a run's length is length / least at most."""
    return int((1 - least) * length / least + 1e-9)


def edits_within(a: str, b: str, most: int) -> int | None:
    """Levenshtein distance if it is at most so many, by the cells near the diagonal."""
    if abs(len(a) - len(b)) > most:
        return None
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        row = [most + 1] * (len(b) + 1)
        row[0] = i
        for j in range(lo, hi + 1):
            row[j] = min(before[j - 1] + (x != b[j - 1]), before[j] + 1, row[j - 1] + 1)
        if min(row[lo - 1 : hi + 1]) > most:
            return None
        before = row
    return before[-1] if before[-1] <= most else None


class Matcher:
    """Of a list of phrases, the most specific first; phrases are words with single spaces."""

    def __init__(self, phrases: list[str], fuzzy: float = FUZZY):
        self.phrases, self.fuzzy = phrases, fuzzy
        self.words = [p.count(" ") + 1 for p in phrases]
        self.whole, self.pieces = ahocorasick.Automaton(), ahocorasick.Automaton()
        cut: dict[str, list[tuple[int, int, int]]] = {}
        for i, p in enumerate(phrases):
            self.whole.add_word(f" {p} ", min(i, self.whole.get(f" {p} ", i)))
            if fuzzy <= 1 and len(p) >= FUZZY_LEAST:
                d = allowed_edits(len(p), fuzzy)
                for n in range(d + 1):
                    a, b = n * len(p) // (d + 1), (n + 1) * len(p) // (d + 1)
                    cut.setdefault(p[a:b], []).append((i, a, d))
        for piece, of in cut.items():
            self.pieces.add_word(piece, (len(piece), of))
        self.whole.make_automaton()
        self.pieces.make_automaton()
        self.known: dict[str, tuple[int, float] | None] = {}

    def ratio(self, run: str, phrase: str) -> float | None:
        """1 - distance / longer length, if accepted."""
        longer = max(len(run), len(phrase))
        d = edits_within(run, phrase, int((1 - self.fuzzy) * longer + 1e-9))
        return None if d is None or 1 - d / longer < self.fuzzy else 1 - d / longer

    def near(self, text: str) -> tuple[int, float] | None:
        """The phrase of the highest ratio to a run of as many words, ties to the more specific."""
        if not len(self.pieces):
            return None
        pieces = list(self.pieces.iter(text))
        if not pieces:
            return None
        starts = [0, *(i + 1 for i, c in enumerate(text) if c == " ")]
        best, tried = None, set()
        for end, (size, of) in pieces:
            at = end - size + 1
            for i, place, d in of:
                for w in range(bisect_left(starts, at - place - d), bisect_right(starts, min(at, at - place + d))):
                    if w + self.words[i] > len(starts) or (i, w) in tried:
                        continue
                    tried.add((i, w))
                    stop = starts[w + self.words[i]] - 1 if w + self.words[i] < len(starts) else len(text)
                    score = self.ratio(text[starts[w] : stop], self.phrases[i]) if stop > end else None
                    if score is not None and (best is None or (-score, i) < (-best[1], best[0])):
                        best = i, score
        return best

    def find(self, text: str | None) -> tuple[int, float] | None:
        """(number of the phrase, score) of a text's match, whole ones (score 1) first."""
        if not text:
            return None
        if text in self.known:
            return self.known[text]
        whole = min((i for _, i in self.whole.iter(f" {text} ")), default=None) if len(self.whole) else None
        found = (whole, 1.0) if whole is not None else self.near(text)
        if len(text) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = found
        return found


class Lexicon:
    """Phrases (rank, folded and what else they bear) on the driver and, once asked for, on every worker."""

    def __init__(self, rows: pa.Table, schema: T.StructType, spark):
        """rows: in order of rank."""
        self.rows, self.schema, self.spark = rows, schema, spark

    @classmethod
    def of(cls, phrases: DataFrame, *columns: str) -> Lexicon | None:
        """None if the phrases are too many or too long to be sent to every worker. An eager job, so a lexicon of many uses is best made once."""
        table = phrases.select("rank", "folded", *columns)
        some = table.limit(MOST_PHRASES + 1)
        n, size = some.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("folded")), F.lit(0))).first()
        if n > MOST_PHRASES or size > MOST_BYTES:
            return None
        return cls(table.toArrow().sort_by("rank"), table.schema, phrases.sparkSession)

    def _over(self, df: DataFrame, schema: T.StructType, fuzzy: float, each: Callable[[Matcher, pa.Table, pa.RecordBatch], list[pa.Array]], sized: str) -> DataFrame:
        """df's batches, in parts of some bytes of the sized column, through a function that is given the automata, made once a task."""
        sent = self.spark.sparkContext.broadcast((self.rows.combine_chunks(), fuzzy))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, least = sent.value
            found = Matcher(table["folded"].to_pylist(), least)
            for batch in batches:
                for part in _parts(batch, sized):
                    yield pa.RecordBatch.from_arrays(each(found, table, part), names=schema.names)

        return df.mapInArrow(run, schema)

    def _fields(self, but: tuple[str, ...] = ("folded",)) -> list[T.StructField]:
        return [T.StructField(f.name, f.dataType) for f in self.schema if f.name not in but]

    def analyze(self, rows: DataFrame, fuzzy: float = FUZZY, letters: int = 4) -> DataFrame:
        """rows: an id, text and its segments; gives (id, gluten_free_label, matches, unknown): what matched, each term once in a declaration, and
        the segments that didn't but have so many letters. Segments that claim are left out. Once traces are announced all later segments are
        traces, else after 'contains' they are contained."""
        id_col = rows.columns[0]
        kinds = [T.StructField("pos", T.IntegerType()), T.StructField("raw", T.StringType()), *self._fields(("folded", "rank")), T.StructField("score", T.DoubleType()), T.StructField("method", T.StringType()), T.StructField("declaration", T.StringType())]
        schema = T.StructType([rows.schema[id_col], T.StructField("gluten_free_label", T.BooleanType()), T.StructField("matches", T.ArrayType(T.StructType(kinds))), T.StructField("unknown", T.ArrayType(T.StringType()))])
        traces, contains = ((lambda folded, own=tuple(m): any(x in folded for x in own)) for m in (X.TRACE_MARKERS, X.CONTAINS_MARKERS))

        def each(found: Matcher, table: pa.Table, batch: pa.RecordBatch) -> list[pa.Array]:
            term = table["term"].to_pylist()
            pos, raw, said, hits, unknown, n_first, n_unknown = [], [], [], [], [], [], []
            for segments in batch.column(2).to_pylist():
                seen, before, state = set(), (len(hits), len(unknown)), "ingrediente"
                for i, segment in enumerate(segments):
                    folded = fold(segment)
                    if claims(folded):
                        continue
                    if state != "tracos":
                        state = "tracos" if traces(folded) else "contem" if state == "contem" or contains(folded) else state
                    hit = found.find(match_words(folded))
                    if hit is None:
                        if enough_letters(segment, letters):
                            unknown.append(segment)
                    elif (key := (term[hit[0]], state)) not in seen:
                        seen.add(key)
                        for column, value in zip((pos, raw, said, hits), (i, segment, state, hit), strict=True):
                            column.append(value)
                n_first.append(len(hits) - before[0])
                n_unknown.append(len(unknown) - before[1])
            of = _taken(table, hits) | {"pos": pa.array(pos, pa.int32()), "raw": pa.array(raw, pa.string()), "declaration": pa.array(said, pa.string())}
            structs = pa.StructArray.from_arrays([of[f.name] for f in kinds], names=[f.name for f in kinds])
            free = pa.array([text_claims(t) for t in batch.column(1).to_pylist()], pa.bool_())
            return [batch.column(0), free, _listed(structs, n_first), _listed(pa.array(unknown, pa.string()), n_unknown)]

        return self._over(rows, schema, fuzzy, each, "text")

    def match(self, texts: DataFrame, fuzzy: float = FUZZY) -> DataFrame:
        """(match, the phrases' columns but folded, score, method) of the texts (column match) that match."""
        kinds = [T.StructField("match", T.StringType()), *self._fields(), T.StructField("score", T.DoubleType()), T.StructField("method", T.StringType())]

        def each(found: Matcher, table: pa.Table, batch: pa.RecordBatch) -> list[pa.Array]:
            hits = [found.find(t) for t in batch.column(0).to_pylist()]
            some = [i for i, h in enumerate(hits) if h]
            of = _taken(table, [hits[i] for i in some])
            return [batch.column(0).take(pa.array(some, pa.int64())), *(of[f.name] for f in kinds[1:])]

        return self._over(texts.select("match"), T.StructType(kinds), fuzzy, each, "match")


def _parts(batch: pa.RecordBatch, sized: str) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of rows of about SLICE bytes, so what a worker holds doesn't follow the batch."""
    begin, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch[sized]), 0).to_pylist()):
        size += n
        if size >= SLICE:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _taken(table: pa.Table, hits: list[tuple[int, float]]) -> dict[str, pa.Array]:
    """The phrases' columns, score and method of each hit."""
    at = pa.array([i for i, _ in hits], pa.int64())
    own = {n: table[n].combine_chunks().take(at) for n in table.column_names} if table.num_rows else {n: pa.nulls(0, table.schema.field(n).type) for n in table.column_names}
    return own | {"score": pa.array([s for _, s in hits], pa.float64()), "method": pa.array(["exato" if s == 1.0 else "difuso" for _, s in hits], pa.string())}


def _listed(values: pa.Array, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), values)
