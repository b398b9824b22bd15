"""Fill-in-the-middle: texts cut in prefix, middle and suffix, and put together in another order.

A text is decoded to an array of UTF-32 code points. Each code point has a class; where neighbours'
classes differ (``flatnonzero``) a unit ends, so a text of u units has u + 1 boundaries. Two ranks
drawn from the row's id choose boundaries, the array is sliced there and its pieces are encoded
again. Units are code points (every neighbour differs), words (runs of blanks, of letters and digits,
single others) or lines.

Form: ``plain`` (the text as it is) if the text is empty or holds a sentinel, or by chance; else
``spm`` by chance; else ``psm``. The draw is the hex sha256 of seed, a colon and the decimal id (an
empty string for a null id), so equal ids are cut alike on every run and retry.

Defined results: a null text counts as empty and is ``plain`` with an empty output; equal rows get
equal results; columns of any name pass through, save those named as outputs, which are replaced; an
empty table gives an empty table. Memory: one Arrow batch, a slice of it and one text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many are transformed, and of these so many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20

# Classes of code points by unit.
_LINE, _BLANKS = 0x0A, np.array([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0], np.uint32)


def _word_classes(points: np.ndarray) -> np.ndarray:
    """Blank 0, letter, digit or anything past ASCII 1, other characters a class each by place, so that each stands alone."""
    other = np.arange(len(points)) + 2
    ascii_ = points < 0x80
    alnum = ~ascii_ | (points - 0x30 < 10) | ((points | 0x20) - 0x61 < 26) | (points == 0x5F)
    return np.where(np.isin(points, _BLANKS), 0, np.where(alnum, 1, other))


def _line_classes(points: np.ndarray) -> np.ndarray:
    """The number of line feeds before each code point: a line feed ends its line."""
    feeds = points == _LINE
    return np.cumsum(feeds) - feeds


UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"chars": lambda p: np.arange(len(p)) & 1, "words": _word_classes, "lines": _line_classes}


def boundaries(points: np.ndarray, unit: str = "chars") -> np.ndarray:
    """Places where units begin, and the end: u + 1 of them for u units (0 alone if there are none)."""
    classes = UNITS[unit](points)
    inner = np.flatnonzero(classes[1:] != classes[:-1]) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def draw(seed: int, key: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(np.frombuffer(digest[:16], ">u4").tolist())


def transform(text: str, key: str, seed: int = 1, unit: str = "chars", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = SENTINELS) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle or None, output) of one text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    edges = boundaries(points, unit)
    n = len(edges) - 1
    one, two, plain, order = draw(seed, key)
    if not n or plain % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    a, b = (int(edges[r]) for r in sorted((one % (n + 1), two % (n + 1))))
    p, m, s = (x.tobytes().decode("utf-32-le") for x in (points[:a], points[a:b], points[b:]))
    if order % 100 < suffix_first:
        return n, "spm", a, b - a, marks[1] + s + marks[0] + p + marks[2] + m
    return n, "psm", a, b - a, marks[0] + p + marks[1] + s + marks[2] + m


def restore(output: str, form: str, marks: tuple[str, str, str] = SENTINELS) -> str:
    """The text that an output of this form came from. The text holds no sentinel and sentinels can't overlap, so the first of each is the one put in."""
    if form == "plain":
        return output
    first, second = (marks[0], marks[1]) if form == "psm" else (marks[1], marks[0])
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(marks[2])
    return one + middle + two if form == "psm" else two + middle + one


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels must not be empty nor overlap one another, else outputs couldn't be taken apart."""
    for x in marks:
        for y in marks:
            if not x or any(x.endswith(y[:i]) for i in range(1, min(len(x), len(y)) + (x != y))) or (x != y and x in y) or len(set(marks)) < 3:
                raise ValueError(f"sentinels {x!r} and {y!r} overlap or are equal or empty")
    return tuple(marks)


_OUT = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long"}


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "output", seed: int = 1, unit: str = "chars", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars (null if plain) and the output."""
    marks, unit_ok = _checked(marks), UNITS[unit]
    assert unit_ok
    key, own = C.free_name(docs, "_key"), [c for c in docs.columns if c.lower() not in {*_OUT, out_col.lower()} or c in (id_col, text_col)]
    keyed = docs.select(*own, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(key))
    text_at, key_at = keyed.columns.index(text_col), keyed.columns.index(key)

    def parts(batch: pa.RecordBatch):
        keys = batch.column(key_at)
        for lo, hi, data, offs in C.slices(batch.column(text_at)):
            body, edge = data.tobytes(), offs.tolist()
            rows = [transform(body[a:b].decode(), k, seed, unit, rate, suffix_first, marks) for a, b, k in zip(edge, edge[1:], keys.slice(lo, hi - lo).to_pylist(), strict=False)]
            yield lo, hi, *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))

    return C.widened(keyed, _OUT | {out_col: "string"}, parts).drop(key)


def restored(rows: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "restored", marks: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """rows with the texts that outputs came from; a null output gives an empty text."""
    marks = _checked(marks)
    out_at, form_at = rows.columns.index(output_col), rows.columns.index(form_col)

    def parts(batch: pa.RecordBatch):
        for lo, hi, data, offs in C.slices(batch.column(out_at)):
            body, edge = data.tobytes(), offs.tolist()
            yield lo, hi, pa.array([restore(body[a:b].decode(), f, marks) for a, b, f in zip(edge, edge[1:], batch.column(form_at).slice(lo, hi - lo).to_pylist(), strict=False)], pa.string())

    return C.widened(rows, {text_col: "string"}, parts)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by code points; digests of outputs and of what they are restored to."""
    cut = restored(fill_in_middle(C.documents(spark, sf_dir).select("doc_id", "text")))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
x AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
      CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
y AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM y
"""
