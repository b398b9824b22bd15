"""Folding and composition against the Unicode tables, and patterns that take linear time, against the plain ones."""

import random
import re
import time
import unicodedata

import pytest
from larder.functions import text as X
from pyspark.sql import functions as F

# Letters of a later Unicode version than Python's may have a lower case that Python doesn't know.
POINTS = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]


def fold(text):
    kept = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return " ".join(kept.split())


def applied(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("o")).collect()
    return [o for _, o in sorted(rows)]


def mixed(seed, n):
    r = random.Random(seed)
    marks = [c for c in POINTS if unicodedata.combining(c)]
    letters = [*"aeoAEO sk", "é", "ﬁ", "½", "한", "ᄀ", "ᅡ", "ᆨ", "가", "Å", "ǖ", "क", "া", "ে", "𝐀", "㍿", "Σ", "İ"]
    return ["".join(r.choice(marks) if r.random() < 0.5 else r.choice(letters) for _ in range(r.randrange(1, 40))) for _ in range(n)]


def test_every_code_point(spark):
    texts = ["|".join(POINTS[i : i + 256]) for i in range(0, len(POINTS), 256)]
    assert [(ascii(x), ascii(y)) for a, b in zip(applied(spark, X.fold, texts), map(fold, texts), strict=True) if a != b for x, y in zip(a.split("|"), b.split("|"), strict=True) if x != y] == []
    composed = [unicodedata.normalize("NFC", t) for t in texts]
    assert [(ascii(x), ascii(y)) for a, b in zip(applied(spark, X.compose, texts), composed, strict=True) if a != b for x, y in zip(a.split("|"), b.split("|"), strict=True) if x != y] == []


def test_marks_in_any_order(spark):
    texts = [*mixed(1, 3000), "", "a" + "̣́" * 20_000, "é" * 20_000]
    assert applied(spark, X.fold, texts) == [fold(t) for t in texts]
    assert applied(spark, X.compose, texts) == [unicodedata.normalize("NFC", t) for t in texts]
    assert applied(spark, X.compose, [None, "abc"]) == [None, "abc"] and applied(spark, X.fold, [None]) == [None]


# The stated patterns, whose form in the library differs.
PERCENT = re.compile(r"\(?[ \t-\r]*[0-9]+[.,]?[0-9]*[ \t-\r]*%[ \t-\r]*\)?")
CUT = re.compile(r"[,;\n/]+|\.[ \t-\r]|\)[ \t-\r]*,?|[ \t-\r]+(?:e|y|and)[ \t-\r]+")


def junk(alphabet, seed, n=4000, longest=16):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(1, longest))) for _ in range(n)]


def test_percentages(spark):
    texts = junk(list("(() 12.,%%)\t\nx"), 2)
    assert applied(spark, lambda c: F.regexp_replace(c, F.lit(X.PERCENT), F.lit("_")), texts) == [PERCENT.sub("_", t) for t in texts]


def test_cuts(spark):
    texts = junk([" ", " ", "\t", "\n", ".", ",", "/", ")", "e", "y", "and", "x", "X"], 3, 8000) + ["a e e b", "a. and b", "a.  and b", "a\t\n and\tb", "a ) , and b", "\nand x", "and x"]
    want = [[y for y in (x.strip(X.EDGES) for x in CUT.split(t)) if y] for t in texts]
    cut = lambda c: F.filter(F.transform(F.split(X._re(c, X.JOINED, "$1$2,"), X.SEPARATORS), lambda x: F.btrim(x, F.lit(X.EDGES))), lambda x: x != "")
    assert [(t, a, b) for t, a, b in zip(texts, applied(spark, cut, texts), want, strict=True) if a != b] == []


def test_blanks_trimmed_and_before_punctuation(spark):
    texts = junk(list("  \t\n  .,;:!?ab"), 4)

    def plain(t):
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t))
        return re.sub(r"([,.;:])(?=\S)", r"\1 ", re.sub(r"\s+([,.;:!?])", r"\1", t)).strip()

    assert applied(spark, X.normalize_blanks, texts) == [plain(t) for t in texts]


@pytest.mark.parametrize("junk", ["7" * 100_000, " " * 100_000, "\t \n" * 33_000, "(" * 50_000 + " " * 50_000, "1 " * 50_000, "x " * 50_000 + "e" * 50_000, "\n " * 50_000 + "and", ". " * 50_000])
def test_linear_time(spark, junk):
    rows = spark.createDataFrame([(junk,)], "t string")
    for f in (X.segments, X.match_string, X.clean_ocr_text, X.ingredients_section, X.tag_list):
        f_of = lambda df: df.select(f(F.col("t")).alias("o")).collect()  # noqa: B023,E731
        f_of(spark.createDataFrame([("x",)], "t string"))
        began = time.time()
        f_of(rows)
        taken = time.time() - began
        began = time.time()
        f_of(spark.createDataFrame([("x",)], "t string"))
        assert taken - (time.time() - began) < 1, f.__name__
