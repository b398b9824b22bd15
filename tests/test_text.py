"""Text functions against plain Python, stated examples and properties."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from larder.functions import distance as D
from larder.functions import text as X
from pyspark.sql import functions as F

FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXTS = st.lists(st.text(alphabet="aàÇçEe0158 tTrR%,.;:-\n|<>_é[](){}œß\t12", max_size=40), min_size=1, max_size=30)


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def fold(t):
    t = unicodedata.normalize("NFKD", t.lower())
    return " ".join("".join(c for c in t if not unicodedata.combining(c)).split())


def digits(t):
    def word(m):
        w = m.group(0)
        return "".join({"0": "o", "1": "l", "5": "s", "8": "b"}[c] if c in "0158" and 0 < i < len(w) - 1 and w[i - 1].isalpha() and w[i + 1].isalpha() else c for i, c in enumerate(w))

    return re.sub(r"\b[a-zA-Z0-9]{3,}\b", word, t)


def blanks(t):
    t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t))
    return re.sub(r"([,.;:])(?=\S)", r"\1 ", re.sub(r"\s+([,.;:!?])", r"\1", t)).strip()


def short(t):
    return "\n".join(x for x in t.splitlines() if sum(c.isalpha() for c in x) >= 3 or not x.strip())


def pieces(t):
    m = re.search(X.HEADER, t, re.I)
    t = re.sub(X.PERCENT, " ", t[m.end() :] if m else t)
    return [s for s in (x.strip(X.EDGES) for x in re.split(X.SEPARATORS, t)) if s]


@FEW
@given(TEXTS)
def test_against_python(spark, values):
    assert apply(spark, X.fold, values) == [fold(v) for v in values]
    assert apply(spark, X.digits_to_letters, values) == [digits(v) for v in values]
    assert apply(spark, X.normalize_blanks, values) == [blanks(v) for v in values]
    assert apply(spark, X.drop_short_lines, values) == [short(v) for v in values]
    assert apply(spark, X.segments, values) == [pieces("".join(c for c in v if c == "\n" or not unicodedata.category(c).startswith("C"))) for v in values]
    assert apply(spark, X.fold, apply(spark, X.fold, values)) == apply(spark, X.fold, values)


def test_examples(spark):
    assert apply(spark, X.fold, ["Farinha de Trigo", "Açúcar", None, ""]) == ["farinha de trigo", "acucar", None, ""]
    assert apply(spark, X.digits_to_letters, ["tr1g0", "70%", "éa1b"]) == ["trlg0", "70%", "éa1b"]
    assert apply(spark, X.normalize_blanks, ["1,5%"]) == ["1, 5%"]
    assert apply(spark, X.join_hyphens, ["trig-\n o"]) == ["trigo"]
    assert apply(spark, X.claims_gluten_free, ["10% gluten", "gluten-free", "SEM Glúten", None]) == [True, False, True, False]
    assert apply(spark, X.tag_list, [" A, b ,,", None]) == [["a", "b"], []]
    assert apply(spark, X.ingredients_section, ["x\nIngredientes: a, b\nLote 5", "none"]) == ["a, b", "none"]
    assert apply(spark, X.drop_header, ["O produto. Ingredientes: sal", "sal"]) == [" sal", "sal"]
    assert apply(spark, X.segments, ["estabilizador (E450, E451)"]) == [["estabilizador (E450", "E451"]]
    assert apply(spark, X.html_escape, ["<a href=\"x\">'&"]) == ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;"]
    assert apply(spark, X.full_size_url, ["http://i/p.400.jpg?v=1", "x.png"]) == ["http://i/p.full.jpg?v=1", "x.png"]
    assert apply(spark, lambda c: X.human_size(c.cast("double")), ["5", "2048", "1e13"]) == ["5.0 B", "2.0 KiB", "9.1 TiB"]


def test_distances(spark):
    two = spark.createDataFrame([("centeo", "centeio"), ("", ""), ("abc", "abd")], "a string, b string")
    got = [tuple(r) for r in two.select(F.levenshtein("a", "b"), F.round(D.levenshtein_ratio(F.col("a"), F.col("b")), 3)).collect()]
    assert got == [(1, 0.857), (0, 1.0), (1, 0.667)]
    sets = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [tuple(r) for r in sets.select(D.jaccard_index(F.col("a"), F.col("b")), D.overlap_coefficient(F.col("a"), F.col("b"))).collect()] == [(1.0, 0.0), (0.0, 0.0), (pytest.approx(1 / 3), 0.5)]
    assert apply(spark, D.char_ngrams, ["a b", "a", "", "abab"]) == [["ab"], ["a"], [], ["ab", "ba"]]
    assert [r[0] for r in spark.createDataFrame([("abc", "abd"), ("", "")], "a string, b string").select(D.hamming(F.col("a"), F.col("b"))).collect()] == [1, 0]
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([("a", "ab")], "a string, b string").select(D.hamming(F.col("a"), F.col("b"))).collect()


def test_chain_drops_short_lines(spark):
    """The chain's steps are given the text alone, so their own defaults hold."""
    assert apply(spark, X.clean_ocr_text, ["farinha\nGa.\n\nsal 0\n1 x 2", "Of.", None]) == ["farinha\n\nsal 0", "", None]
