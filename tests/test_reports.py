"""Reports within a row: no exchange, the same as by joins, the same as a plain search of all runs."""

import random

import pytest
from larder.operators import analysis as A
from larder.operators import lexicon as L
from larder.operators import rules as R
from larder.plans import catalog
from larder.plans import knowledge as K


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_match(phrases, text, least=L.FUZZY):
    """phrases: the most specific first."""
    for i, p in enumerate(phrases):
        if f" {p} " in f" {text} ":
            return i, 1.0
    words, best = text.split(), None
    for i, p in enumerate(phrases):
        n = p.count(" ") + 1
        for k in range(len(words) - n + 1) if len(p) >= L.FUZZY_LEAST else ():
            run = " ".join(words[k : k + n])
            ratio = 1 - distance(run, p) / max(len(run), len(p))
            if ratio >= least and (best is None or ratio > best[1]):
                best = i, ratio
    return best


def spoiled(r, text):
    out = list(text)
    for _ in range(r.randrange(4)):
        k = r.randrange(len(out) + 1)
        out[k : k + r.randrange(2)] = r.choice(["", "x", "e", " "])
    return " ".join("".join(out).split())


def test_automata_against_all_runs(spark):
    phrases = [r.folded for r in K.phrases(K.lexicon(spark)).orderBy("rank").collect()]
    r, found = random.Random(4), L.Matcher(phrases)
    texts = [spoiled(r, " ".join(r.choice(phrases + ["agua", "zzz"]) for _ in range(r.randrange(1, 4)))) for _ in range(250)] + phrases[:40]
    for t in texts:
        got, want = found.find(t), plain_match(phrases, t)
        assert got == want or (t == "" and got is None), (t, got, want)
    assert found.find(None) is None and L.Matcher([]).find("x") is None and L.Matcher(["a b"], 2.0).find("a b c") == (0, 1.0)


@pytest.mark.parametrize("most", range(4))
def test_banded_distance(most):
    r = random.Random(most)
    for _ in range(800):
        a, b = ("".join(r.choice("ab c") for _ in range(r.randrange(9))) for _ in range(2))
        d = distance(a, b)
        assert L.edits_within(a, b, most) == (d if d <= most else None)


TEXTS = [(g[0], g[1]) for g in catalog.GOLDEN] + [("x1", None), ("x2", ""), ("x3", "..., 12 % ; () -"), ("x4", "sal, sal, trigo. Contem leite, sal, leite. Pode conter soja, leite, sal"), ("x4", "Farlnha de trgo, sal"), (None, "trigo"), ("x5", "sal, " * 4000 + "trigo"), ("x6", "9" * 50_000)]


def report_rows(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id string, text string").repartition(3)
    phrases, allergens = K.phrases(K.lexicon(spark)), K.allergens(spark)
    out = R.report(docs, phrases, allergens)
    key = lambda r: (str(r.doc_id), r.gluten_free_label, [tuple(m) for m in r.matches], list(r.unknown), r.gluten_grade, r.allergen_status, list(r.reasons), list(r.recommendations))
    return out, sorted(map(key, out.collect()))


def test_same_by_joins_and_without_exchange(spark, monkeypatch):
    out, rows = report_rows(spark)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Join" not in plan  # the test's own repartition
    assert len(rows) == len(TEXTS)
    monkeypatch.setattr(L, "MOST_PHRASES", 0)
    assert report_rows(spark)[1] == rows


def test_lexicons_that_are_odd(spark):
    none = K.phrases(K.lexicon(spark)).limit(0)
    docs = spark.createDataFrame([(1, "trigo, sal")], "doc_id int, text string")
    got = A.analyze(docs, none, K.allergens(spark)).first()
    assert got.matches == [] and got.unknown == ["trigo"]
    assert A.match_texts(spark.createDataFrame([("trigo",), ("trigo",), ("",), (None,)], "match string"), none).count() == 0
    some = K.phrases(K.lexicon(spark))
    assert [r.match for r in A.match_texts(spark.createDataFrame([("trigo",), ("trigo",), ("",), (None,)], "match string"), some).collect()] == ["trigo"]


def test_folding_in_the_pass_is_that_of_columns(spark):
    import unicodedata

    from larder.functions import text as X
    from pyspark.sql import functions as F

    r, odd = random.Random(2), [chr(i) for i in range(0x80, 0x3000) if unicodedata.ucd_3_2_0.category(chr(i)) != "Cn"] + list(" \t\n\x1c12%(),.AZaz") * 40 + ["가", "ﬁ", "Ａ", "\U0001d400"]
    texts = ["".join(r.choices(odd, k=r.randrange(12))) for _ in range(3000)] + ["sem  glúten", "0 % GLUTEN", "isento de\ngluten", "glu ten", "(1,5 %) sal", "ab%cd 3%"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.fold(F.col("t")).alias("f"), X.match_string(F.col("t")).alias("m"), X.claims_gluten_free(F.col("t")).alias("c"), (X.letters(F.col("t")) >= 4).alias("l"))
    for x in df.collect():
        assert (x.f, x.m, x.c, x.l) == (L.fold(x.t), L.match_words(L.fold(x.t)), L.text_claims(x.t), L.enough_letters(x.t, 4)), x


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"i": list(range(9)), "text": ["x" * (L.SLICE // 2)] * 7 + [None, "x" * 3 * L.SLICE]})
    parts = list(L._parts(batch, "text"))
    assert [i for p in parts for i in p["i"].to_pylist()] == list(range(9)) and len(parts) == 4
    found = L.Matcher(["sal"])
    for i in range(200):
        found.find("x" * (L.REMEMBERED_CHARS + i))
    assert len(found.known) == 1
