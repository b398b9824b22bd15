"""Folding by the whole Unicode table, splits, approximate matches, bags, sources: against plain versions."""

import difflib
import random
import unicodedata

import pandas as pd
import pytest
from larder.functions import text as X
from larder.operators import analysis as A
from larder.operators import bayes as B
from larder.operators import metrics as M
from larder.operators import rules as R
from larder.plans import knowledge as K
from larder.sources import products as P
from pyspark.sql import functions as F


def apply(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_fold_table(spark):
    """Accents, full width, ligatures and letters of any script of the basic plane, but for symbols without a letter or digit."""
    chars = [chr(i) for i in [*range(0x21, 0x3000), *range(0xF900, 0xFFFE)] if unicodedata.category(chr(i))[0] in "LNS"]
    plain = lambda c: " ".join("".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x)).split())
    want = [plain(c) for c in chars]
    got = apply(spark, X.fold, chars)
    ascii_only = [(c, g, w) for c, g, w in zip(chars, got, want, strict=True) if any(x.isascii() and x.isalnum() for x in w)]
    assert len(ascii_only) > 900 and not [x for x in ascii_only if x[1] != x[2]]
    assert apply(spark, X.fold, ["ﬁbra Ｅ１ ½ Ŀ œ"]) == ["fibra e1 1⁄2 l· œ"]


def test_compose(spark):
    texts = ["Composição: sal", "áê ́x", "é", None, "ṩ ṩ"]
    want = [t if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert apply(spark, X.compose, texts) == want
    assert apply(spark, X.segments, ["Nota. COMPOSIÇÃO: sal, mel"]) == [["sal", "mel"]]


def test_tag_cells(spark):
    rows = spark.createDataFrame([(1, ","), (2, " , "), (3, ""), (4, None)], "i int, t string")
    got = dict(rows.select("i", R.tag_status(F.lit(None).cast("string"), F.col("t"), F.lit(None).cast("string"))).collect())
    assert got == {1: "sem", 2: "sem", 3: "desconhecido", 4: "desconhecido"}


def test_missed_cereals(spark):
    docs = spark.createDataFrame([(1, "orge, sal"), (2, "Seigle, sal, agua"), (3, "sal, lait")], "doc_id int, text string")
    got = {r.doc_id: (r.gluten_grade, r.allergen_status) for r in R.report(docs, K.phrases(K.lexicon(spark)), K.allergens(spark)).collect()}
    assert got[1][0] == got[2][0] == "Contem Gluten" and got[3][1] == "Possui alergenios"


def test_every_form_matches_its_concept(spark):
    phrases = K.phrases(K.lexicon(spark))
    found = A.match_texts(phrases.select(F.col("folded").alias("match")), phrases).select("match", F.col("rank").alias("got"), "method")
    both = phrases.join(found, phrases["folded"] == found["match"], "left").select("folded", "rank", "got", "method").collect()
    assert len(both) == 318 and all(r.got is not None for r in both)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_approximate_matches(spark):
    """Pieces lose no pair: against all pairs of runs and phrases of as many words."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcd", k=r.randrange(3, 12)))
    phrases = sorted({" ".join(word() for _ in range(r.randrange(1, 4))) for _ in range(50)})

    def spoiled(t):
        t = list(t)
        for _ in range(r.randrange(4)):
            at = r.randrange(len(t))
            t[at : at + r.randrange(2)] = r.choices("abcd", k=r.randrange(2))
        return " ".join("".join(t).split())

    texts = sorted({x for x in (spoiled(r.choice(phrases)) + r.choice(["", " ab", " abc abd"]) for _ in range(150)) if x})
    table = spark.createDataFrame([(i, p, len(p.split()), len(p)) for i, p in enumerate(phrases)], "rank int, folded string, words int, len int")
    got = {x.match: (x.rank, round(x.score, 9)) for x in A.match_texts(spark.createDataFrame([(t,) for t in texts], "match string"), table).collect()}
    want = {}
    for t in texts:
        w = t.split()
        runs = [(" ".join(w[i : i + n]), n) for n in {len(p.split()) for p in phrases} for i in range(len(w) - n + 1)]
        exact = [i for i, p in enumerate(phrases) if f" {p} " in f" {t} "]
        if exact:
            want[t] = (min(exact), 1.0)
            continue
        near = [(-(1 - edit(run, p) / max(len(run), len(p))), i) for run, n in runs for i, p in enumerate(phrases) if len(p.split()) == n and len(p) >= 5]
        near = [x for x in near if -x[0] >= 0.84]
        if near:
            want[t] = (min(near)[1], round(-min(near)[0], 9))
    assert got == want and any(s < 1 for _, s in want.values())


def test_split_places(spark):
    """Places within a label are those of one sort, though no task sorts a label; null labels are a label."""
    import hashlib

    rows = [(i, None if i % 7 == 0 else "ab"[i % 2]) for i in range(500)]
    got = {x.id: (x.is_test, x.fold) for x in B.stratified_folds(B.stratified_split(spark.createDataFrame(rows, "id long, label string"), "id", "label"), "id", "label").collect()}
    for label in (None, "a", "b"):
        own = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, x in rows if x == label)
        for nth, (_, i) in enumerate(own, 1):
            assert got[i] == (nth <= int(len(own) * 0.25 + 0.5), (nth - 1) % 5)


def test_predicates_and_bags(spark):
    rows = spark.createDataFrame([(1, "en:wheat,en:salt", "x", "en:gluten"), (2, None, "x", " "), (3, "en:salt", None, "en:milk"), (4, "", "y", None)], "id int, tags string, text string, allergens string")
    status = R.tag_status(F.col("allergens"), F.col("tags"), F.lit(None).cast("string"))
    docs, tags, vocabulary = B.labelled_bags(rows, "id", status, "tags", 2)
    assert {(r.id, r.label) for r in docs.collect()} == {(1, "contem"), (3, "sem")}
    assert {tuple(r) for r in vocabulary.collect()} == {("en:salt", 2)} and tags.count() == 3
    assert [r.id for r in rows.where(R.evaluable(F.col("text"), F.col("allergens"))).collect()] == [1]
    assert M.mean_confidence(spark.createDataFrame([(1.0,), (None,), (3.0,)], "c double"), "c").first() == (2, 2.0)


def test_lexicons_in_order(spark):
    kind = "entry int, term string, gluten string, allergen string, tag string, variants array<string>"
    one, two = spark.createDataFrame([(0, "sal", "safe", None, None, []), (1, "mel", "safe", None, None, [])], kind), spark.createDataFrame([(0, "sal", "gluten", None, None, ["sel"])], kind)
    got = {r.folded: (r.gluten, r.rank) for r in K.phrases(K.union(one, two)).collect()}
    assert got == {"sal": ("safe", 1), "mel": ("safe", 2), "sel": ("gluten", 3)}


def test_sources(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('code,n,x\n007,3,NA\n008,,1.5\n')
    got = P.read_typed(spark, str(path))
    assert dict(got.dtypes)["x"] == "double" and [r.n for r in got.collect()] == [3, None]
    (tmp_path / "d.tsv").write_text("code\tother\n1\t2\n")
    with pytest.warns(UserWarning, match="url"):
        assert P.read_dump(spark, str(tmp_path / "d.tsv"), ["code", "url"]).columns == ["code"]

    def fetch(code):
        if code == "b":
            raise OSError("no answer")
        return f"got {code}"

    codes = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "code string")
    assert {tuple(r) for r in P.lookup_products(codes, fetch).collect()} == {("a", "got a"), ("b", None)}


def test_report_from_words(spark):
    words = [("Ingredientes:", 50.0), ("farinha", 40.0), ("de", 45.0), ("trigo,", 55.0), ("sal", 30.0), ("", -1.0)]
    seen = spark.createDataFrame([("p", words)], "code string, words array<struct<text string, conf double>>")
    row = P.report_words(seen, K.phrases(K.lexicon(spark)), K.allergens(spark)).first()
    assert row.gluten_grade == "Contem Gluten" and any("Confianca de OCR baixa (44%)" in x for x in row.recommendations)


def test_forest(spark):
    r = random.Random(1)
    bags = [(i, ["x", "y"] if i % 2 else ["z"]) for i in range(200)]
    docs = spark.createDataFrame([(i, "odd" if i % 2 else "even") for i, _ in bags], "id long, label string")
    tags = spark.createDataFrame([(i, t) for i, b in bags for t in b + r.choices("uvw", k=1)], "id long, tag string")
    got = M.summary(B.holdout(docs, tags, "id", "label", B.document_frequency(tags, "id", "tag")), "label", "prediction").first()
    assert got.n == 50 and got.accuracy == 1.0


def test_cross_validation_lacks_no_class(spark):
    """A class of fewer rows than folds is unknown to some fold only."""
    docs = spark.createDataFrame([(i, "a" if i < 12 else "b") for i in range(13)], "id long, label string")
    tags = spark.createDataFrame([(i, "t") for i in range(13)], "id long, tag string")
    got = B.cross_validate(docs, tags, "id", "label", spark.createDataFrame([("t", 13)], "tag string, df long"), 5).toPandas()
    assert isinstance(got, pd.DataFrame) and got.n.sum() == 13 and difflib.SequenceMatcher(None, got.columns.tolist(), ["fold", "n", "accuracy"]).ratio() == 1
