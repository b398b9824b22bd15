"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import corpus_pipeline
import pytest
from larder.llm import bloom_lm, decontaminate, language_id, line_dedup, near_dedup, quality_rules, sentencepiece_bpe, substring_dedup, token_count, toxicity
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(150_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc int, _TH string, kind int, id string, t int, label int, _spans string, _items int, _words int, _bitmap int, _repeats int, _score int, _text string, h1 int, n int"
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    (1, "a common line\nown line of the first\n" + PASSAGE), (2, "a common line\nown line of the second " + PASSAGE), (2, "a common line\nother text, same id"),
    (3, None), (4, ""), (5, " \n \t"), (None, "a text without id\na common line"), (None, None), (6, LONG), (7, LONG), (7, LONG), (8, "\n\n\n"), (9, "x"), (10, "é 😀 ▁ \x00 \r\n end"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "fr"][k % 3], None, None, k, "z", 3, "i", 5, 1, "s", 0, 0, 0, 0, 0, "own", 0, 0) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (None, "x"), (4, ""), (5, "...")], "item_id int, text string")


LABELS = [(1, 1), (2, 0), (3, 1), (None, 1), (4, None), (9, 0), (9, 1)]


def maps(spark, docs, bench):
    labels = spark.createDataFrame(LABELS, "doc_id long, toxic int")
    yes = F.col("doc_id") >= 0
    return {
        "drop_lines": (lambda d: line_dedup.drop_lines(d, min_docs=3), None),
        "remove_spans": (lambda d: decontaminate.remove_spans(d, bench), None),
        "remove_repeats": (lambda d: substring_dedup.remove_repeats(d), None),
        "near": (lambda d: near_dedup.near_classes(d), ["doc_id", "class_id", "class_size"]),
        "tokens": (lambda d: token_count.count_tokens(d), ["doc_id", "n_bytes", "n_tokens"]),
        "digests": (lambda d: sentencepiece_bpe.digests(d), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
        "encode": (lambda d: sentencepiece_bpe.decode(sentencepiece_bpe.encode(d, ids_col="ids_"), "ids_", text_col="back"), [*docs.columns, "ids_", "back"]),
        "judge": (lambda d: quality_rules.judge(d).select("doc_id", "kept"), ["doc_id", "kept"]),
        "lm": (lambda d: bloom_lm.score(d, F.col("doc_id") == 1), None),
        "toxic": (lambda d: toxicity.with_score(d, toxicity.train(d, labels, yes))[0].drop("_score_"), None),
        "language": (lambda d: language_id.identify(d, d), ["doc_id", "lang_pred", "score"]),
    }


NAMES = ["drop_lines", "remove_spans", "remove_repeats", "near", "tokens", "digests", "encode", "judge", "lm", "toxic", "language"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_and_columns(name, spark, docs, bench):
    run, columns = maps(spark, docs, bench)[name]
    out = run(docs)
    if columns is None and name != "lm":
        columns = docs.columns
    assert columns is None or out.columns == columns
    got = out.toPandas()
    assert len(got) == len(TEXTS)
    assert sorted(got.doc_id.fillna(-1)) == sorted(-1 if i is None else i for i, _ in TEXTS)
    none = run(docs.limit(0).cache())
    assert none.columns == out.columns and none.count() == 0


def texts(df):
    return sorted(((r.doc_id or -1, r.n or 0, r.text) for r in df.withColumn("n", F.col("_doc")).select("doc_id", "n", "text").collect()), key=lambda x: x[1])


def test_lines(docs):
    got = {n: t for _, n, t in texts(line_dedup.drop_lines(docs, min_docs=3))}
    assert got[0] == "own line of the first\n" + PASSAGE and got[2] == "other text, same id" and got[6] == "a text without id"
    assert got[3] is None and got[4] == "" and got[11] == "\n\n\n" and got[8] == got[9] == LONG


def test_spans(docs, bench):
    got = {n: t for _, n, t in texts(decontaminate.remove_spans(docs, bench))}
    assert got[0] == "a common line\nown line of the first\n" and got[12] == "" and got[3] is None and got[8] == LONG
    blocks, (spans, items, words) = decontaminate.find_spans(docs, bench, block_windows=1)
    one, _ = decontaminate.find_spans(docs, bench)
    key = lambda d: sorted((r._doc, tuple(r[spans]), tuple(sorted(set(r[items]))), r[words]) for r in d.collect())
    assert key(blocks) == key(one)


def test_repeats(docs):
    got = {n: t for _, n, t in texts(substring_dedup.remove_repeats(docs))}
    assert len(got[9]) < 200 < len(got[8]) and got[9] == got[10] and got[3] is None and got[5] == " \n \t"


def test_near(docs):
    got = near_dedup.near_classes(docs).toPandas()
    size = {i: set(g.class_size) for i, g in got[got.doc_id.notna()].groupby("doc_id")}
    assert size[6] == size[7] == {3} and size[3] == size[4] == {3} and size[5] == {1} and size[1] == {1}
    assert near_dedup.drop_near(docs).count() == len(TEXTS) - 4


def test_scores(spark, docs, bench):
    judged = {(r.doc_id, r.kept) for r in quality_rules.judge(docs).collect()}
    assert (3, False) in judged and (4, False) in judged
    lang = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, docs).collect()}
    assert lang[3] == lang[4] == lang[5] == ("und", 0.0) and lang[9][0] in ("en", "fr")
    assert {r.lang_pred for r in language_id.identify(docs, docs.limit(0)).collect()} == {"und"}
    lm = {r.doc_id: r for r in bloom_lm.score(docs, F.col("doc_id") == 1).collect()}
    assert lm[3].n_tokens == lm[4].n_tokens == lm[5].n_tokens == 1 and lm[6].n_tokens == 150_001 and lm[1].held_out and lm[3].score <= 0
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    net = toxicity.train(docs, spark.createDataFrame(LABELS, "doc_id long, toxic int"), F.col("doc_id") >= 0)
    by = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    assert by[3] == by[4] == by[5] == by[8] == 0.0 and all(0 <= x <= 1 for x in by.values())
    tokens = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_count.count_tokens(docs).collect()}
    assert tokens[3] == tokens[4] == (0, 0)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(stage, spark, sf, docs):
    for given in (docs, docs.limit(0)):
        out = stage(spark, given, sf)
        assert (out.columns == given.columns) == (stage is not corpus_pipeline.encode_pieces)
        assert out.count() <= given.count()
