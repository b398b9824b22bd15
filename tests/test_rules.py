"""Analyses, grades, explanations and reports of stated texts; metrics of a stated matrix; sources and streams."""

import gzip
import json

import numpy as np
import pytest
from larder.operators import analysis as A
from larder.operators import bayes as B
from larder.operators import metrics as M
from larder.operators import rules as R
from larder.operators import stats as S
from larder.plans import catalog
from larder.plans import knowledge as K
from larder.sources import products as P
from larder.streaming import labels
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def kb(spark):
    return K.phrases(K.lexicon(spark)).cache(), K.allergens(spark)


def report(spark, kb, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return R.report(df, *kb).orderBy("doc_id")


MUESLI = """# Relatório de análise: Produto (texto)

## Resumo

- **Estado relativo ao glúten:** Contem Gluten
- **Estado de alergénios:** Possui alergenios

## Análise dos ingredientes

| Ingrediente | Estado | Observação |
| --- | :---: | --- |
| aveia | ❌ | Contem gluten (cereal ou derivado); alergenio: Cereais com gluten |
| malte de cevada | ❌ | Contem gluten (cereal ou derivado); alergenio: Cereais com gluten |
| farinha de trigo | ❌ | Contem gluten (cereal ou derivado); alergenio: Cereais com gluten |
| acucar | ✅ | Sem gluten conhecido |
| oleo | ✅ | Sem gluten conhecido |
| sal | ✅ | Sem gluten conhecido |
| frutos de casca rija | ⚠️ | Sem gluten conhecido; alergenio: Frutos de casca rija (declarado apenas como possivel traco) |

## Alergénios detetados

- Cereais com gluten (ingrediente)
- Frutos de casca rija (tracos)

## Recomendações

- Produto INADEQUADO para celiacos ou intolerantes ao gluten.
- Contem alergenios declarados: Cereais com gluten. Inadequado para alergicos a estes.
- Pode conter vestigios de: Frutos de casca rija.
- Em caso de duvida, contactar sempre o fabricante.
"""


def test_report_markdown(spark, kb):
    got = R.render_markdown(report(spark, kb, catalog.GOLDEN[0][1]), "Produto (texto)").first().markdown
    assert got == MUESLI


def test_details(spark, kb):
    r = report(spark, kb, "centeo", "Leite. Sem gluten, farinha de trigo", None, "Contem: soja. Pode conter leite, Contem ovo", "x9 zzzzzz, qqqqqq, wwwww, sal").collect()
    assert r[0].matches[0].method == "difuso" and r[0].rows[0].observation == "Contem gluten (cereal ou derivado); alergenio: Cereais com gluten [correspondencia aproximada 86%]"
    assert r[1].gluten_grade == "Sem Gluten" and "Atencao: rotulo sem gluten mas foram detetados cereais com gluten (farinha de trigo)." in r[1].reasons
    assert r[2].gluten_grade == "Baixo Risco" and r[2].matches == [] and r[2].recommendations[-1].startswith("Em caso")
    assert [(m.term, m.declaration) for m in r[3].matches] == [("soja", "contem"), ("leite", "tracos"), ("ovo", "tracos")]
    assert r[4].gluten_grade == "Baixo Risco" and len(r[4].unknown) == 3
    low = R.recommend(R.explain(R.assess(A.analyze(spark.createDataFrame([(1, "sal")], "doc_id int, text string"), *kb))), F.lit(48.2)).first()
    assert "Confianca de OCR baixa (48%): fotografar o rotulo com melhor iluminacao e foco." in low.recommendations


def test_duplicate_forms_and_ranks(spark, kb):
    rows = {r.folded: r for r in kb[0].collect()}
    assert rows["fecula"].gluten == "ambiguous"
    assert rows["farinha de trigo"].rank < rows["farinha"].rank < rows["trigo"].rank
    assert len(K.GLUTEN_TAGS) == 49 and len(K.AMBIGUOUS_TAGS) == 36 and len(K.FREE_LABELS) == 6 and len(K.ALLERGENS) == 14 and len(K.core_rows()) == 53


def test_renderings(spark, kb):
    r = R.to_json(R.analysis_table(R.render_text(report(spark, kb, catalog.GOLDEN[1][1], "Leite. Sem gluten")))).collect()
    assert "(3 segmento(s) de texto nao reconhecido(s)" in r[0].plain and r[0].plain.startswith("#" * 70 + "\n# RELATORIO DE ANALISE: Produto\n")
    assert r[0].table.endswith("Segmentos nao reconhecidos: 3") and r[1].table.startswith('Rotulo "sem gluten"')
    body = json.loads(r[1].json)
    assert body["allergens"] == {"Leite": "ingrediente"} and body["n_recognized"] == 1 and body["ingredients"][0]["score"] == 1.0


def test_metrics(spark):
    df = spark.createDataFrame(list(zip("CDFFCDDC", "CFDFCCDC", strict=True)), "a string, p string")
    m = M.confusion_matrix(df, "a", "p")
    assert {r["class"]: (r.tp, r.fp, r.fn, r.tn) for r in M.outcomes(m).collect()} == {"C": (3, 1, 0, 4), "D": (1, 1, 2, 4), "F": (1, 1, 1, 5)}
    assert [r.text for r in M.render(m).orderBy(F.col("line").asc_nulls_first()).collect()] == ["\tC\tD\tF", "C\t3\t0\t0", "D\t1\t1\t1", "F\t0\t1\t1"]
    # A prediction that is never an actual class is wrong, but in no cell; a class never predicted has no precision.
    odd = spark.createDataFrame([("a", "z"), ("a", "a"), ("b", "a")], "a string, p string")
    s = M.summary(odd, "a", "p").first()
    assert s.accuracy == pytest.approx(1 / 3) and {r["class"]: r.f1 for r in M.class_metrics(M.confusion_matrix(odd, "a", "p")).collect()}["b"] == 0
    assert M.summary(odd.limit(0), "a", "p").first().accuracy == 0


@pytest.mark.parametrize(("cells", "accuracy", "f1"), [([[558, 15, 14], [3, 977, 131], [5, 80, 410]], 0.8869, 0.8813), ([[473, 53], [79, 895]], 0.9120, 0.9044)])
def test_published_matrices(spark, cells, accuracy, f1):
    flat = [(str(i), str(j), n) for i, r in enumerate(cells) for j, n in enumerate(r)]
    m = M.class_metrics(spark.createDataFrame(flat, "actual string, predicted string, n long")).toPandas()
    assert m.tp.sum() / sum(x[2] for x in flat) == pytest.approx(accuracy, abs=1e-4)
    assert m.f1.mean() == pytest.approx(f1, abs=1e-4)


def test_naive_bayes_numpy(spark):
    r = np.random.default_rng(3)
    x, y = r.random((60, 7)) < 0.4, r.integers(0, 2, 60)
    docs = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id int, label int")
    tags = spark.createDataFrame([(i, f"t{j}") for i in range(60) for j in range(7) if x[i, j]], "id int, tag string")
    vocabulary = spark.createDataFrame([(f"t{j}",) for j in range(7)], "tag string")
    scores = B.joint(docs, tags, "id", B.fit(docs, tags, "id", "label", vocabulary))
    got = scores.toPandas().pivot(index="id", columns="label", values="score").to_numpy()
    want = np.empty((60, 2))
    for c in (0, 1):
        p = (x[y == c].sum(0) + 1) / ((y == c).sum() + 2)
        want[:, c] = np.log((y == c).mean()) + x @ np.log(p) + (1 - x) @ np.log(1 - p)
    assert np.allclose(got, want)
    pred = B.predict(scores, "id").toPandas().sort_values("id").prediction.to_numpy()
    assert (pred == want.argmax(1)).all()
    assert np.allclose(B.probabilities(scores, "id").groupBy("id").agg(F.sum("probability").alias("s")).toPandas().s, 1)


def test_cross_validation_numpy(spark):
    r = np.random.default_rng(8)
    x, y = r.random((90, 5)) < 0.5, r.integers(0, 3, 90)
    docs = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id int, label int")
    tags = spark.createDataFrame([(i, f"t{j}") for i in range(90) for j in range(5) if x[i, j]], "id int, tag string")
    vocabulary = spark.createDataFrame([(f"t{j}",) for j in range(5)], "tag string")
    fold = B.stratified_folds(docs, "id", "label", 3).toPandas().sort_values("id").fold.to_numpy()
    got = {q.fold: (q.n, q.accuracy) for q in B.cross_validate(docs, tags, "id", "label", vocabulary, 3).collect()}
    for f in range(3):
        a, b = fold != f, fold == f
        scores = np.stack([np.log((y[a] == c).mean()) + x[b] @ np.log(p) + (1 - x[b]) @ np.log(1 - p) for c in range(3) for p in [(x[a & (y == c)].sum(0) + 1) / ((y[a] == c).sum() + 2)]], 1)
        assert got[f] == (b.sum(), pytest.approx((scores.argmax(1) == y[b]).mean()))
    both = B.compare_models(docs, tags, "id", "label", vocabulary, ["naive_bayes", "decision_tree"], k=2).toPandas()
    assert both.model.tolist() == ["naive_bayes", "decision_tree"] and both.accuracy.between(0, 1).all()


def test_dump_and_sinks(spark, tmp_path):
    lines = ["code\tcountries_tags\tcountries\tingredients_text\textra", '007\ten:portugal,en:france\t\t"a ""b"""\tx', "8\t\tPortugal\tNA\tx", "9\ten:spain\tEspaña\tc\tx"]
    with gzip.open(tmp_path / "dump.csv.gz", "wt") as f:
        f.write("\n".join(lines))
    P.require(spark, str(tmp_path / "dump.csv.gz"))
    with pytest.raises(FileNotFoundError):
        P.require(spark, str(tmp_path / "absent"))
    kept, read, seen = P.filter_dump(P.read_dump(spark, str(tmp_path / "dump.csv.gz"), partitions=2))
    P.write_csv(kept, str(tmp_path / "out"), single=True)
    assert (read.get["rows"], seen.get["rows"]) == (3, 2)
    back = P.read_products(spark, str(tmp_path / "out")).orderBy("code").collect()
    assert [(r.code, r.ingredients_text) for r in back] == [("007", 'a "b"'), ("8", None)] and "extra" not in back[0]
    P.write_json(kept.select("code"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    (tmp_path / "s.json").write_text('[{"code": "1", "mean_conf": 48.5}]')
    assert P.read_json(spark, str(tmp_path / "s.json")).first().mean_conf == 48.5
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"x")
    assert P.read_images(spark, str(tmp_path / "img")).first().content == b"x"


def test_recognised_words(spark):
    df = spark.createDataFrame([([("Ingredientes:", 90.0), ("s4l", 30.0), (" ", 50.0), ("x", -1.0)],), ([],)], "w array<struct<text: string, conf: double>>")
    a, b = df.select(P.ocr_result(F.col("w")).alias("r")).select("r.*").collect()
    assert (a.raw_text, a.mean_confidence, a.ingredients_only) == ("Ingredientes: s4l", 60.0, "s4l") and (b.raw_text, b.mean_confidence) == ("", 0.0)


def test_empty_tables(spark, kb):
    none = spark.createDataFrame([], "doc_id int, text string")
    assert R.report(none, *kb).count() == 0
    assert S.coverage(none).collect()[0].pct == 0 and S.distribution(none.withColumnRenamed("text", "v"), "v", ["a"]).collect()[0].n == 0


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "Trigo, sal"), (2, "Sal")], "doc_id long, text string").write.parquet(str(src))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(src))
    labels.to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.doc_id: r.gluten_grade for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "Contem Gluten", 2: "Sem Gluten"}
    with pytest.raises(ValueError, match="not a stream"):
        labels.to_table(spark.range(1), "x", "y")
    timed = spark.readStream.schema("doc_id long, text string").parquet(str(src)).withColumn("ts", F.timestamp_seconds("doc_id"))
    q = labels.windowed_tags(timed, "ts", "text").writeStream.format("memory").queryName("tagged").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.tag, r.n) for r in spark.table("tagged").collect()} == {("trigo", 1), ("sal", 2)}
