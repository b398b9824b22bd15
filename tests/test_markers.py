"""text_markers against its SQL on texts whose blanks, marks and compatibility forms matter."""

import unicodedata

import duckdb
from larder.functions import text as X
from larder.plans import catalog
from pyspark.sql import functions as F


def test_blanks_marks_and_forms(spark, tmp_path):
    odd = [chr(i) for i in range(0x80, 0x30000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i))[0] in "MZC" and unicodedata.category(chr(i)) not in ("Cn", "Co")]
    odd += [chr(i) for i in range(0x80, 0x30000) if not 0xD800 <= i < 0xE000 and set(unicodedata.normalize("NFKD", chr(i)).lower()) & set("onaftheclO ")]
    texts = ["of\nthe", "of  the", "of\tthe", "of\u00a0the", "of the", "OF TH\u00c9", "\u00f3n\u00e2n", "\uff4fnan", "o\u0301nan", "on\u00aan", "", None, " ".join("x" * 301)]
    texts += [t for c in odd for t in (f"on{c}an", f"on{c}n", f"{c}nan", f"of{c}the", f"{c}f the", f"o{c}an", f"{c}h la", f"of {c}he", f"of t{c}e", f"of th{c}", f"ch {c}a")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(catalog.SQL["text_markers"]).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in catalog.QUERIES["text_markers"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    assert [(texts[i], got[i], want[i]) for i in got if got[i] != want[i]] == []


def test_accents_of_hangul_and_ascii_stay(spark):
    texts = ["\uac00\u0301", "A\tB", "\u00bd \ufb01", "\u00c7\u00e3O"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.strip_accents(F.col("t"))).collect()]
    assert got == ["\uac00", "a\tb", "\u00bd \ufb01", "cao"]
