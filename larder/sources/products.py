"""Reading and writing product tables, label samples and images."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import stats

# The columns that are kept of a dump.
KEPT = """
code url product_name brands categories categories_tags categories_en ingredients_text ingredients_tags allergens
allergens_en traces traces_tags traces_en labels labels_tags labels_en nutriscore_grade nutrition_grade_fr countries
countries_tags countries_en main_category main_category_en
""".split()
# Texts that mean a missing value.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

PRODUCTS = T.StructType([T.StructField(c, T.StringType()) for c in KEPT])
OCR_SAMPLES = T.StructType([T.StructField(c, T.DoubleType() if c == "mean_conf" else T.StringType()) for c in ("code", "product_name", "ref_ingredients", "ocr_raw", "ocr_clean", "ocr_ingredients", "mean_conf", "image")])


def missing_to_null(df: DataFrame) -> DataFrame:
    """In text columns, what means a missing value becomes null."""
    return df.select(*(F.when(~F.col(f"`{f.name}`").isin(MISSING), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema))


def read_dump(spark: SparkSession, path: str, wanted: list[str] | None = None, sep: str = "\t", partitions: int | None = None) -> DataFrame:
    """A (compressed) separated dump: the wanted columns that it has, as text. A gzip file is one task, so more partitions follow."""
    raw = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=True, maxCharsPerColumn=-1, encoding="UTF-8")
    own = [c for c in wanted or KEPT if c in raw.columns]
    if lacking := [c for c in wanted or KEPT if c not in raw.columns]:
        warnings.warn(f"columns that {path} lacks: {', '.join(lacking)}", stacklevel=2)
    return raw.select(*own).repartition(partitions) if partitions else raw.select(*own)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """A filtered comma-separated table, all text, missing values as null; codes keep leading zeros."""
    header = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return missing_to_null(header)


def read_typed(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A separated table with the types that its values show; texts that mean a missing value are null first."""
    text = missing_to_null(spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=True))
    like = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=True, inferSchema=True, nullValue="NA").schema
    return text.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in like))


def lookup_batches(codes: DataFrame, fetch: Callable[[list[str]], dict[str, str]], code_col: str = "code", size: int = 100, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """(code, body, error) of each different code, asked for in batches of a partition. fetch gives what it found of a batch; one that raises
    OSError is asked again after a wait that doubles, then its halves are, so that one bad code costs no other its body. A code that isn't
    found has neither body nor error. Tasks that run again ask again."""

    def asked(own: list[str]) -> Iterator[tuple[str, str | None, str | None]]:
        for n in range(tries):
            try:
                found = fetch(own)
                yield from ((c, found.get(c), None) for c in own)
                return
            except OSError as e:
                error = f"{type(e).__name__}: {e}"
                if n + 1 < tries:
                    time.sleep(wait * 2**n)
        if len(own) == 1:
            yield own[0], None, error
        else:
            yield from asked(own[: len(own) // 2])
            yield from asked(own[len(own) // 2 :])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []

        def answers(own: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*asked(own), strict=True)], names=["code", "body", "error"])

        for batch in batches:
            waiting += batch.column(0).to_pylist()
            while len(waiting) >= size:
                yield answers(waiting[:size])
                waiting = waiting[size:]
        if waiting:
            yield answers(waiting)

    return codes.select(F.col(code_col).cast("string").alias("code")).where("code IS NOT NULL").distinct().mapInArrow(run, "code string, body string, error string")


def lookup_products(codes: DataFrame, fetch: Callable[[str], str | None], code_col: str = "code") -> DataFrame:
    """(code, body) of each different code, for services that answer one at a time: what fetch gives for it, null where it fails."""
    return lookup_batches(codes, lambda own: {c: fetch(c) for c in own}, code_col, size=1, tries=1).select("code", "body")


def filter_dump(dump: DataFrame, tag: str = stats.COUNTRY_TAG, markers: list[str] | None = None) -> tuple[DataFrame, Observation, Observation]:
    """The country's rows, with observations of the rows read and kept once the result is used."""
    read, kept = Observation(), Observation()
    have = lambda c: F.col(c) if c in dump.columns else F.lit(None).cast("string")
    out = dump.observe(read, F.count(F.lit(1)).alias("rows")).where(stats.in_country(have("countries_tags"), have("countries"), tag, markers))
    return out.observe(kept, F.count(F.lit(1)).alias("rows")), read, kept


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With header; null becomes an empty field."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", quote="\"", escape="\"")


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType = OCR_SAMPLES) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def require(spark: SparkSession, path: str) -> None:
    """An error that names the path if nothing is there, by Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"no input at {path}")


def product_of_response(c: Column) -> Column:
    """The product object of an API response, null unless its status is 1."""
    return F.when(F.get_json_object(c, "$.status") == "1", F.get_json_object(c, "$.product"))


def ingredients_image(product: Column) -> Column:
    """First address: full before display, pt, en, fr, es; else the plain field; always of the full size."""
    order = [f"$.selected_images.ingredients.{size}.{lang}" for size in ("full", "display") for lang in ("pt", "en", "fr", "es")]
    return X.full_size_url(X.coalesce_text(*(F.get_json_object(product, p) for p in [*order, "$.image_ingredients_url"])))


def candidates(products: DataFrame, n: int = 5, least: int = 30, seed: int = 42) -> DataFrame:
    """n products with code, name and a text longer than least, chosen by hash."""
    own = products.dropna(subset=["code", "ingredients_text", "product_name"]).where(F.length("ingredients_text") > least)
    return stats.sample_rows(own.select("code", "product_name", "ingredients_text"), "code", n, seed)


def words_to_text(words: Column) -> Column:
    """Of an array of (text, conf): non-blank words of confidence 0 or more, joined, and their mean confidence (0 if none)."""
    good = F.filter(words, lambda w: (F.trim(w["text"]) != "") & (w["conf"] >= 0))
    total = F.aggregate(good, F.lit(0.0), lambda s, w: s + w["conf"].cast("double"))
    return F.struct(F.array_join(F.transform(good, lambda w: F.trim(w["text"])), " ").alias("raw_text"), F.coalesce(F.try_divide(total, F.size(good)), F.lit(0.0)).alias("mean_confidence"))


def words_of_rows(rows: DataFrame, key: str, order: str, text: Column, conf: Column) -> DataFrame:
    """words_to_text() of words as rows: (key, raw_text, mean_confidence), for keys of any size; no task gathers all words of a key."""
    from ..operators.ordered import concatenated

    said = concatenated(rows, key, order, F.trim(text), conf, (F.trim(text) != "") & (conf >= 0))
    return said.select(key, F.col("text").alias("raw_text"), F.coalesce(F.try_divide("total", "n"), F.lit(0.0)).alias("mean_confidence"))


def ocr_result(words: Column) -> Column:
    """raw_text, cleaned_text, ingredients_only and mean_confidence of recognised words."""
    seen = words_to_text(words)
    clean = X.clean_ocr_text(seen["raw_text"])
    return X.once(F.struct(seen.alias("seen"), clean.alias("clean")), lambda x: F.struct(x["seen"]["raw_text"].alias("raw_text"), x["clean"].alias("cleaned_text"), X.ingredients_section(x["clean"]).alias("ingredients_only"), x["seen"]["mean_confidence"].alias("mean_confidence")))


def _reported(texts: DataFrame, phrases: DataFrame, allergens: DataFrame, id_col: str) -> DataFrame:
    """Reports of (id, raw_text, mean_confidence): the text is cleaned, the list is cut out, and the recognition's quality is told."""
    from ..operators import analysis, rules

    clean = texts.withColumn("_clean", X.clean_ocr_text(F.col("raw_text")))
    cut = clean.select(id_col, X.coalesce_text(X.ingredients_section(F.col("_clean")), F.col("_clean")).alias("text"))
    told = rules.explain(rules.assess(analysis.analyze(cut, phrases, allergens, id_col, "text")))
    quality = texts.select(F.col(id_col).alias("_id"), F.col("mean_confidence").alias("ocr_quality"))
    return rules.recommend(told.join(quality, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id"), F.col("ocr_quality"))


def report_words(samples: DataFrame, phrases: DataFrame, allergens: DataFrame, id_col: str = "code", words_col: str = "words") -> DataFrame:
    """Reports of recognised images, whose words are an array of (text, conf)."""
    seen = samples.select(id_col, words_to_text(F.col(words_col)).alias("_seen"))
    return _reported(seen.select(id_col, "_seen.raw_text", "_seen.mean_confidence"), phrases, allergens, id_col)


def report_word_rows(rows: DataFrame, key: str, order: str, text: Column, conf: Column, phrases: DataFrame, allergens: DataFrame) -> DataFrame:
    """Reports of recognised words that are rows, for images of any size."""
    return _reported(words_of_rows(rows, key, order, text, conf), phrases, allergens, key)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of image files; an unreadable path is an error of the reader."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
