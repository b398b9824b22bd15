"""Statistics of product tables: coverage, tag frequencies, knowledge-base lookups, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# What marks a product of Portugal.
COUNTRY_TAG = "en:portugal"
COUNTRY_NAMES = ["portugal", "portugais", "portugues"]


def in_country(tags: Column, names: Column, tag: str = COUNTRY_TAG, markers: list[str] | None = None) -> Column:
    """The tag list holds the tag, or the free text any of the markers."""
    by_name = F.lower(F.coalesce(names, F.lit(""))).rlike("|".join(markers or COUNTRY_NAMES))
    return F.lower(F.coalesce(tags, F.lit(""))).contains(tag) | by_name


def coverage(df: DataFrame, columns: list[str] | None = None, top: int | None = 15) -> DataFrame:
    """(column, n, pct) of non-null values, most first; one pass whatever the number of columns."""
    columns = columns or df.columns
    one = df.agg(F.count("*").alias("_total"), *(F.count(F.col(c)).alias(c) for c in columns))
    long = one.unpivot(["_total"], columns, "column", "n")
    out = long.select("column", "n", F.bround(F.col("n") * 100.0 / F.greatest("_total", F.lit(1)), 1).alias("pct")).orderBy(F.desc("n"), "column")
    return out.limit(top) if top else out


def exploded_tags(df: DataFrame, column: str) -> DataFrame:
    """One row for each tag occurrence, lower-cased and trimmed; repeated and empty ones stay."""
    return df.where(F.col(column).isNotNull()).select(F.explode(F.split(F.lower(F.col(column).cast("string")), ",")).alias("tag")).select(X._re(F.col("tag"), r"(?U)^\s+|\s+$").alias("tag"))


def tag_frequency(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(tag, n), most first, ties by tag."""
    out = exploded_tags(df, column).groupBy("tag").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "tag").limit(top) if top else out


def lookup_left(kb: DataFrame, counts: DataFrame, total: Column) -> DataFrame:
    """Every row of kb (tag, ...) with its count, 0 where missing, and percentage of total to two places."""
    out = kb.join(counts, "tag", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.withColumn("pct", F.bround(F.col("n") * 100.0 / total, 2))


def lookup_inner(kb: DataFrame, counts: DataFrame) -> DataFrame:
    return kb.join(counts, "tag").where("n > 0")


def distribution(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """(value, n, pct) for the values of domain in its order, 0 where none."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    fixed = spark.createDataFrame([(i, v) for i, v in enumerate(domain)], "ord int, value string")
    out = fixed.join(counts, "value", "left").join(F.broadcast(total))  # total is one row
    return out.select("ord", "value", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.bround(F.coalesce("n", F.lit(0)) * 100.0 / F.greatest("total", F.lit(1)), 2).alias("pct"))


def grade_histogram(df: DataFrame, column: str, grades: str = "abcde") -> DataFrame:
    """Counts of the grades after lower-casing; other values don't count."""
    valid = df.select(F.lower(F.col(column)).alias("grade")).where(F.col("grade").isin(*grades))
    return distribution(valid, "grade", list(grades)).select("ord", F.col("value").alias("grade"), "n")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones for the same seed: those of least hash."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(h, key).limit(n)


def clean_products(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """One row a key, rows without any of the required columns gone."""
    return df.dropna(subset=required).dropDuplicates([key])
