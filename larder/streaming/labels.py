"""Ingredient analysis as a stream: a document is one row, so every grade is stateless but for the groups of its own segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules
from ..plans import knowledge as K


def to_table(stream: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", **trigger):
    """Starts a query that appends (id, gluten_grade, allergen_status, recommendations) of each micro-batch as Parquet."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    spark = stream.sparkSession
    phrases, allergens = K.phrases(K.lexicon(spark)), K.allergens(spark)

    def each(batch: DataFrame, number: int) -> None:
        out = rules.report(batch, phrases, allergens, id_col, text_col).select(id_col, "gluten_grade", "allergen_status", "recommendations")
        out.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")  # again after a failure: the same place

    return stream.select(id_col, text_col).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def tag_status(stream: DataFrame, allergens: str = "allergens", ingredients: str = "ingredients_tags", labels: str = "labels_tags") -> DataFrame:
    """The stream with status by tag rules; a plain projection."""
    return stream.withColumn("status", rules.tag_status(F.col(allergens), F.col(ingredients), F.col(labels)))


def windowed_tags(stream: DataFrame, time_col: str, column: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, tag, n) of tumbling windows; rows later than the watermark don't count."""
    timed = stream.withWatermark(time_col, late).where(F.col(column).isNotNull())
    exploded = timed.select(time_col, F.explode(F.split(F.lower(F.col(column)), ",")).alias("tag"))
    return exploded.groupBy(F.window(time_col, width), F.trim("tag").alias("tag")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "tag", "n")

