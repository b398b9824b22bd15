"""The corpus pipeline: documents through five stages, each written and read again by its caller.

Every stage works on all rows that the one before kept, whole texts; all but the last return the
columns of documents. What stages give in odd cases, besides what they state: an empty table gives an
empty table; ids, languages and sources may be null and pass through; extra columns pass through the
first four, whatever their names; ties and repeated rows are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import common, decontaminate, line_dedup, near_dedup, sentencepiece_bpe, toxicity

#: Documents of at least this toxicity go.
TOXIC = 0.7


#: Most rows that Spark hands to a Python worker at once, as an operator can't bound that itself: two tasks of an executor, each
#: with buffers on both sides, share its memory. A stage's rows are read after it returns, so the session keeps the setting.
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of less than TOXIC stay; the network learns from the labelled rows of docs.

    Null, empty and wordless texts score 0 and stay; equal rows share a fate; without labels of both kinds all stay.
    """
    _small_batches(spark)
    net = toxicity.train(docs, common.documents(spark, sf_dir, "labels"), toxicity.teaches())
    scored, name = toxicity.with_score(docs, net)
    return scored.where(F.col(name) < TOXIC).select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least 10 documents hold go from all of them; every document stays.

    A null text stays null, an empty one empty; rows of equal id and text count as one document, and each loses the same lines.
    """
    _small_batches(spark)
    return _recounted(line_dedup.drop_lines(docs, min_docs=10))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays: that of least id, null last; of rows of equal id and text, one.

    Null and empty texts are copies of each other, so one row of all of them stays; other texts without words equal their copies only.
    """
    _small_batches(spark)
    return near_dedup.drop_near(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 10 words or more of benchmark items (or a whole shorter item) go from the texts; every document stays.

    Null and empty texts stay as they are; without items nothing goes.
    """
    _small_batches(spark)
    return _recounted(decontaminate.remove_spans(docs, common.documents(spark, sf_dir, "benchmark")))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (end id last) and the text they decode to: (doc_id, lang, source, n_tokens, ids, decoded).

    Null and empty texts are the end id alone and decode to an empty text.
    """
    _small_batches(spark)
    coded = sentencepiece_bpe.encode(docs.select("doc_id", "lang", "source", "text"), decoded_col="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the trained network, the alignment or the encoder; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; each writes a checkpoint, so none is computed twice."""
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.checkpoint(docs)
    return docs
