"""Confusion matrices and what follows from them, as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) for all pairs of the classes that occur as actual; others' predictions don't count."""
    return matrix_of(_counted(df, actual, predicted))


def _counted(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def matrix_of(counts: DataFrame) -> DataFrame:
    """confusion_matrix of rows counted by (actual, predicted)."""
    classes = counts.select("actual").distinct().where("actual IS NOT NULL")
    # Classes come from counts, a few rows; all pairs of labels are the result itself.
    pairs = classes.withColumn("all", F.lit(1)).join(classes.select(F.col("actual").alias("predicted"), F.lit(1).alias("all")), "all").drop("all")
    return pairs.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def outcomes(matrix: DataFrame) -> DataFrame:
    """(class, tp, fp, fn, tn): one pass, each cell told apart by class."""
    cells = matrix.select(F.explode(F.array_distinct(F.array("actual", "predicted"))).alias("class"), "actual", "predicted", "n")
    hit, col = F.col("actual") == F.col("class"), F.col("predicted") == F.col("class")
    total = matrix.agg(F.sum("n").alias("total"))
    some = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    out = cells.groupBy("class").agg(some(hit & col)("tp"), some(~hit & col)("fp"), some(hit & ~col)("fn"))
    return out.join(F.broadcast(total)).select("class", "tp", "fp", "fn", (F.col("total") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))  # total is one row


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall and f1; 0 where undefined."""
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    out = outcomes(matrix).withColumns({"accuracy": safe(tp + tn, tp + fp + fn + tn), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn)})
    defined = (tp + fp > 0) & (tp + fn > 0)
    return out.withColumn("f1", F.when(defined, safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).otherwise(0.0))


def explained_metrics(matrix: DataFrame) -> DataFrame:
    """(class, metric, value, derivation) with the numbers that each metric comes from."""
    m = class_metrics(matrix)
    rows = [
        ("accuracy", "accuracy", F.format_string("(%d+%d)/%d", "tp", "tn", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))),
        ("precision", "precision", F.format_string("%d/(%d+%d)", "tp", "tp", "fp")),
        ("recall", "recall", F.format_string("%d/(%d+%d)", "tp", "tp", "fn")),
        ("f1", "f1", F.format_string("2*%.6f*%.6f/(%.6f+%.6f)", "precision", "recall", "precision", "recall")),
    ]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).alias("value"), d.alias("derivation")) for n, c, d in rows)))
    return m.select("class", each.alias("x")).select("class", "x.*")


def confusion_details(matrix: DataFrame) -> DataFrame:
    """(kind, class, actual, predicted, n): each class's false positives and false negatives by pair."""
    off = matrix.where("actual <> predicted")
    return off.select(F.lit("FP").alias("kind"), F.col("predicted").alias("class"), "actual", "predicted", "n").unionByName(off.select(F.lit("FN").alias("kind"), F.col("actual").alias("class"), "actual", "predicted", "n"))


def summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: accuracy over all rows and unweighted means over the actual classes; zeros for no rows."""
    return summary_of(_counted(df, actual, predicted))


def summary_of(counts: DataFrame) -> DataFrame:
    """summary of rows counted by (actual, predicted), as n."""
    per = class_metrics(matrix_of(counts)).agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    n = F.coalesce(F.sum("n"), F.lit(0))
    return counts.agg(n.cast("long").alias("n"), F.coalesce(F.try_divide(right.cast("double"), F.sum("n").cast("double")), F.lit(0.0)).alias("accuracy")).join(per)


def render(matrix: DataFrame) -> DataFrame:
    """(line, text): the matrix as tab-separated lines, classes in order."""
    row = matrix.groupBy("actual").agg(F.array_sort(F.collect_list(F.struct("predicted", "n"))).alias("r"))
    body = row.select(F.col("actual").alias("line"), F.concat_ws("\t", F.col("actual").cast("string"), F.array_join(F.transform("r", lambda x: x["n"].cast("string")), "\t")).alias("text"))
    head = row.limit(1).select(F.lit(None).cast(matrix.schema["actual"].dataType).alias("line"), F.concat(F.lit("\t"), F.array_join(F.transform("r", lambda x: x["predicted"].cast("string")), "\t")).alias("text"))
    return head.unionByName(body)


def present(matrix: DataFrame) -> str:
    """The metrics of all classes as fixed-width lines, classes in order; the number of classes is the matrix's."""
    lines = [f"{'class':<20} {'accuracy':>9} {'precision':>9} {'recall':>9} {'f1':>9}"]
    for r in class_metrics(matrix).orderBy("class").collect():
        lines.append(f"{str(r['class']):<20} {r['accuracy']:>9.4f} {r['precision']:>9.4f} {r['recall']:>9.4f} {r['f1']:>9.4f}")
    return "\n".join(lines)


def examples(df: DataFrame, actual: str, predicted: str, key: str, text: str, k: int = 3, width: int = 90) -> DataFrame:
    """The first k wrong rows of each pair of labels, texts cut to width."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(actual, predicted).orderBy(key))
    return df.where(F.col(actual) != F.col(predicted)).withColumn("nth", nth).where(F.col("nth") <= k).select("nth", key, actual, predicted, F.substring(text, 1, width).alias("excerpt"))


def verdict_changes(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """Rows with both verdicts and whether they differ."""
    return df.withColumns({"verdict_before": before, "verdict_after": after}).withColumn("changed", F.col("verdict_before") != F.col("verdict_after"))


def mean_confidence(samples: DataFrame, confidence: str) -> DataFrame:
    """(n, mean_confidence) of the samples that have one."""
    return samples.agg(F.count(confidence).alias("n"), F.avg(confidence).alias("mean_confidence"))
