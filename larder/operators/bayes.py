"""Bags of tags and classifiers over them: Bernoulli naive Bayes by aggregates, splits, trees and forests.

Documents are long tables (id, tag, label); a document's vector is never built. Scoring sums over the
tags present and adds each class's sum over absent ones, so its cost follows the tags that occur.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import trees

# Least document frequency of a feature, smoothing, folds, share held out, seed, trees of a forest.
MIN_DF, ALPHA, FOLDS, HOLDOUT, SEED, TREES = 10, 1.0, 5, 0.25, 42, 120
TREE_MODELS = ("decision_tree", "random_forest")


def document_frequency(doc_tags: DataFrame, id_col: str, tag_col: str, least: int = MIN_DF) -> DataFrame:
    """(tag, df) of the tags in at least so many documents."""
    return doc_tags.select(id_col, F.col(tag_col).alias("tag")).distinct().groupBy("tag").agg(F.count("*").alias("df")).where(F.col("df") >= least)


def fit(docs: DataFrame, doc_tags: DataFrame, id_col: str, label_col: str, vocabulary: DataFrame, alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """((label, n_class, log_prior, absent) and (label, tag, log_p, log_q)): priors unsmoothed, likelihoods smoothed."""
    classes = docs.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n_class"))
    total = docs.agg(F.count("*").alias("n"))
    present = doc_tags.select(id_col, "tag").distinct().join(docs.select(id_col, F.col(label_col).alias("label")), id_col).join(vocabulary.select("tag"), "tag").groupBy("label", "tag").agg(F.count("*").alias("n_tag"))
    # Every class knows every tag: classes are a handful of rows.
    cells = vocabulary.select("tag").join(F.broadcast(classes)).join(present, ["label", "tag"], "left")
    p = (F.coalesce("n_tag", F.lit(0)) + alpha) / (F.col("n_class") + 2 * alpha)
    likelihood = cells.select("label", "tag", F.log(p).alias("log_p"), F.log(1 - p).alias("log_q"))
    absent = likelihood.groupBy("label").agg(F.sum("log_q").alias("absent"))
    prior = classes.join(F.broadcast(total)).join(absent, "label", "left").select("label", "n_class", F.log(F.col("n_class") / F.col("n")).alias("log_prior"), F.coalesce("absent", F.lit(0.0)).alias("absent"))
    return prior, likelihood


def joint(ids: DataFrame, doc_tags: DataFrame, id_col: str, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(id, label, score): joint log likelihood of each document and class."""
    prior, likelihood = model
    gain = doc_tags.select(id_col, "tag").distinct().join(likelihood, "tag").groupBy(id_col, "label").agg(F.sum(F.col("log_p") - F.col("log_q")).alias("gain"))
    every = ids.select(id_col).join(F.broadcast(prior))  # a row a class
    return every.join(gain, [id_col, "label"], "left").select(id_col, "label", (F.col("log_prior") + F.col("absent") + F.coalesce("gain", F.lit(0.0))).alias("score"))


def predict(scores: DataFrame, id_col: str) -> DataFrame:
    """(id, prediction): the class of highest score, ties to the first in order."""
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "label"))
    return scores.withColumn("r", nth).where("r = 1").select(id_col, F.col("label").alias("prediction"))


def probabilities(scores: DataFrame, id_col: str) -> DataFrame:
    """(id, label, probability), by a softmax shifted by the highest score."""
    w = Window.partitionBy(id_col)
    e = F.exp(F.col("score") - F.max("score").over(w))
    return scores.withColumn("e", e).select(id_col, "label", (F.col("e") / F.sum("e").over(w)).alias("probability"))


def _shuffled(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


#: Leading digits of the hash by which a label's rows are cut, 16 parts each.
_DIGITS = 3


def _dealt(df: DataFrame, id_col: str, label_col: str, seed: int) -> DataFrame:
    """Adds _nth, the row's place among its label's by hash, and _all, the label's rows. No task sorts a whole label: a
    row's place is that within its range of hashes plus the rows of the ranges before it (4096 counts a label)."""
    hashed = df.withColumn("_hash", _shuffled(id_col, seed)).withColumn("_part", F.substring("_hash", 1, _DIGITS))
    w = Window.partitionBy("_label").orderBy("_part")
    counts = hashed.groupBy(F.col(label_col).alias("_label"), F.col("_part").alias("_range")).agg(F.count("*").alias("_n")).withColumnRenamed("_range", "_part")
    before = counts.select("_label", F.col("_part").alias("_range"), (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("_label")).alias("_all"))
    both = hashed.join(F.broadcast(before), (F.col("_part") == F.col("_range")) & F.col(label_col).eqNullSafe(F.col("_label")))  # labels are few
    nth = F.row_number().over(Window.partitionBy(label_col, "_part").orderBy("_hash", id_col)) + F.col("_before")
    return both.withColumn("_nth", nth).drop("_hash", "_part", "_range", "_label", "_before")


def stratified_split(df: DataFrame, id_col: str, label_col: str, share: float = HOLDOUT, seed: int = SEED) -> DataFrame:
    """Adds is_test: of each label the rounded share of rows, those of least hash."""
    return _dealt(df, id_col, label_col, seed).withColumn("is_test", F.col("_nth") <= F.floor(F.col("_all") * share + 0.5)).drop("_nth", "_all")


def stratified_folds(df: DataFrame, id_col: str, label_col: str, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Adds fold, 0 to k - 1, dealt within each label."""
    return _dealt(df, id_col, label_col, seed).withColumn("fold", ((F.col("_nth") - 1) % k).cast("int")).drop("_nth", "_all")


def cross_validate(docs: DataFrame, doc_tags: DataFrame, id_col: str, label_col: str, vocabulary: DataFrame, k: int = FOLDS, alpha: float = ALPHA) -> DataFrame:
    """(fold, n, accuracy) of naive Bayes. Counts are made once by fold; what a fold learns from is all less its own."""
    dealt = stratified_folds(docs, id_col, label_col, k).select(id_col, F.col(label_col).alias("label"), "fold", F.lit(1).alias("n"))
    told = fold_predictions(dealt, doc_tags, id_col, vocabulary, alpha)
    return told.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def fold_predictions(dealt: DataFrame, doc_tags: DataFrame, id_col: str, vocabulary: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(id, fold, label, n, prediction) of naive Bayes that learns from the other folds, ties to the first class. dealt: (id, label, fold, n), a row
    standing for n equal ones; fold -1 stands for held-out rows, which teach nothing and are told by all the rest."""
    sizes = dealt.groupBy("fold", "label").agg(F.sum("n").alias("own"))
    folds = sizes.select("fold").distinct()
    labels = sizes.where("fold >= 0").groupBy("label").agg(F.sum("own").alias("all"))
    of_others = lambda every, own: F.coalesce(every, F.lit(0)) - F.when(F.col("fold") >= 0, F.coalesce(own, F.lit(0))).otherwise(0)
    # A row for each fold and label, a handful.
    classes = folds.join(F.broadcast(labels)).join(sizes, ["fold", "label"], "left").select("fold", "label", of_others(F.col("all"), F.col("own")).alias("n_class")).where("n_class > 0")
    tags = doc_tags.select(id_col, "tag").distinct().join(vocabulary.select("tag"), "tag").join(dealt, id_col)
    own = tags.groupBy("fold", "label", "tag").agg(F.sum("n").alias("n_own"))
    total = own.where("fold >= 0").groupBy("label", "tag").agg(F.sum("n_own").alias("n_all"))
    cells = vocabulary.select("tag").join(F.broadcast(classes)).join(total, ["label", "tag"], "left").join(own, ["fold", "label", "tag"], "left")
    p = (of_others(F.col("n_all"), F.col("n_own")) + alpha) / (F.col("n_class") + 2 * alpha)
    likelihood = cells.select("fold", "label", "tag", F.log(p).alias("log_p"), F.log(1 - p).alias("log_q"))
    absent = likelihood.groupBy("fold", "label").agg(F.sum("log_q").alias("absent"))
    of_fold = Window.partitionBy("fold")
    prior = classes.join(absent, ["fold", "label"], "left").select("fold", F.col("label").alias("told"), (F.log(F.col("n_class") / F.sum("n_class").over(of_fold)) + F.coalesce("absent", F.lit(0.0))).alias("base"))
    gain = tags.select(id_col, "fold", "tag").join(likelihood, ["fold", "tag"]).groupBy(id_col, F.col("label").alias("told")).agg(F.sum(F.col("log_p") - F.col("log_q")).alias("gain"))
    scores = dealt.join(F.broadcast(prior), "fold").join(gain, [id_col, "told"], "left").withColumn("score", F.col("base") + F.coalesce("gain", F.lit(0.0)))
    best = scores.groupBy(id_col, "fold", "label", "n").agg(F.min(F.struct((-F.col("score")).alias("s"), "told")).alias("best"))
    return best.select(id_col, "fold", "label", "n", F.col("best.told").alias("prediction"))


def labelled_bags(rows: DataFrame, id_col: str, status, ingredients: str, least: int = MIN_DF) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((id, label), (id, tag), (tag, df)) of the rows that teach: weak labels by the status column, tags of the ingredients, and the vocabulary."""
    from ..functions import text as X
    from . import rules

    some = rows.withColumn("label", status).where(rules.trainable(F.col(ingredients), F.col("label"))).select(id_col, "label", F.col(ingredients).alias("tags"))
    some = some.persist(StorageLevel.MEMORY_AND_DISK)  # read by all three
    tags = some.select(id_col, F.explode(F.array_distinct(X.tag_list(F.col("tags")))).alias("tag"))
    return some.select(id_col, "label"), tags, document_frequency(tags, id_col, "tag", least)


#: Most features, as a row holds a bit for each and a task counts for each.
MOST_FEATURES = 65_536


def features(vocabulary: DataFrame) -> list[str]:
    """The tags in order, if they are few enough."""
    tags = [r.tag for r in vocabulary.select("tag").distinct().limit(MOST_FEATURES + 1).collect()]
    if len(tags) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features; raise the least document frequency")
    return sorted(tags)


def classes_of(dealt: DataFrame, label_col: str = "label", most: int = 1000) -> list:
    found = [r[0] for r in dealt.select(label_col).where(F.col(label_col).isNotNull()).distinct().orderBy(label_col).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} classes")
    return found


def vectors(dealt: DataFrame, doc_tags: DataFrame, id_col: str, label_col: str, vocabulary: list[str]) -> DataFrame:
    """(row, y, fold, bits) for trees: a bit for each feature, in order. dealt has a fold, -1 for held-out rows; rows without a label are left
    out, and ids must be unique. Kept in memory or on disk, as trees read it at each level."""
    classes, n, spark = classes_of(dealt, label_col), len(vocabulary), dealt.sparkSession
    numbered = F.broadcast(spark.createDataFrame([(t, i) for i, t in enumerate(sorted(vocabulary))], "tag string, at int"))
    named = F.broadcast(spark.createDataFrame([(c, i) for i, c in enumerate(classes)], T.StructType([T.StructField(label_col, dealt.schema[label_col].dataType), T.StructField("y", T.IntegerType())])))
    sets = doc_tags.join(numbered, "tag").groupBy(id_col).agg(F.collect_set("at").alias("at"))  # a bag's own tags
    rows = dealt.join(sets, id_col, "left").join(named, label_col).select(F.xxhash64(id_col).alias("row"), "y", "fold", "at")
    width = -(-n // 8)

    def packed(batches):
        for b in batches:
            at, out = b["at"], []
            for i in range(0, len(at), some := max(1, (1 << 22) // max(1, width * 8))):
                own = at.slice(i, some).fill_null([]) if at.null_count else at.slice(i, some)
                flags = np.zeros((len(own), width * 8), np.uint8)
                flags[np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False)), own.flatten().to_numpy(zero_copy_only=False)] = 1
                out += [x.tobytes() for x in np.packbits(flags, axis=1)]
            yield pa.RecordBatch.from_arrays([b["row"], b["y"], b["fold"], pa.array(out, pa.binary())], names=["row", "y", "fold", "bits"])

    return rows.mapInArrow(packed, "row long, y int, fold int, bits binary").persist(StorageLevel.MEMORY_AND_DISK)


def tree_runs(name: str, folds: list[int]) -> list[trees.Run]:
    """A fit for each fold: an unlimited tree by entropy, or 120 trees by Gini impurity."""
    if name == "decision_tree":
        return [trees.Run(name, f) for f in folds]
    return [trees.Run(name, f, TREES, "gini", True) for f in folds]


def holdout(docs: DataFrame, doc_tags: DataFrame, id_col: str, label_col: str, vocabulary: DataFrame, model: str = "random_forest") -> DataFrame:
    """(id, label, prediction) of the held-out quarter by trees grown on the rest."""
    split = stratified_split(docs.select(id_col, F.col(label_col).alias("label")), id_col, "label").select(id_col, "label", F.when(F.col("is_test"), -1).otherwise(0).alias("fold"))
    words, classes = features(vocabulary), classes_of(split)
    told = trees.grow_and_predict(vectors(split, doc_tags, id_col, "label", words), tree_runs(model, [-1]), len(words), max(1, len(classes)))
    told = told.join(F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(classes)), T.StructType([T.StructField("prediction", T.IntegerType()), T.StructField("named", split.schema["label"].dataType)]))), "prediction").select("row", F.col("named").alias("prediction"))
    return split.where("fold = -1").withColumn("row", F.xxhash64(id_col)).join(told, "row").select(id_col, "label", "prediction")


def compare_models(docs: DataFrame, doc_tags: DataFrame, id_col: str, label_col: str, vocabulary: DataFrame, names: list[str], k: int = FOLDS) -> DataFrame:
    """(model, cv_accuracy, cv_std, n, accuracy, macro_precision, macro_recall, macro_f1): folds on the training part, measures on the held-out part.

    Rows of equal label, fold and features are counted once, as every model tells them the same. Trees of all models, folds and the final fit grow
    together, naive Bayes counts once for all of them, and measures come from the counts of (model, fold, label, prediction). Rows without a label
    are left out.
    """
    from . import metrics

    split = stratified_split(docs.select(id_col, F.col(label_col).alias("label")), id_col, "label").where("label IS NOT NULL").persist(StorageLevel.MEMORY_AND_DISK)
    train, test = split.where("NOT is_test").drop("is_test"), split.where("is_test").drop("is_test")
    dealt = stratified_folds(train, id_col, "label", k).select(id_col, "label", "fold").unionByName(test.withColumn("fold", F.lit(-1)))
    words, classes = features(vocabulary), classes_of(split)
    rows = vectors(dealt, doc_tags, id_col, "label", words)
    bags = _planned_anew(rows.groupBy("fold", "bits", F.col("y").alias("label")).agg(F.count("*").alias("n")))
    told = []
    if grown := [n for n in names if n in TREE_MODELS]:
        runs = [r for name in grown for r in tree_runs(name, [*range(k), -1])]
        named = F.broadcast(docs.sparkSession.createDataFrame([(i, r.name) for i, r in enumerate(runs)], "run int, model string"))
        own = trees.predictions(rows, runs, len(words), max(1, len(classes))).join(named, "run")
        told.append(_pairs(bags.join(own, ["fold", "bits"])))
    if "naive_bayes" in names:
        told.append(_pairs(_bags_by_bayes(bags, len(words)).withColumn("model", F.lit("naive_bayes"))))
    counts = functools.reduce(DataFrame.unionByName, told)
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    out = None
    for name in names:
        own = counts.where(F.col("model") == name)
        folds = own.where("fold >= 0").groupBy("fold").agg((right / F.sum("n")).alias("accuracy"))
        cv = folds.agg(F.lit(name).alias("model"), F.avg("accuracy").alias("cv_accuracy"), F.stddev_pop("accuracy").alias("cv_std"))
        row = cv.join(F.broadcast(metrics.summary_of(own.where("fold = -1").select("actual", "predicted", "n"))))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def _planned_anew(df: DataFrame) -> DataFrame:
    """df computed and kept, with nothing of its plan: what is read many times would repeat it, and the driver plan for minutes."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    return kept.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else kept.localCheckpoint()


def _pairs(told: DataFrame) -> DataFrame:
    """A row for each model, fold and pair of classes."""
    return _planned_anew(told.groupBy("model", "fold", F.col("label").alias("actual"), F.col("prediction").alias("predicted")).agg(F.sum("n").alias("n")))


def _bags_by_bayes(bags: DataFrame, n: int) -> DataFrame:
    """fold_predictions of bags (fold, bits, label, n), each of which is told by its own bits; n: the features."""

    def listed(batches):
        for b in batches:
            bits = b["bits"].to_pylist()
            for i in range(0, len(bits), some := max(1, (1 << 22) // max(1, n))):
                flat = np.frombuffer(b"".join(bits[i : i + some]), np.uint8).reshape(len(bits[i : i + some]), -(-n // 8))
                row, at = np.nonzero(np.unpackbits(flat, axis=1)[:, :n])
                yield pa.RecordBatch.from_arrays([b["bag"].take(pa.array(row + i)), pa.array(at.astype(np.int32))], names=["bag", "tag"])

    named = bags.withColumn("bag", F.struct("fold", "bits", "label"))
    tags = named.select("bag", "bits").mapInArrow(listed, T.StructType([T.StructField("bag", named.schema["bag"].dataType), T.StructField("tag", T.IntegerType())]))
    vocabulary = bags.sparkSession.range(n).select(F.col("id").cast("int").alias("tag"))
    return fold_predictions(named.select("bag", "label", "fold", "n"), tags, "bag", vocabulary)
