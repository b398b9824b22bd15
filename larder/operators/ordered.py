"""Ordered work on keys that may hold most of the rows: running flags and ordered concatenation by ranges.

A key's rows are cut where quantiles of the order column over all rows say, so no task orders a whole key.
Each (key, range) is worked on alone; what a range passes on to the next ones is one row a range, and
only these few rows of a key meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that all rows are cut into.
RANGES = 200


def cut(rows: DataFrame, order: str, name: str, ranges: int = RANGES) -> DataFrame:
    """Adds the number of the row's range of the order column (a number or timestamp; null is in the first). One job finds the bounds, which only decide where the work is done."""
    from pyspark.ml.feature import Bucketizer

    value = F.col(order).cast("double")
    told = rows.select(F.approx_percentile(value, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    bounds = [-float("inf"), *sorted(set(told)), float("inf")]
    if len(bounds) < 3:
        return rows.withColumn(name, F.lit(0.0))
    as_double = f"{name}_value"
    both = rows.withColumn(as_double, F.coalesce(value, F.lit(-float("inf"))))
    return Bucketizer(splits=bounds, inputCol=as_double, outputCol=name).transform(both).drop(as_double)


def running_any(rows: DataFrame, key: str, order: str, flags: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """Adds a column for each flag: whether it holds for this row or one before it of the same key (null counts as false; rows of equal order by the flags themselves, as an order among them isn't defined)."""
    own = rows.withColumns({f"_own_{n}": F.coalesce(c, F.lit(False)) for n, c in flags.items()})
    parts = cut(own, order, "_range", ranges)
    within = Window.partitionBy(key, "_range").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = parts.withColumns({f"_here_{n}": F.max(f"_own_{n}").over(within) for n in flags})
    sums = parts.groupBy(key, "_range").agg(*(F.max(f"_own_{n}").alias(f"_all_{n}") for n in flags))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carried = sums.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), *(F.coalesce(F.max(f"_all_{n}").over(before), F.lit(False)).alias(f"_before_{n}") for n in flags))
    both = here.join(carried, here[key].eqNullSafe(carried["_key"]) & (F.col("_range") == F.col("_of")))
    return both.select(*rows.columns, *((F.col(f"_here_{n}") | F.col(f"_before_{n}")).alias(n) for n in flags))


def concatenated(rows: DataFrame, key: str, order: str, text: Column, number: Column, keep: Column, ranges: int = RANGES) -> DataFrame:
    """(key, text, n, total): of the rows to keep, the texts joined by spaces in order (ties by text), how many, and the sum of the number.
    Keys without such rows have an empty text, 0 and 0.0."""
    parts = cut(rows.select(F.col(key), F.col(order).alias("_order"), text.alias("_text"), number.cast("double").alias("_number"), F.coalesce(keep, F.lit(False)).alias("_keep")), "_order", "_range", ranges)
    word = F.when(F.col("_keep"), F.struct("_order", F.coalesce("_text", F.lit("")).alias("t")))
    each = parts.groupBy(key, "_range").agg(F.array_sort(F.collect_list(word)).alias("w"), F.sum(F.when(F.col("_keep"), F.col("_number"))).alias("total"))
    joined = each.select(key, "_range", F.array_join(F.transform("w", lambda w: w["t"]), " ").alias("piece"), F.size("w").alias("n"), "total")
    some = F.when(F.col("n") > 0, F.struct("_range", "piece"))
    every = joined.groupBy(key).agg(F.array_sort(F.collect_list(some)).alias("p"), F.sum("n").alias("n"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"))
    return every.select(key, F.array_join(F.transform("p", lambda p: p["piece"]), " ").alias("text"), "n", "total")
