"""String and set distances over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def hamming(a: Column, b: Column) -> Column:
    """Differing places of texts of equal length; an error for others."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    total = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), F.when(F.length(a) == 0, F.lit(0)).otherwise(total)).otherwise(F.raise_error("hamming: texts differ in length").cast("int"))


def jaccard_index(a: Column, b: Column) -> Column:
    """Of arrays taken as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaccard_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - jaccard_index(a, b)


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared elements by the smaller set; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def char_ngrams(c: Column, n: int = 2) -> Column:
    """Distinct runs of n characters without spaces; a shorter text is its own run, an empty one has none."""
    text = F.replace(c, F.lit(" "), F.lit(""))
    size = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))
