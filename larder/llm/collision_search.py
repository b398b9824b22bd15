"""Nearest neighbours by largest inner product, by collision counting over single projections.

Inner products become distances: a vector over the largest norm gets one more component that makes it
a unit vector, a query over its own norm gets a zero, so d^2 = 2 - 2 <v, q> / (|q| top). Each of
``PROJECTIONS`` Gaussian vectors gives one sorted array of the indexed vectors' projections. A query
opens a window of half-width t around its own projection in every array (virtual rehashing: t grows,
nothing is hashed again). A vector at distance d lies in a window with probability 2 Phi(t / d) - 1, so
the number of windows that hold it, its collisions, is binomial; one with at least ``THRESHOLD`` of
them is verified by its exact inner product. A search ends when a vector as far as the k-th best that
is known would reach the threshold with probability ``SURE``: t >= z d for a constant z.

Spark's part: rows are dealt round robin into shards, each task builds the arrays of one shard once
and then streams all queries through it (a query set against all rows, in blocks). So that shards
needn't search for how far to look, each query first searches a bounded sample (``SAMPLE`` rows by
hash, for the bound only; all rows are indexed); the k-th best found there bounds t, rows worse
than it are not sent, and what was found there is verified again in its shard, so a query's list is full. Windows that are wide are counted by comparing ranks, narrow ones by walking
them; both count the same.

Defined results: an own row is one of the query's id, so no row of the same id is its neighbour; repeated rows
(equal id and vector) are candidates each and one query; rows of equal id and other vectors are queries each;
null ids, null, empty or zero vectors, nulls, NaN or infinities in them, and vectors of another length
than the most frequent (ties: the longer) take no part, nor do norms of ``LARGEST`` or more, whose products may overflow; fewer candidates than k give all of them; ties go to the smaller id; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

PROJECTIONS, THRESHOLD, SURE = 128, 96, 0.95
#: Rows of the sample that bounds each query's search.
SAMPLE = 16384
#: Rows of a block of sorted arrays (ranks are 16 bits), blocks of a shard, rows from which a shard is cut in more.
BLOCK, BLOCKS, SMALL = 65535, 2, 16384
#: A window's first half-width, and how it grows until k vectors are verified.
FIRST, GROWTH = 0.2, 2.0
#: Share of all (vector, window) pairs from which ranks are compared.
WIDE = 1 / 16
QUERIES = 512  # searched at once
#: Norms from which inner products could pass the largest double.
LARGEST = 1e150


@cache
def reach(m: int = PROJECTIONS, threshold: int = THRESHOLD, sure: float = SURE) -> float:
    """z: windows of half-width z d hold a vector at distance d in at least threshold of m arrays with probability sure."""

    def enough(p: float) -> float:
        return sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(threshold, m + 1))

    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if enough(mid) >= sure else (mid, hi)
    a, b = 0.0, 40.0
    for _ in range(80):
        z = (a + b) / 2
        a, b = (a, z) if math.erf(z / math.sqrt(2)) >= hi else (z, b)
    return b


@cache
def directions(size: int, m: int = PROJECTIONS) -> np.ndarray:
    """The Gaussian vectors, the last component for what makes indexed vectors unit vectors."""
    return np.random.default_rng(size).standard_normal((m, size + 1)).astype(np.float32)


class Block:
    """The sorted arrays of up to 65 535 vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float):
        self.ids, self.vectors = ids, vectors
        self.top, self.unit = top, (vectors / top).astype(np.float32)
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", self.unit, self.unit)))
        way = directions(vectors.shape[1])
        shadow = way[:, :-1] @ self.unit.T + np.outer(way[:, -1], rest)
        order = np.argsort(shadow, axis=1)
        self.sorted = np.take_along_axis(shadow, order, 1)
        self.order = order.astype(np.uint16)
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, order, np.arange(len(ids), dtype=np.uint16)[None], 1)
        self.by_id = np.argsort(ids, kind="stable")
        self.in_order = ids[self.by_id]

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Of all rows of these ids."""
        lo, hi = np.searchsorted(self.in_order, ids, "left"), np.searchsorted(self.in_order, ids, "right")
        return self.by_id[np.concatenate([np.empty(0, np.int64), *(np.arange(a, b) for a, b in zip(lo, hi, strict=True) if b > a)])]

    def windows(self, shadows: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, width) of each query's window in each array: queries x arrays."""
        lo, hi = (np.empty(shadows.shape, np.int64) for _ in range(2))
        for i, row in enumerate(self.sorted):
            lo[:, i] = np.searchsorted(row, shadows[:, i] - half, "left")
            hi[:, i] = np.searchsorted(row, shadows[:, i] + half, "right")
        return lo, hi - lo

    def colliding(self, lo: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Flags of the vectors that enough of one query's windows hold."""
        n, m = len(self.ids), len(lo)
        if (width > 0).sum() < THRESHOLD:
            return np.zeros(n, bool)
        count = np.zeros(n, np.uint8)
        if width.sum() < WIDE * n * m:
            for i in range(m):
                count[self.order[i, lo[i] : lo[i] + width[i]]] += 1
        else:
            place, there = np.empty(n, np.uint16), np.empty(n, bool)
            for i in range(m):
                np.subtract(self.rank[i], np.uint16(lo[i] & 0xFFFF), out=place)  # wraps around
                np.less(place, np.uint16(width[i]), out=there)
                np.add(count, there.view(np.uint8), out=count)
        return count >= THRESHOLD

    def verified(self, at: np.ndarray, own: int, query: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best of the places, best first, none under least."""
        at = at[self.ids[at] != own]
        # In single precision first, with room for its error; what may be among the k best is computed exactly.
        norm = float(norms(query[None])[0])
        rough = self.unit[at] @ (query / norm).astype(np.float32)
        room = 8 * (len(query) + 8) * 2.0**-24
        floor = max(least / norm / self.top, float(np.partition(rough, -k)[-k]) if len(at) > k else -math.inf)
        at = at[rough >= floor - room]
        scores = (self.vectors[at].astype(np.float64) * query).sum(1)
        good = scores >= least
        at, scores = at[good], scores[good]
        if len(at) > k:
            good = scores >= np.partition(scores, -k)[-k]
            at, scores = at[good], scores[good]
        first = np.lexsort((self.ids[at], -scores))[:k]
        return scores[first], self.ids[at[first]]


def norms(rows: np.ndarray) -> np.ndarray:
    """Without underflow of squares."""
    largest = np.abs(rows).max(1)
    return largest * np.sqrt(((rows / largest[:, None]) ** 2).sum(1))


def distance(score: np.ndarray | float, norm: np.ndarray | float, top: float):
    return np.sqrt(np.maximum(0.0, 2 - 2 * (np.asarray(score) / norm / top)))


def search(block: Block, own: np.ndarray, queries: np.ndarray, least: np.ndarray, top: float, k: int, known_ids: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(scores, ids) of each query's k best of the block that aren't under its least (-inf: not known); rows of known ids are verified too."""
    queries = queries.astype(np.float64)
    norm = norms(queries)
    shadows = (queries / norm[:, None]).astype(np.float32) @ directions(queries.shape[1])[:, :-1].T
    z, known = reach() * (1 + 1e-4), np.isfinite(least)  # a trifle more, as projections are of single precision
    half = np.where(known, z * distance(np.where(known, least, 0), norm, top), FIRST)
    out: list = [None] * len(queries)
    live = np.arange(len(queries))
    while len(live):
        lo, width = block.windows(shadows[live], half[live])
        on = []
        for j, q in enumerate(live.tolist()):
            flags = block.colliding(lo[j], width[j])
            if known_ids is not None:
                flags[block.places(known_ids[q])] = True
            scores, ids = block.verified(np.flatnonzero(flags), own[q], queries[q], least[q], k)
            if known[q] or (width[j] == len(block.ids)).all():
                out[q] = scores, ids
            elif len(scores) < k:
                half[q] *= GROWTH
                on.append(q)
            else:
                far = z * distance(scores[-1], norm[q], top)
                known[q] = far >= half[q]
                if half[q] >= far:
                    out[q] = scores, ids
                else:  # the k-th best can only come nearer
                    half[q] = far
                    on.append(q)
        live = np.array(on, np.int64)
    return out


def _table(ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return ids.to_numpy(), flat.reshape(len(ids), -1)


def _bounds(sample, top: float, k: int):
    """A query's least score, the k-th best of the sample (-inf if there are fewer), and the ids found."""

    def make():
        block = Block(*sample.value, top)

        def each(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
            for a in range(0, batch.num_rows, QUERIES):
                part = batch.slice(a, QUERIES)
                own, queries = _table(*part.columns)
                found = search(block, own, queries, np.full(len(own), -np.inf), top, k)
                yield [*part.columns, pa.array([float(s[-1]) if len(s) == k else -math.inf for s, _ in found]), pa.array([i for _, i in found], pa.list_(pa.int64()))]

        return each

    return make


_FOUND = "query_id long, query long, vec_id long, score double"


def _searched(top: float, k: int):
    """Over rows sorted by shard and kind: vectors (kind 0) become sorted arrays, then queries (kind 1) are answered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, blocks = None, [], None
        for batch in batches:
            for one in _runs(batch):
                if one["shard"][0].as_py() != shard:
                    shard, rows, blocks = one["shard"][0].as_py(), [], None
                if one["kind"][0].as_py() == 0:
                    rows.append(_table(one["id"], one["vec"]))
                    continue
                if blocks is None:
                    ids, vectors = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64), None)
                    rows = []
                    blocks = [Block(ids[i : i + BLOCK], vectors[i : i + BLOCK], top) for i in range(0, len(ids), BLOCK)]
                for a in range(0, one.num_rows, QUERIES):
                    part = one.slice(a, QUERIES)
                    own, queries = _table(part["id"], part["vec"])
                    least, name = part["least"].to_numpy(), part["query"].to_numpy()
                    told = [x.values.to_numpy() for x in part["found"]]
                    for block in blocks:
                        found = search(block, own, queries, least, top, k, told)
                        size = [len(s) for s, _ in found]
                        if sum(size):
                            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, size)), pa.array(np.repeat(name, size)), pa.array(np.concatenate([i for _, i in found])), pa.array(np.concatenate([s for s, _ in found]))], names=["query_id", "query", "vec_id", "score"])
        C.tidy()

    return run


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one shard and kind."""
    shard, kind = batch["shard"].to_numpy(), batch["kind"].to_numpy()
    cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _checked(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
    """Of (id, vec): what takes part, with the vector's length and norm."""
    ids, vectors = batch.columns
    sizes = vectors.value_lengths().fill_null(0).to_numpy()
    first = np.cumsum(sizes) - sizes
    flat = vectors.flatten()
    bad = np.flatnonzero(~np.isfinite(flat.cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)))
    ok = (sizes > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
    ok[np.searchsorted(first + sizes, bad, "right")] = False
    for size in np.unique(sizes[ok]).tolist():
        at = np.flatnonzero(ok & (sizes == size))
        rows = flat.take(pa.array((first[at][:, None] + np.arange(size)).reshape(-1))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        some = (rows != 0).any(1)
        at, norm = at[some], norms(rows[some])
        at, norm = at[norm < LARGEST], norm[norm < LARGEST]
        take = pa.array(at)
        yield [ids.take(take), vectors.take(take), pa.array(np.full(len(at), size, np.int32)), pa.array(norm)]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, float]:
    """((id, vec) of the rows that take part, their number, the largest norm)."""
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    some = C.arrow_map(named, ["id", "vec"], f"id long, vec {named.schema['vec'].dataType.simpleString()}, length int, norm double", lambda: _checked)
    per = some.groupBy("length").agg(F.count("*").alias("n"), F.max("norm").alias("top"))
    first = per.orderBy(F.desc("n"), F.desc("length")).first()
    return (some.where(F.col("length") == first.length).select("id", "vec"), first.n, first.top) if first else (some.select("id", "vec"), 0, 1.0)


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row for which is_query(id column) is true."""
    spark = vectors.sparkSession
    some, n, top = usable(vectors, id_col, vec_col)
    shards = max(1, -(-n // (BLOCK * BLOCKS)), min(64, -(-n // SMALL)))
    index = C.checkpoint(some.repartition(shards).withColumn("shard", F.spark_partition_id()))
    taken = index.select("id", "vec")
    if n > sample:
        taken = taken.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)) < int((1 << 30) * sample / n)).dropDuplicates()
    told = taken.toArrow()  # about `sample` rows, as hashes deal them and repeated rows count once
    blocks = spark.sparkContext.broadcast(_table(told["id"].combine_chunks(), told["vec"].combine_chunks()) if len(told) else (np.empty(0, np.int64), np.empty((0, 1))))
    # Dealt anew, as queries are few rows that cost much.
    own = index.where(is_query(F.col("id"))).select("id", "vec").dropDuplicates().repartition(max(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kind = own.schema["vec"].dataType.simpleString()
    asked = C.checkpoint(C.arrow_map(own, ["id", "vec"], f"id long, vec {kind}, least double, found array<long>", _bounds(blocks, top, k)))
    named = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "vec", "least", "found", F.xxhash64("vec").alias("query"))
    both = index.select("shard", F.lit(0).alias("kind"), "id", "vec", F.lit(0.0).alias("least"), F.lit(None).cast("array<long>").alias("found"), F.lit(0).cast("long").alias("query")).unionByName(named)
    found = both.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_searched(top, k), _FOUND)
    first = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all rows to each row whose id is divisible by 20."""
    return nearest(C.documents(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
