"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Shingles are runs of five words (a shorter text is one shingle), labelled with their occurrence
number so that all of a text's shingles differ. Each of ``SKETCHES`` sketches takes the ``TAKE``
labelled shingles of least hash and keeps the order in which they stand in the text, so it is
sensitive to edit similarity, not to the set of shingles alone. Texts that share a sketch are
candidates. The similarity of two texts is m / (a + b - m): a and b count their labelled shingles,
m the longest common subsequence within the band that the threshold leaves, found as the longest
increasing run of matched places. Texts with similarity >= ``threshold`` (0.8) are linked; classes
are the connected components. A pair at the threshold shares a sketch with probability over 0.99999.

Copies are one node, by a 128-bit hash of the text; nodes are numbered, so no later step can mix two
texts up. Buckets are range-partitioned runs of sorted rows (sketch, next sketch, node), so a hot
bucket spreads over partitions. A row meets the run's first row, the first with the same next sketch,
and the four before it; borders of partitions are joined by their first rows. Pairs that the sizes or
a 256-bit parity sketch rule out exactly (a lower bound of the symmetric difference) are dropped.
First each node's most frequent partner is verified, then all other pairs whose nodes are still
apart. Members travel to their hub's text; a hub with many members is salted.

Last come the buckets in which some row didn't meet all others and in which several components are
left. Two texts of similarity s have sizes within the factor s, so a bucket is cut into size classes
of that width and a class meets itself and the next one only. Rows for which sizes and parity leave
no partner of another component are dropped; the others meet again with their shingles. A task counts
the shingles that a row of a smaller component shares with all others at once, by an inverted index,
and aligns only what shares enough; it returns the links that join its components, fewer than its
rows. A class of more than ``BLOCK`` rows or ``WEIGHT`` shingles is compared in blocks. So every two
texts that share a sketch and are similar enough end in one class, and pairs are never written.
Components are found by label propagation with pointer jumping; only numbers of rows reach the driver.

Defined results: texts without words (null and empty ones too) link to equal texts only, null
counting as empty; equal rows share a class; a null id is passed through, and a class whose ids are
all null has a null class_id; the class id is the least id; an empty table gives an empty table;
other columns pass through ``drop_near``, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHINGLE, SKETCHES, TAKE = 5, 12, 2
#: Most rows of a route table that is broadcast (16 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000
SALT = 256  # members of a hub in one task
BACK = 4  # rows before it that a row meets
#: Rows and labelled shingles of a size class of a bucket that one task compares with as many others.
BLOCK, WEIGHT = 4096, 1 << 21
_SEEDS = C.mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_BUCKET = "i int, s long, s2 long, t long, n long, p0 long, p1 long, p2 long, p3 long"


def shingles(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hash, the same labelled by occurrence, documents' first shingles with the total last)."""
    w = C.Words(data, offs)
    n = len(offs) - 1
    at, h = w.windows(k)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        h = np.concatenate([h, C.span_hash(w.hash, w.first[short], w.first[short] + w.counts[short])])
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    key = C.mix(h ^ C.mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    nth = np.empty(len(order), np.int64)
    nth[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return h, C.mix(h + nth.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)), np.searchsorted(doc, np.arange(n + 1))


def sketch(h: np.ndarray, labelled: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Document x SKETCHES; 0 for documents without shingles."""
    n = len(first) - 1
    size = np.diff(first)
    some = np.flatnonzero(size)
    out = np.zeros((n, SKETCHES), np.uint64)
    if not len(some):
        return out
    head, own = first[:-1][some], np.repeat(np.arange(len(some)), size[some])
    at = np.arange(len(h))
    for i, seed in enumerate(_SEEDS):
        value = C.mix(labelled ^ seed)
        places = []
        for _ in range(TAKE):
            least = np.minimum.reduceat(value, head)
            hit = np.flatnonzero(value == least[own])
            place = np.full(len(some), -1)
            place[own[hit[::-1]]] = at[hit[::-1]]
            value[place] = np.iinfo(np.uint64).max
            places.append(place)
        places = np.sort(np.stack(places, 1), axis=1)  # text order; a single shingle stands twice
        acc = np.full(len(some), np.uint64(i + 1))
        for j in range(TAKE):
            acc = C.mix(acc * np.uint64(0x9E3779B97F4A7C15) ^ h[places[:, j]])
        out[some, i] = acc
    return out


def parity(labelled: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Document x 4 words: of each of 256 hash values, whether an odd number of shingles has it."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    odd = np.bincount(doc * 256 + (labelled & np.uint64(255)).astype(np.int64), minlength=n * 256) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, 256), axis=1).view(np.uint64)


def _node_rows(batch: pa.RecordBatch) -> list[pa.Array]:
    """(id, text hashes, shingles, sketches, parity)."""
    size, sketches, odd = [], [], []
    for _, _, data, offs in C.slices(batch.column(3)):
        h, labelled, first = shingles(data, offs)
        size.append(np.diff(first))
        sketches.append(sketch(h, labelled, first).view(np.int64))
        odd.append(parity(labelled, first).view(np.int64))
    size, sketches, odd = (np.concatenate(x) for x in (size, sketches, odd))
    n = batch.num_rows
    return [*batch.columns[:3], pa.array(size), C.nested(sketches.ravel(), np.full(n, SKETCHES)), C.nested(odd.ravel(), np.full(n, 4))]


def _meet(threshold: float):
    """Sorted bucket rows to pairs (kind 0: a < b) and the runs at a partition's borders (kind 1: bucket, first row)."""
    least = (1 - threshold) / (1 + threshold)  # of the symmetric difference, as a share of a + b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None  # the last BACK rows, after the run's and the sub-run's first row
        border: list[tuple] = []
        head = sub = None
        for batch in batches:
            cols = [batch.column(j).to_numpy() for j in range(9)]
            n = len(cols[0])
            if not n:
                continue
            pre = 0
            if kept is not None:
                pre = len(kept[0])
                cols = [np.concatenate([a, b]) for a, b in zip(kept, cols, strict=True)]
            i, s, s2, t, size = cols[:5]
            odd = np.stack(cols[5:], 1).view(np.uint64)
            row = np.arange(pre, pre + n)
            new = np.ones(pre + n, bool)
            new[1:] = (i[1:] != i[:-1]) | (s[1:] != s[:-1])
            new2 = new.copy()
            new2[1:] |= s2[1:] != s2[:-1]
            if kept is not None:  # rows 0 and 1 are the first of the run and of the sub-run that go on
                new[1:pre], new2[1:pre] = False, False
                new2[1] = True
                if pre < pre + n:
                    new[pre] = i[pre] != i[pre - 1] or s[pre] != s[pre - 1]
                    new2[pre] = new[pre] or s2[pre] != s2[pre - 1]
            lead = np.maximum.accumulate(np.where(new, np.arange(pre + n), 0))
            lead2 = np.maximum.accumulate(np.where(new2, np.arange(pre + n), 0))
            if head is None:
                border.append((int(i[0]), int(s[0]), int(t[0])))
                head = True
            a, b = [lead[row], lead2[row]], [row, row]
            for back in range(1, BACK + 1):
                r = row[row - back >= (2 if pre else 0)]
                same = lead[r - back] == lead[r]
                a.append(r[same] - back)
                b.append(r[same])
            a, b = np.concatenate(a), np.concatenate(b)
            ok = t[a] != t[b]
            a, b = a[ok], b[ok]
            far = np.bitwise_count(odd[a] ^ odd[b]).sum(1)
            total = size[a] + size[b]
            ok = (far <= least * total + 1e-9) & (np.abs(size[a] - size[b]) <= least * total + 1e-9)
            pair = np.unique(np.sort(np.stack([t[a[ok]], t[b[ok]]], 1), axis=1), axis=0)
            if len(pair):
                yield _pairs(0, pair)
            last = pre + n - 1
            take = [lead[last], lead2[last], *range(max(lead[last], last - BACK + 1, 2 if pre else 0), last + 1)]
            kept = [c[take] for c in cols]
            sub = (int(i[last]), int(s[last]), int(t[lead[last]]))
        if sub is not None:
            border.append(sub)
            yield _pairs(1, np.array([(x[1] ^ x[0], x[2]) for x in sorted(set(border))], np.int64))

    return run


def _pairs(kind: int, pair: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), kind, np.int32)), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["kind", "a", "b"])


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """One row for each node and sketch."""
    rows = nodes.where("n > 0").select("t", "n", "odd", "sketches", F.posexplode("sketches").alias("i", "s"))
    return rows.select("i", "s", F.expr(f"sketches[(i + 1) % {SKETCHES}]").alias("s2"), "t", "n", *(F.col("odd")[j].alias(f"p{j}") for j in range(4)))


def candidates(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(Distinct pairs of nodes with the number of times they met; the runs that cross partitions)."""
    order = ["i", "s", "s2", "t"]
    met = C.checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_meet(threshold), "kind int, a long, b long").groupBy("kind", "a", "b").count())
    # A run that crosses partitions: all its first rows there meet the least of them (two rows a partition).
    edge = met.where("kind = 1").select(F.col("a").alias("run"), F.col("b").alias("t"))
    least = edge.groupBy("run").agg(F.min("t").alias("least"))
    crossed = edge.join(F.broadcast(least), "run").where("t <> least").select(F.least("t", "least").alias("a"), F.greatest("t", "least").alias("b"), F.lit(1).cast("long").alias("count"))
    return met.where("kind = 0").select("a", "b", "count").unionByName(crossed).groupBy("a", "b").agg(F.sum("count").alias("met")), edge.select("run").distinct()


def _allowed(side, label, t, size, odd, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different labels that sizes and parity allow; sides 0 and 1 meet, side 2 meets itself."""
    least = (1 - threshold) / (1 + threshold)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for lo in range(0, len(left), 256):
        i = left[lo : lo + 256]
        total, apart = size[i][:, None] + size[right], np.abs(size[i][:, None] - size[right])
        a, b = np.nonzero((label[i][:, None] != label[right]) & (apart <= least * total + 1e-9))
        far = np.bitwise_count(odd[i[a]] ^ odd[right[b]]).sum(1)
        near = far <= least * total[a, b] + 1e-9
        yield i[a[near]], right[b[near]]


def _doubtful(threshold: float):
    """Rows (task, side, label, t, n, parity) sorted by task: those that have any allowed pair in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def tell(cols):
            _, side, label, t, size, *odd = cols
            flag = np.zeros(len(t), bool)
            for a, b in _allowed(side, label, t, size, np.stack(odd, 1).view(np.uint64), threshold):
                flag[a] = flag[b] = True
            if flag.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[flag]) for c in cols], names=_DOUBT.replace(" long", "").replace(" int", "").split(", "))

        for batch in batches:
            cols = [batch.column(j).to_numpy() for j in range(9)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cut = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
            for lo, hi in zip([0, *cut[:-1]], cut, strict=False):
                yield from tell([c[lo:hi] for c in cols])
            held = [c[cut[-1] if len(cut) else 0 :] for c in cols]
        if held is not None:
            yield from tell(held)

    return run


_DOUBT = "task long, side int, label long, t long, n long, p0 long, p1 long, p2 long, p3 long"


def joining(side, label, t, size, shingles_of: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links (a, b) that join the components of a task's rows, each at most once, so fewer than its rows."""
    n = len(t)
    _, comp = np.unique(label, return_inverse=True)
    flat, row = np.concatenate(shingles_of), np.repeat(np.arange(n), size)
    _, which, often = np.unique(flat, return_inverse=True, return_counts=True)
    post = row[np.argsort(which, kind="stable")]  # the rows of each shingle
    start, first = np.cumsum(often) - often, np.cumsum(size) - size
    left, right = side != 1, side != 0
    found = []
    # A pair of different components has a row outside the largest one.
    for i in np.flatnonzero(comp != np.bincount(comp).argmax()):
        own = which[first[i] : first[i] + size[i]]
        own = own[often[own] > 1]
        m = often[own]
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[own], m)
        shared = np.bincount(post[at], minlength=n)
        meets = (left[i] & right) | (right[i] & left)
        enough = np.flatnonzero(meets & (comp != comp[i]) & (shared + 1e-9 >= threshold * (size[i] + size) / (1 + threshold)))
        for j in enough[np.argsort(-shared[enough], kind="stable")].tolist():
            if comp[i] != comp[j] and similarity(shingles_of[i], shingles_of[j], threshold) >= threshold - 1e-12:
                comp[comp == comp[j]] = comp[i]
                found.append((min(t[i], t[j]), max(t[i], t[j])))
        if (comp == comp[0]).all():
            break
    return found


def _link(threshold: float):
    """Rows of _doubtful with their texts, sorted by task: links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (task, side, label, t, labelled shingles) of the task that goes on

        def tell() -> Iterator[pa.RecordBatch]:
            _, side, label, t, own = zip(*held, strict=True)
            found = joining(np.array(side), np.array(label), np.array(t), np.array([len(x) for x in own]), list(own), threshold)
            held.clear()
            if found:
                pair = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(j).to_pylist() for j in range(4)]
            for lo, hi, data, offs in C.slices(batch.column(4)):
                _, labelled, first = shingles(data, offs)
                for r in range(lo, hi):
                    if held and held[0][0] != cols[0][r]:
                        yield from tell()
                    held.append((*(c[r] for c in cols), labelled[first[r - lo] : first[r - lo + 1]].copy()))
        if held:
            yield from tell()

    return run


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast where its rows (a few numbers each) are counted and few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def unmet(buckets: DataFrame, edges: DataFrame, labels: DataFrame, texts, threshold: float) -> DataFrame:
    """Links (a, b) between components in buckets where not all rows met; texts gives the texts of a frame's nodes t."""
    run = F.col("s").bitwiseXOR(F.col("i").cast("long"))
    named = buckets.join(_few(labels, labels.count()), "t", "left").withColumn("label", F.coalesce("label", "t")).withColumn("run", run)
    sizes = named.groupBy("i", "s", "run").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    wide = C.checkpoint(sizes.join(F.broadcast(edges.withColumn("edge", F.lit(True))), "run", "left").where(f"edge OR size > {BACK + 1}").select("i", "s"))  # two edges a partition
    # Class c holds its own rows (side 2) and those of the next class (side 1), which meet the former only.
    own = named.join(_few(wide, wide.count()), ["i", "s"]).withColumn("c", F.floor(F.log("n") / np.log(1 / threshold)).cast("int"))
    own = own.select("i", "s", "label", "t", "n", "p0", "p1", "p2", "p3", F.expr("explode(array(named_struct('c', c, 'up', 0), named_struct('c', c - 1, 'up', 1))) AS at")).select("*", "at.*").drop("at")
    groups = own.groupBy("i", "s", "c").agg(F.min("up").alias("least"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("weight"))
    groups = C.checkpoint(groups.where("least = 0 AND lo <> hi").select("i", "s", "c", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("weight") / WEIGHT)).cast("int").alias("blocks")))
    own = own.join(_few(groups, groups.count()), ["i", "s", "c"]).withColumn("b", F.pmod(F.xxhash64("t"), "blocks").cast("int"))
    # Block p meets block q: p's own rows are on the left, q's own ones, if p < q, and q's of the next class on the right.
    upper = "transform(sequence(0, blocks - 1), o -> named_struct('p', o, 'q', b, 'side', 1))"
    lower = "concat(transform(sequence(0, blocks - 1), o -> named_struct('p', b, 'q', o, 'side', if(o = b, 2, 0))), filter(transform(sequence(0, blocks - 1), o -> named_struct('p', o, 'q', b, 'side', 1)), x -> x.p < b))"
    sent = own.withColumn("to", F.explode(F.expr(f"if(up = 1, {upper}, {lower})")))
    sent = sent.select(F.xxhash64("i", "s", "c", "to.p", "to.q").alias("task"), F.col("to.side").alias("side"), "label", "t", "n", "p0", "p1", "p2", "p3")
    doubt = C.checkpoint(sent.repartition("task").sortWithinPartitions("task").mapInArrow(_doubtful(threshold), _DOUBT).select("task", "side", "label", "t"))
    told = doubt.join(texts(doubt.select("t").distinct()), "t").select("task", "side", "label", "t", "text")
    return C.checkpoint(told.repartition("task").sortWithinPartitions("task", "t").mapInArrow(_link(threshold), "a long, b long").distinct())


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Of labelled shingles in text order; -1 if below the threshold for certain."""
    total = len(a) + len(b)
    need = threshold * total / (1 + threshold)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = total - 2 * need + 1
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    if len(i) + 1e-9 < need:
        return -1.0
    j = j[np.argsort(i)]
    if len(j) > 1 and not (np.diff(j) > 0).all():
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        m = len(tails)
    else:
        m = len(j)
    return m / (total - m)


def _verify(threshold: float):
    """Rows sorted by (hub, salt, member flag): each hub's text, then its members'; yields linked pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.empty(0, np.uint64)
        for batch in batches:
            hubs, t = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            found = []
            for lo, hi, data, offs in C.slices(batch.column(4)):
                _, labelled, first = shingles(data, offs)
                for r in range(lo, hi):
                    mine = labelled[first[r - lo] : first[r - lo + 1]]
                    if t[r] == hubs[r]:
                        hub, own = hubs[r], mine.copy()
                    elif hub == hubs[r] and similarity(own, mine, threshold) >= threshold - 1e-12:
                        found.append((min(hub, t[r]), max(hub, t[r])))
            if found:
                pair = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough; texts gives the texts of a frame's nodes t."""
    pairs = C.checkpoint(pairs.select("a", "b"))
    number = pairs.count()
    salted = pairs.groupBy("a").count().where(F.col("count") > SALT).select("a", F.ceil(F.col("count") / SALT).cast("int").alias("salts"))  # pairs / SALT at most
    several = pairs.join(_few(salted, number // SALT), "a", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    routed = several.select(F.col("b").alias("t"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    hubs = several.select("a", "salts").distinct().select(F.col("a").alias("t"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    routes = _few(routed.unionByName(hubs), 2 * number)
    ends = pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct()
    sent = texts(ends).join(routes, "t").select("hub", "salt", (F.col("t") != F.col("hub")).alias("member"), "t", "text")
    return C.checkpoint(sent.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member", "t").mapInArrow(_verify(threshold), "a long, b long"))


#: Rows of a table of node numbers in one task, where a shuffle's partitions would be smaller.
PACK = 200_000


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """df in fewer partitions if its rows don't fill those of a shuffle."""
    few = max(12, -(-rows // PACK))
    return df.coalesce(few) if few < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(t, label) of all nodes of the edges (a, b): label is the component's least node, or, after so many rounds, some node of it."""
    edges = edges.select("a", "b")
    number = edges.count()
    both = C.checkpoint(_packed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), 2 * number))
    labels = C.checkpoint(_packed(both.groupBy(F.col("a").alias("t")).agg(F.least(F.min("b"), F.first("a")).alias("label")), 2 * number))
    done = 0
    while rounds is None or done < rounds:
        done += 1
        known = _few(labels, 2 * number)
        told = both.join(known.select(F.col("t").alias("b"), "label"), "b").select(F.col("a").alias("t"), "label", F.lit(None).cast("long").alias("was"))
        hop = labels.select("t", "label", F.col("label").alias("was")).unionByName(told).groupBy("t").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        jump = known.select(F.col("t").alias("label"), F.col("label").alias("further"))
        new = C.checkpoint(_packed(hop.join(jump, "label", "left").select("t", F.least("label", F.coalesce("further", "label")).alias("label"), "was"), 2 * number))
        C.drop_checkpoint(labels)
        labels = new.select("t", "label")
        labels._table_path = new._table_path
        if not new.where("label <> was").limit(1).count():
            break
    return labels


def _hashes(column: str):
    """Two columns of 64 bits each that name a text; null counts as empty."""
    text = F.coalesce(F.col(column), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit("another"), text)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id, h1, h2, c1, c2) of each row: its text's hashes, and those of a text that names its class."""
    h1, h2 = _hashes(text_col)
    each = docs.select(F.col(id_col).alias("id"), h1.alias("h1"), h2.alias("h2"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = C.checkpoint(C.arrow_map(each, ["id", "h1", "h2", "text"], f"id {kind}, h1 long, h2 long, n long, sketches array<long>, odd array<long>", lambda: _node_rows))
    nodes = rows.groupBy("h1", "h2").agg(F.first("n").alias("n"), F.first("sketches").alias("sketches"), F.first("odd").alias("odd"), F.min("id").alias("id"))
    nodes = C.checkpoint(nodes.withColumn("t", F.monotonically_increasing_id()))  # written, so a node keeps its number
    buckets = bucket_rows(nodes)
    pairs, edges = candidates(buckets, threshold)
    pairs = C.checkpoint(pairs)

    def texts(of: DataFrame) -> DataFrame:
        """One text for each node t: that of its least id; rows of equal id and text give it again, which verifies alike."""
        least = C.checkpoint(nodes.select("t", "h1", "h2", F.col("id").alias("least")).join(of, "t"))
        return each.join(_few(least, least.count()), ["h1", "h2"]).where(F.col("id").eqNullSafe(F.col("least"))).select("t", "text")

    # First each node's most frequent partner.
    ends = pairs.select(F.col("a").alias("t"), F.col("b").alias("other"), "met").unionByName(pairs.select(F.col("b").alias("t"), F.col("a").alias("other"), "met"))
    best = ends.groupBy("t").agg(F.max(F.struct("met", (-F.col("other")).alias("rank"), "other")).alias("best")).select("t", F.col("best.other").alias("other"))
    first = C.checkpoint(best.select(F.least("t", "other").alias("a"), F.greatest("t", "other").alias("b")).distinct())
    links = verified(first, texts, threshold)
    # Then all other pairs that a few rounds leave apart, and last those of buckets whose rows didn't all meet.
    rest = _apart(pairs.join(_few(first, first.count()), ["a", "b"], "left_anti"), components(links, 2))
    labels = components(links.unionByName(verified(rest, texts, threshold)))
    labels = _joined(labels, unmet(buckets, edges, labels, texts, threshold))
    named = nodes.select(F.col("t"), "h1", "h2")
    linked = labels.join(named, "t").join(named.select(F.col("t").alias("label"), F.col("h1").alias("c1"), F.col("h2").alias("c2")), "label").select("h1", "h2", "c1", "c2")
    linked = C.checkpoint(linked)
    found = rows.select("id", "h1", "h2").join(_few(linked, linked.count()), ["h1", "h2"], "left")
    return found.select("id", "h1", "h2", F.coalesce("c1", "h1").alias("c1"), F.coalesce("c2", "h2").alias("c2"))


def _named(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the labels la and lb of their ends."""
    labels = _few(labels, labels.count())
    la, lb = labels.select(F.col("t").alias("a"), F.col("label").alias("la")), labels.select(F.col("t").alias("b"), F.col("label").alias("lb"))
    out = pairs.select("a", "b").join(la, "a", "left").join(lb, "b", "left")
    return out.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    return _named(pairs, labels).where("la <> lb").select("a", "b")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links."""
    above = components(_named(links, labels).select(F.col("la").alias("a"), F.col("lb").alias("b")))
    everyone = labels.withColumnRenamed("label", "old").unionByName(above.select("t", F.col("t").alias("old")))
    new = everyone.join(_few(above, above.count()).withColumnRenamed("t", "old"), "old", "left")
    return C.checkpoint(new.groupBy("t").agg(F.min(F.coalesce("label", "old")).alias("label")))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id, class_id, class_size) of each row: the least id and the number of rows of its class."""
    own = classes(docs, id_col, text_col, threshold)
    sizes = own.groupBy("c1", "c2").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return own.join(sizes, ["c1", "c2"]).select(F.col("id").alias(id_col), "class_id", "class_size")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """docs with one row of each class: that of least id (of rows with that id, one)."""
    h1, h2, i2, a2, b2 = (C.free_name(docs, x) for x in ("_h1", "_h2", "_kept_id", "_kept_h1", "_kept_h2"))
    one = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h1", "h2")).alias("one")
    kept = classes(docs, id_col, text_col, threshold).groupBy("c1", "c2").agg(one).select(F.col("one.id").alias(i2), F.col("one.h1").alias(a2), F.col("one.h2").alias(b2))
    first, second = _hashes(text_col)
    keyed = docs.withColumn(h1, first).withColumn(h2, second)
    joined = keyed.join(kept, (F.col(h1) == F.col(a2)) & (F.col(h2) == F.col(b2)) & F.col(id_col).eqNullSafe(F.col(i2)), "left_semi")
    # Rows of equal id and text: one of them.
    return joined.dropDuplicates([id_col, h1, h2]).select(*docs.columns)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_classes(C.documents(spark, sf_dir))
