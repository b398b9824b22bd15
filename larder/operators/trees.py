"""Decision trees and random forests over bags of tags, without a limit of depth, all folds and trees at once.

A row is its class and one bit a feature. Rows of equal bits and class are one bag from the start, with
the summed weight in every tree of those it learns from and the folds that ask for the bits, so what
follows grows with the different bags and not with the rows. Every tree of every run (a fold of a cross-validation, or the final fit) is grown together: nodes
of many bags are split level by level, one job a level, from class counts by (tree, node, feature) that
tasks sum up first; once a node has few bags they are sent to one task, packed, which grows the rest of
that subtree. The bits that a run predicts travel with the bags it learns from, so a subtree is grown,
used and dropped in the same task, some trees of a run one after the other, and what comes back is their
summed share for each class by bits.

Splits: the largest decrease of impurity, ties to the first feature; a node that isn't pure is split as long as some
feature tells its rows apart, even without a decrease. Forests draw each row with a Poisson(1) weight
from the hash of (row, tree), look at the first sqrt(features) in the order of a hash of (tree, node,
feature) that tell rows apart, and average the shares of their trees. A node is named by its path, so
results don't depend on where it is grown. All of it is the same on every run.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A node with at most so many bags times features (of 8 bytes) is grown by one task.
SMALL_CELLS = 1 << 23
#: Trees of a run that one task grows one after the other, so their shares are summed before they are sent.
TOGETHER = 8
#: Rows of a task that draws weights.
DRAWN = 100_000
#: Most nodes above those at a level, as the trees so far are sent to every task; more trees or bags raise what a task grows.
MOST_NODES = 1 << 20
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


@dataclass(frozen=True)
class Run:
    """Trees that learn from the rows of other folds and predict those of fold; fold -1 stands for the held-out rows."""

    name: str
    fold: int
    trees: int = 1
    impurity: str = "entropy"
    forest: bool = False


def _mixed(*parts) -> np.ndarray:
    """A 64-bit hash of whole numbers, element by element."""
    with np.errstate(over="ignore"):
        h = np.uint64(0x9E3779B97F4A7C15)
        for p in parts:
            h = (np.asarray(p).astype(np.uint64) ^ h) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
        return h


def bootstrap(rows: np.ndarray, tree: int) -> np.ndarray:
    """Poisson(1) weights of rows in a tree."""
    return np.searchsorted(_POISSON, _mixed(rows, tree) / 2.0**64).astype(np.int64)


#: By the first 12 bits of a hash: the weight, or UNSURE where the other bits decide it.
_UNSURE = 255
_STEPS = np.searchsorted(_POISSON, np.arange(4097) / 4096)
_WEIGHT = np.where(_STEPS[:-1] == _STEPS[1:], _STEPS[:-1], _UNSURE).astype(np.uint8)


def _draws(hashed: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """bootstrap() of rows, of which the hashes are given, in all trees, a byte each."""
    h = hashed[:, None] ^ trees.astype(np.uint64)[None]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    out = _WEIGHT[(h >> np.uint64(52)).view(np.int64)]
    rest = np.flatnonzero(out.reshape(-1) == _UNSURE)
    out.reshape(-1)[rest] = np.searchsorted(_POISSON, h.reshape(-1)[rest] / 2.0**64)
    return out


def bootstraps(rows: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """bootstrap() of all rows in all trees, a byte each."""
    return _draws(_mixed(rows), trees)


def impurity(counts: np.ndarray, kind: str) -> np.ndarray:
    """Of class counts along the last axis."""
    total = counts.sum(-1, keepdims=True)
    p = counts / np.where(total > 0, total, 1)
    if kind == "gini":
        return 1 - (p * p).sum(-1)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1)


def _looked_at(valid: np.ndarray, tree: int, nodes: np.ndarray) -> np.ndarray:
    """Of the valid features of each node those that a forest looks at."""
    features = valid.shape[1]
    few = max(1, int(math.sqrt(features)))
    if few >= features:
        return valid
    order = _mixed(tree, nodes[:, None], np.arange(features)[None]).astype(np.float64)
    order[~valid] = np.inf
    return valid & (order <= np.partition(order, few - 1, axis=1)[:, few - 1 : few])


def _gain(present: np.ndarray, total: np.ndarray, kind: str) -> np.ndarray:
    """By node and feature, rounded so that ties stay ties whatever the order of sums."""
    absent = total[:, None, :] - present
    n = total.sum(-1)[:, None]
    return np.round(impurity(total, kind)[:, None] - (present.sum(-1) * impurity(present, kind) + absent.sum(-1) * impurity(absent, kind)) / np.where(n > 0, n, 1), 12)


def best_splits(present: np.ndarray, total: np.ndarray, run: Run, tree: int, nodes: np.ndarray) -> np.ndarray:
    """The feature each node is split by, -1 for leaves. present: (nodes, features, classes) counts of rows with the feature; total: (nodes, classes)."""
    if not present.shape[1]:
        return np.full(len(total), -1)
    right = present.sum(-1)
    valid = (right > 0) & (right < total.sum(-1)[:, None]) & ((total > 0).sum(-1) > 1)[:, None]
    if run.forest:
        valid = _looked_at(valid, tree, nodes)
    gain = np.where(valid, _gain(present, total, run.impurity), -np.inf)
    return np.where(valid.any(1), gain.argmax(1), -1)


def _forest_splits(x: np.ndarray, weight: np.ndarray, head: np.ndarray, total: np.ndarray, run: Run, tree: int, nodes: np.ndarray) -> np.ndarray:
    """best_splits() of rows in order of their nodes, which begin at head: only the features that are looked at are counted."""
    some = np.bitwise_or.reduceat(x, head, axis=0)
    valid = (some != np.bitwise_and.reduceat(x, head, axis=0)) & ((total > 0).sum(-1) > 1)[:, None]
    seen = _looked_at(valid, tree, nodes)
    most = max(1, int(seen.sum(1).max()))
    looked = np.argsort(~seen, axis=1, kind="stable")[:, :most]  # in order, those that aren't looked at last
    node = np.repeat(np.arange(len(head)), np.diff(head, append=len(x)))
    at = np.arange(len(x))
    present = np.empty((len(head), most, weight.shape[1]), np.int64)
    for i in range(most):
        has = x[at, looked[node, i]]
        for c in range(weight.shape[1]):
            present[:, i, c] = np.add.reduceat(weight[:, c] * has, head)
    own = np.take_along_axis(seen, looked, 1)
    gain = np.where(own, _gain(present, total, run.impurity), -np.inf)
    return np.where(own.any(1), np.take_along_axis(looked, gain.argmax(1)[:, None], 1)[:, 0], -1)


def _counts(x: np.ndarray, weight: np.ndarray, head: np.ndarray) -> np.ndarray:
    """(nodes, features, classes) counts of rows with each feature. Rows are in order of their nodes, which begin at head; weight: (rows, classes)."""
    present = np.empty((len(head), x.shape[1], weight.shape[1]), np.int64)
    for a in range(0, x.shape[1], 64):  # so that memory is bounded by some features
        for c in range(weight.shape[1]):
            present[:, a : a + 64, c] = np.add.reduceat(x[:, a : a + 64] * weight[:, c : c + 1], head, axis=0)
    return present


def _in_order(node: np.ndarray, nodes: int) -> np.ndarray:
    """The rows by node; small numbers are sorted by their digits."""
    return np.argsort(node.astype(np.uint16) if nodes <= 1 << 16 else node, kind="stable")


class Subtree:
    """A tree grown from rows in memory, level by level."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, run: Run, tree: int, root: int):
        """x: 0 or 1 by row and feature; weight: by row and class; root: the number of the first node, by which forests look at features."""
        x = x.astype(np.uint8, copy=False)
        head, names, opened = np.zeros(min(1, len(x)), np.int64), np.array([root], np.uint64), 1
        feature, child, share = [], [], []
        while len(x):  # in order of their nodes
            total = np.add.reduceat(weight, head, axis=0)
            split = np.full(len(head), -1)
            mixed = (total > 0).sum(1) > 1
            rows = np.repeat(mixed, np.diff(head, append=len(x)))
            share.append(total / total.sum(1, keepdims=True))
            if mixed.any() and x.shape[1]:
                size = np.diff(head, append=len(x))[mixed]
                x, weight, head = x[rows], weight[rows], np.cumsum(size) - size
                if run.forest:
                    split[mixed] = _forest_splits(x, weight, head, total[mixed], run, tree, names[mixed])
                else:
                    split[mixed] = best_splits(_counts(x, weight, head), total[mixed], run, tree, names[mixed])
            on = split >= 0
            feature.append(split)
            child.append(np.where(on, opened + 2 * (np.cumsum(on) - 1), -1))
            opened += 2 * int(on.sum())
            if not on.any():
                break
            names = names[on]
            names = np.stack([_mixed(names, 1), _mixed(names, 2)], 1).reshape(-1)
            f = np.repeat(split[mixed], size)
            x, weight, f = x[f >= 0], weight[f >= 0], f[f >= 0]
            size = size[split[mixed] >= 0]
            node = 2 * np.repeat(np.arange(len(size)), size) + x[np.arange(len(x)), f]
            order = _in_order(node, len(names))
            x, weight = x[order], weight[order]
            size = np.bincount(node, minlength=len(names))
            head = np.cumsum(size) - size
        self.feature, self.child, self.share = (np.concatenate(p) if p else np.empty(0, np.int64) for p in (feature, child, share))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Shares of the classes by row."""
        at = np.zeros(len(x), np.int64)
        live = np.flatnonzero(self.feature[at] >= 0)
        while len(live):
            at[live] = self.child[at[live]] + x[live, self.feature[at[live]]]
            live = live[self.feature[at[live]] >= 0]
        return self.share[at]


def _listed_runs(runs: list[Run]) -> list[tuple[int, Run]]:
    return [(i, r) for i, r in enumerate(runs) for _ in range(r.trees)]


class _Top:
    """Of each tree its large nodes: the feature and first child (that without it; the other is the next) of those that are split, the shares of those that can't be."""

    def __init__(self):
        self.split: dict[int, dict[int, tuple[int, int]]] = {}
        self.leaf: dict[int, dict[int, list[float]]] = {}
        self.nodes: dict[int, int] = {}
        self.names: dict[tuple[int, int], int] = {}

    def name(self, tree: int, node: int) -> int:
        """By which forests look at features, as in Subtree."""
        return self.names.get((tree, node), 0)

    def open(self, tree: int, node: int, feature: int) -> int:
        child = self.nodes.get(tree, 1)
        self.nodes[tree] = child + 2
        self.split.setdefault(tree, {})[node] = feature, child
        own = np.array([self.name(tree, node)], np.uint64)
        self.names |= {(tree, child + i): int(_mixed(own, i + 1)[0]) for i in (0, 1)}
        return child

    def leaves(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The node of each row that no large split leaves."""
        node, own = np.zeros(len(x), np.int64), self.split.get(tree, {})
        front = {0: np.arange(len(x))} if 0 in own else {}
        while front:
            down = {}
            for n, rows in front.items():
                feature, child = own[n]
                node[rows] = child + x[rows, feature]
                down |= {c: rows[node[rows] == c] for c in (child, child + 1) if c in own}
            front = down
        return node


def _unpacked(column: pa.Array, features: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -(-features // 8))
    return np.unpackbits(flat, axis=1)[:, :features]


_BAGS = "bits binary, y int, asked binary, weights binary"


def _folds(runs: list[Run]) -> list[int]:
    return sorted({r.fold for r in runs})


def _bagged(runs: list[Run]):
    """Of rows in order of (bits, y): a row for each run of equal ones, with a flag for each fold of the runs that holds some, and the
    weight in each tree of those that it learns from; held-out rows (fold -1) teach nothing."""
    listed = [r for _, r in _listed_runs(runs)]
    folds = _folds(runs)
    drawn = {f: np.array([t for t, r in enumerate(listed) if r.forest and r.fold == f], np.int64) for f in folds}
    plain = {f: np.array([t for t, r in enumerate(listed) if not r.forest and r.fold == f], np.int64) for f in folds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bits, row, fold, y = batch["bits"].to_pylist(), batch["row"].to_numpy(), batch["fold"].to_numpy(), batch["y"].to_numpy()
            new = np.ones(len(bits), bool)
            new[1:] = [a != b for a, b in zip(bits, bits[1:], strict=False)]
            new[1:] |= np.diff(y) != 0
            head, bag = np.flatnonzero(new), np.cumsum(new) - 1
            asked, hashed = np.zeros((len(head), len(folds)), np.uint8), _mixed(row)
            weights = np.zeros((len(head), len(listed)), np.uint32)
            for i, f in enumerate(folds):
                asked[bag[fold == f], i] = 1
                taught = np.flatnonzero((fold >= 0) & (fold != f))
                if len(plain[f]):
                    weights[:, plain[f]] = np.bincount(bag[taught], minlength=len(head))[:, None]
                block = max(16, (1 << 15) // max(1, len(drawn[f])))  # what a processor's cache holds
                for k in range(0, len(taught) if len(drawn[f]) else 0, block):
                    some = taught[k : k + block]
                    first = np.flatnonzero(np.diff(bag[some], prepend=-1))
                    weights[bag[some[first]][:, None], drawn[f]] += np.add.reduceat(_draws(hashed[some], drawn[f]), first, axis=0, dtype=np.uint32)
            packed = [zlib.compress(w.tobytes(), 1) if some else b"" for w, some in zip(weights, np.logical_or.reduceat(fold >= 0, head), strict=True)]
            at = pa.array(head)
            yield pa.RecordBatch.from_arrays([batch["bits"].take(at), batch["y"].take(at), pa.array([a.tobytes() for a in asked], pa.binary()), pa.array(packed, pa.binary())], names=["bits", "y", "asked", "weights"])

    return run


class _Batch:
    """Bags with their weights in each tree."""

    def __init__(self, batch: pa.RecordBatch, runs: list[Run], features: int):
        self.y, self.x = batch["y"].to_numpy(), _unpacked(batch["bits"], features)
        self.folds = _folds(runs)
        self.asked = np.frombuffer(b"".join(batch["asked"].to_pylist()), np.uint8).reshape(len(self.y), len(self.folds))
        packed = batch["weights"].to_pylist()
        self.taught = np.flatnonzero([len(w) > 0 for w in packed])
        raw = b"".join(zlib.decompress(packed[i]) for i in self.taught.tolist())
        self.weights = np.frombuffer(raw, np.uint32).reshape(len(self.taught), sum(r.trees for r in runs))

    def of(self, run: Run, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(weights, flags of the bags to predict) in a tree."""
        weight = np.zeros(len(self.y), np.int64)
        weight[self.taught] = self.weights[:, tree]
        return weight, self.asked[:, self.folds.index(run.fold)] > 0


def _level(runs: list[Run], top: _Top, large: set[tuple[int, int]], features: int, classes: int):
    """Class counts by tree, node and feature (-1: of all rows) of the nodes that are to be split, and after those of the classes the number of bags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_tree: dict[int, list[int]] = {}
        for t, n in large:
            by_tree.setdefault(t, []).append(n)
        for batch in batches:
            own = _Batch(batch, runs, features)
            x, y = own.x, own.y
            for tree, (_, r) in enumerate(_listed_runs(runs)):
                weight, _ = own.of(r, tree)
                node = top.leaves(tree, x)
                some = np.flatnonzero((weight > 0) & np.isin(node, by_tree.get(tree, [])))
                if not len(some):
                    continue
                one_hot = np.zeros((len(some), classes + 1), np.int64)
                one_hot[np.arange(len(some)), y[some]] = weight[some]
                one_hot[:, classes] = 1
                order = np.argsort(node[some], kind="stable")
                some, one_hot = some[order], one_hot[order]
                head = np.flatnonzero(np.diff(node[some], prepend=-1))
                known = node[some[head]]
                every = np.concatenate([np.add.reduceat(one_hot, head, axis=0)[:, None, :], _counts(x[some], one_hot, head)], 1)
                i, f = np.nonzero(every.sum(2))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), tree, np.int32)), pa.array(known[i]), pa.array((f - 1).astype(np.int32)), *(pa.array(every[i, f, c]) for c in range(classes + 1))], names=["tree", "node", "feature", *(f"c{c}" for c in range(classes + 1))])

    return run


def _split(runs: list[Run], top: _Top, features: int, classes: int):
    """Of one node's counts, a row a feature: how it is split, the bags on either side, and the classes' shares."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, node = (k.as_py() for k in key)
        counts = np.zeros((features + 1, classes + 1), np.int64)
        counts[table["feature"].to_numpy() + 1] = np.stack([table[f"c{c}"].to_numpy() for c in range(classes + 1)], 1)
        counts, bags = counts[:, :classes], counts[:, classes]
        f = int(best_splits(counts[None, 1:], counts[None, 0], _listed_runs(runs)[tree][1], tree, np.array([top.name(tree, node)], np.uint64))[0])
        right = int(bags[f + 1]) if f >= 0 else 0
        return pa.table([pa.array([tree], pa.int32()), pa.array([node], pa.int64()), pa.array([f], pa.int32()), pa.array([int(bags[0]) - right]), pa.array([right]), pa.array([(counts[0] / counts[0].sum()).tolist()])], names=["tree", "node", "feature", "left", "right", "share"])

    return run


_PACKED = "part int, tree int, node long, bits binary, y binary, weight binary, asked binary"


def _parts(runs: list[Run]) -> list[int]:
    """Of each tree the part that is grown by one task: at most TOGETHER trees of a run."""
    out: list[int] = []
    for r in runs:
        first = out[-1] + 1 if out else 0
        out += [first + i // TOGETHER for i in range(r.trees)]
    return out


def _sent(runs: list[Run], top: _Top, features: int):
    """A row for each tree and node of a batch: what it learns from, and the bits it is asked for."""
    parts = _parts(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _Batch(batch, runs, features)
            packed = np.packbits(own.x, axis=1)
            out, size = [], 0
            for tree, (_, r) in enumerate(_listed_runs(runs)):
                weight, asked = own.of(r, tree)
                node = top.leaves(tree, own.x)
                live = np.flatnonzero(((weight > 0) | asked) & ~np.isin(node, list(top.leaf.get(tree, {}))))
                live = live[np.argsort(node[live], kind="stable")]
                for here in np.split(live, np.flatnonzero(np.diff(node[live])) + 1) if len(live) else ():
                    taught, wanted = here[weight[here] > 0], here[asked[here]]
                    out.append((parts[tree], tree, int(node[here[0]]), packed[taught].tobytes(), own.y[taught].astype(np.int32).tobytes(), weight[taught].astype(np.uint32).tobytes(), packed[wanted].tobytes()))
                    size += sum(map(len, out[-1][3:]))
                    if size > 1 << 20:
                        yield _rows(out)
                        out, size = [], 0
            if out:
                yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "tree", "node", "bits", "y", "weight", "asked"])


def _shares(which: int, bits: np.ndarray, share: np.ndarray) -> dict[str, pa.Array]:
    """bits: packed, by row."""
    each = [b.tobytes() for b in bits]
    return {"run": pa.array(np.full(len(each), which, np.int32)), "bits": pa.array(each, pa.binary())} | {f"c{c}": pa.array(share[:, c].astype(np.float64)) for c in range(share.shape[1])}


def _settled(runs: list[Run], top: _Top, features: int):
    """Shares of the bits that fall in large nodes which can't be split: their bags are never gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _Batch(batch, runs, features)
            packed = np.packbits(own.x, axis=1)
            for tree, (which, r) in enumerate(_listed_runs(runs)):
                if known := top.leaf.get(tree):
                    node = top.leaves(tree, own.x)
                    some = np.flatnonzero(own.of(r, tree)[1] & np.isin(node, list(known)))
                    if len(some):
                        yield pa.RecordBatch.from_pydict({"tree": pa.array(np.full(len(some), tree, np.int32))} | _shares(which, packed[some], np.array([known[n] for n in node[some].tolist()])))

    return run


def _different(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different rows of packed bits, which of them each row is)."""
    if bits.shape[1] <= 8:  # as numbers, which sort faster
        wide = np.zeros((len(bits), 8), np.uint8)
        wide[:, : bits.shape[1]] = bits
        _, first, at = np.unique(wide.view(np.uint64).reshape(-1), return_index=True, return_inverse=True)
        return bits[first], at
    same, at = np.unique(bits, axis=0, return_inverse=True)
    return same, at.reshape(-1)


def _grown(runs: list[Run], top: _Top, features: int, classes: int):
    """Of one node in the trees of a part: the summed shares of the bits that are asked for."""
    width = -(-features // 8)
    listed = _listed_runs(runs)
    full = lambda b: np.unpackbits(b, axis=1, count=features)

    def one(table: pa.Table, tree: int, node: int) -> tuple[np.ndarray, np.ndarray]:
        read = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        y, weight = read("y", np.int32), read("weight", np.uint32).astype(np.int64)
        # Bags of equal bits are one with the sum of their weights by class.
        same, at = _different(read("bits", np.uint8).reshape(len(y), width))
        asked, _ = _different(read("asked", np.uint8).reshape(-1, width)) if width else (np.empty((1, 0), np.uint8), None)
        one_hot = np.zeros((len(same), classes), np.int64)
        np.add.at(one_hot, (at, y), weight)
        if len(asked) and len(same):
            return asked, Subtree(full(same), one_hot, listed[tree][1], tree, top.name(tree, node)).predict(full(asked))
        return asked, np.zeros((len(asked), classes))  # nobody asks, or nothing is known here

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node, trees = key[1].as_py(), table["tree"].to_numpy()
        bits, share = np.empty((0, width), np.uint8), np.empty((0, classes))
        for tree in np.unique(trees).tolist():
            asked, own = one(table.filter(pa.array(trees == tree)), tree, node)
            if len(asked) == len(bits) and (asked == bits).all():  # as a rule: a run's trees are asked the same
                share = share + own
            else:
                bits, at = _different(np.concatenate([bits, asked]))
                both, share = np.concatenate([share, own]), np.zeros((len(bits), classes))
                np.add.at(share, at, both)
        return pa.table(_shares(listed[int(trees[0])][0], bits, share))

    return run


def predictions(rows: DataFrame, runs: list[Run], features: int, classes: int, small: int | None = None) -> DataFrame:
    """(run, fold, bits, prediction): the class of all different bits of the fold that a run is asked for, ties to the first. Rows: (row long, y int,
    fold int, bits binary), row unique, fold -1 for held-out rows. Nodes of more than small bags are split by jobs."""
    spark = rows.sparkSession
    trees = sum(r.trees for r in runs)
    names = [f"c{c}" for c in range(classes)]
    used = rows.select("row", "y", "fold", "bits")
    # In order, so equal rows are neighbours; ranges end within a bag of many rows, too.
    tasks = max(spark.sparkContext.defaultParallelism, used.count() // DRAWN + 1)
    order = ["bits", "y"]
    bags = used.repartitionByRange(tasks, *order, "row").sortWithinPartitions(*order).mapInArrow(_bagged(runs), _BAGS).persist(StorageLevel.MEMORY_AND_DISK)
    taught = bags.where("length(weights) > 0").count()
    small = max(small or max(1024, SMALL_CELLS // max(1, features)), taught * trees // MOST_NODES)
    top = _Top()
    large = {(t, 0) for t in range(trees)} if taught > small else set()
    while large:
        counted = [*names, f"c{classes}"]
        kind = "tree int, node long, feature int, " + ", ".join(f"{c} long" for c in counted)
        sums = bags.mapInArrow(_level(runs, top, large, features, classes), kind).groupBy("tree", "node", "feature").agg(*(F.sum(c).alias(c) for c in counted))
        found = sums.groupBy("tree", "node").applyInArrow(_split(runs, top, features, classes), "tree int, node long, feature int, left long, right long, share array<double>").collect()  # of large nodes, MOST_NODES at most
        large = set()
        for s in found:
            if s.feature >= 0:
                child = top.open(s.tree, s.node, s.feature)
                large |= {(s.tree, c) for c, n in ((child, s.left), (child + 1, s.right)) if n > small}
            else:
                top.leaf.setdefault(s.tree, {})[s.node] = s.share
    sent = bags.mapInArrow(_sent(runs, top, features), _PACKED)
    kind = "run int, bits binary, " + ", ".join(f"{c} double" for c in names)
    # Few large groups, so a task for each of them, and some more as hashes meet.
    parts = _parts(runs)[-1] + 1 if trees else 1
    share = sent.repartition(max(spark.sparkContext.defaultParallelism, min(4 * parts, 2000)), "part", "node").groupBy("part", "node").applyInArrow(_grown(runs, top, features, classes), kind)
    if top.leaf:
        share = share.unionByName(bags.mapInArrow(_settled(runs, top, features), "tree int, " + kind).dropDuplicates(["tree", "bits"]).drop("tree"))
    mean = share.groupBy("run", "bits").agg(*(F.sum(c).alias(c) for c in names))
    # The first class of the largest sum.
    first = F.array_min(F.array(*(F.struct(-F.round(c, 9), F.lit(i).alias("i")) for i, c in enumerate(names))))["i"]
    folds = F.broadcast(spark.createDataFrame([(i, r.fold) for i, r in enumerate(runs)], "run int, fold int"))
    return mean.select("run", "bits", first.alias("prediction")).join(folds, "run").select("run", "fold", "bits", "prediction")


def grow_and_predict(rows: DataFrame, runs: list[Run], features: int, classes: int, small: int | None = None) -> DataFrame:
    """(run, row, y, prediction): predictions() of each row. Without rows to learn from, the first class is told."""
    told = predictions(rows, runs, features, classes, small)
    return rows.select("row", "y", "fold", "bits").join(told, ["fold", "bits"]).select("run", "row", "y", "prediction")
