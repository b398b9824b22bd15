"""Trees against plain recursive ones: unlimited depth, ties, forests, and nodes split by jobs or within a task alike."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from larder.operators import bayes as B
from larder.operators import trees as T


def loss(labels, kind):
    n = len(labels)
    shares = [c / n for c in Counter(labels).values()]
    return 1 - sum(p * p for p in shares) if kind == "gini" else -sum(p * math.log2(p) for p in shares)


def plain_tree(rows, kind, features):
    """rows: (set of features, label). Gives a function of a set."""
    labels = [y for _, y in rows]
    best = None
    for f in range(features):
        left, right = [y for x, y in rows if f not in x], [y for x, y in rows if f in x]
        if left and right and len(set(labels)) > 1:
            gain = round(loss(labels, kind) - (len(left) * loss(left, kind) + len(right) * loss(right, kind)) / len(rows), 12)
            if best is None or gain > best[0]:
                best = gain, f
    if best is None:
        most = max(Counter(labels).items(), key=lambda c: (c[1], -c[0]))[0]
        return lambda x: most
    f = best[1]
    sides = [plain_tree([r for r in rows if (f in r[0]) == side], kind, features) for side in (False, True)]
    return lambda x: sides[f in x](x)


def bags(seed, n, features, classes=3):
    r = random.Random(seed)
    sets = [frozenset(f for f in range(features) if r.random() < 0.4) for _ in range(n)]
    return [(x, (len(x) + (0 in x) if r.random() < 0.8 else r.randrange(classes)) % classes, r.randrange(-1, 3)) for x in sets]


def table(spark, rows, features):
    def bits(x):
        flags = np.zeros(-(-features // 8) * 8, np.uint8)
        flags[list(x)] = 1
        return bytearray(np.packbits(flags).tobytes())

    return spark.createDataFrame([(i, y, f, bits(x)) for i, (x, y, f) in enumerate(rows)], "row long, y int, fold int, bits binary").repartition(3)


@pytest.mark.parametrize("small", [4, 60, 10_000])
def test_equal_to_a_plain_tree(spark, small, monkeypatch):
    monkeypatch.setattr(T, "MOST_NODES", 1 << 40)
    rows = bags(3, 240, 11)
    rows += [(frozenset([1]), 0, f) for f in (-1, 0, 1, 2) for _ in range(30)]  # one bag of many rows
    runs = [T.Run("tree", f, 1, kind) for f in (0, 1, 2, -1) for kind in ("entropy", "gini")]
    got = {(r.run, r.row): (r.y, r.prediction) for r in T.grow_and_predict(table(spark, rows, 11), runs, 11, 3, small).collect()}
    for i, run in enumerate(runs):
        tree = plain_tree([(x, y) for x, y, f in rows if f >= 0 and f != run.fold], run.impurity, 11)
        asked = {k: x for k, (x, _, f) in enumerate(rows) if f == run.fold}
        assert {k: got[i, k] for k in asked} == {k: (rows[k][1], tree(x)) for k, x in asked.items()}
    assert len(got) == 2 * len(rows)


def test_deeper_than_any_limit():
    """A chain: every feature tells one row from the rest, so the tree is as deep as there are features."""
    n = 90
    x = np.tril(np.ones((n, n), np.int64), -1)
    weight = np.zeros((n, 2), np.int64)
    weight[np.arange(n), np.arange(n) % 2] = 1
    tree = T.Subtree(x, weight, T.Run("tree", -1), 0, 0)
    assert (tree.predict(x).argmax(1) == np.arange(n) % 2).all() and len(tree.feature) > n


def test_forests(spark):
    r = random.Random(8)
    rows = [(x, int(0 in x) + int(1 in x) if r.random() < 0.85 else r.randrange(3), f) for x, _, f in bags(5, 600, 16)]
    runs = [T.Run("forest", 0, 25, "gini", True), T.Run("tree", 0)]
    given = table(spark, rows, 16)
    key = lambda small: sorted(map(tuple, T.grow_and_predict(given, runs, 16, 3, small).collect()))
    got = key(10_000)
    assert got == key(10_000)
    right = {i: np.mean([y == p for r, _, y, p in got if r == i]) for i in (0, 1)}
    assert right[0] > 0.7 and right[0] >= right[1] - 0.05
    # The weights of a bootstrap are Poisson(1), one draw for each row and tree.
    w = np.concatenate([T.bootstrap(np.arange(10_000), t) for t in range(5)])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and (T.bootstrap(np.arange(50), 1) != T.bootstrap(np.arange(50), 2)).any()


def test_odd_inputs(spark):
    none = table(spark, bags(1, 5, 4), 4).limit(0)
    assert T.grow_and_predict(none, [T.Run("tree", -1)], 4, 2).count() == 0
    one = table(spark, [(frozenset(), 0, 0), (frozenset([1]), 0, -1)], 4)
    assert [tuple(r) for r in T.grow_and_predict(one, [T.Run("tree", -1)], 4, 1).collect()] == [(0, 1, 0, 0)]
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "id int, label string")
    tags = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(40)] + [(1, "x"), (99, "x")], "id int, tag string")
    told = B.holdout(docs, tags, "id", "label", B.document_frequency(tags, "id", "tag"), "decision_tree").toPandas()
    assert len(told) == 10 and (told.label == told.prediction).all()
    assert B.holdout(docs.limit(0), tags, "id", "label", B.document_frequency(tags, "id", "tag")).count() == 0


def test_comparison_against_plain_models(spark, sf):
    """The decision tree's accuracies of the registered comparison are those of plain trees on the same folds."""
    from larder.plans import catalog

    docs, tags, vocabulary = catalog._bags(spark, sf)
    split = B.stratified_split(docs, "o_orderkey", "label")
    fold = {r.o_orderkey: r.fold for r in B.stratified_folds(split.where("NOT is_test").drop("is_test"), "o_orderkey", "label").collect()}
    label = {r.o_orderkey: r.label for r in docs.collect()}
    words = sorted(r.tag for r in vocabulary.collect())
    own = {k: set() for k in label}
    for r in tags.collect():
        if r.tag in words:
            own[r.o_orderkey].add(words.index(r.tag))
    classes = sorted(set(label.values()))
    rows = {k: (frozenset(own[k]), classes.index(y)) for k, y in label.items()}
    want = []
    for f in (*range(5), -1):
        tree = plain_tree([rows[k] for k, g in fold.items() if g != f], "entropy", len(words))
        asked = [k for k in label if fold.get(k, -1) == f]
        want.append(np.mean([tree(rows[k][0]) == rows[k][1] for k in asked]))
    got = B.compare_models(docs, tags, "o_orderkey", "label", vocabulary, ["decision_tree"]).first()
    assert abs(got.cv_accuracy - np.mean(want[:5])) < 1e-9 and abs(got.cv_std - np.std(want[:5])) < 1e-9 and abs(got.accuracy - want[5]) < 1e-9


def test_all_draws_at_once():
    rows = np.concatenate([np.arange(40_000), np.array([-1, 2**63 - 1, -(2**63)])])
    got = T.bootstraps(rows, np.arange(7))
    assert all((got[:, t] == T.bootstrap(rows, t)).all() for t in range(7))


def test_forests_wherever_nodes_are_grown(spark, monkeypatch):
    """Nodes split by jobs and within a task give the same forest; rows of equal bags never add up to a large node."""
    monkeypatch.setattr(T, "MOST_NODES", 1 << 40)
    rows = [(x, y, f) for x, y, f in bags(6, 150, 9)] * 4
    runs = [T.Run("forest", f, 6, "gini", True) for f in (0, -1)]
    given = table(spark, rows, 9)
    key = lambda small: sorted(map(tuple, T.grow_and_predict(given, runs, 9, 3, small).collect()))
    assert key(12) == key(None)
    levels = []
    monkeypatch.setattr(T, "_level", lambda *a: levels.append(a) or pytest.fail("a level was split by a job"))
    few = [(frozenset([i % 3]), i % 2, -1 if i % 4 == 0 else 0) for i in range(400)]
    assert len(T.grow_and_predict(table(spark, few, 3), [T.Run("forest", -1, 3, "gini", True)], 3, 2, 20).collect()) == 100 and not levels
