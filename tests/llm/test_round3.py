"""Nearest neighbours, collocations and fill-in-the-middle against brute force, and their odd inputs."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from larder.llm import collision_search as N
from larder.llm import collocations as P
from larder.llm import fill_middle as M
from larder.llm import queries
from pyspark.sql import functions as F

SOME = settings(max_examples=80, deadline=None)


# 11


def brute(rows, is_query, k):
    """Of (id, vector): {query row: [(score, id)]}, ids of the query left out."""
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    out = {}
    for i in np.flatnonzero(is_query(ids)):
        score = (v * v[i]).sum(1)
        some = np.flatnonzero(ids != ids[i])
        out[int(ids[i])] = [(score[j], int(ids[j])) for j in some[np.lexsort((ids[some], -score[some]))][:k]]
    return out


def found(spark, rows, kind="float", k=5, **how):
    given = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got = collections.defaultdict(list)
    for r in N.nearest(given, lambda i: i % 20 == 0, k=k, **how).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.score, r.vec_id))
    return got


def recall(got, want):
    return sum(len({i for _, i in got[q]} & {i for _, i in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_the_tables(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    want = brute(list(zip(table.vec_id.tolist(), table.embedding, strict=True)), lambda i: i % 20 == 0, 20)
    got = collections.defaultdict(list)
    for r in queries.QUERIES["op11_nearest"](spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values()) and recall(got, want) >= 0.95
    exact = {i: np.array(x, np.float32) for i, x in zip(table.vec_id, table.embedding, strict=True)}
    for q, x in got.items():
        assert x == sorted(x, key=lambda y: (-y[0], y[1])) and all(s == (exact[q].astype(float) * exact[i].astype(float)).sum() for s, i in x)


@pytest.mark.parametrize("spread", [0.0, 0.6])
def test_shards_norms_and_groups(spark, monkeypatch, spread):
    """Several shards and blocks, a sample smaller than the table, unequal norms, one group of a third of all rows."""
    monkeypatch.setattr(N, "SMALL", 300)
    monkeypatch.setattr(N, "BLOCK", 200)
    r = np.random.default_rng(4)
    v = r.standard_normal((1500, 24)) * np.exp(spread * r.standard_normal((1500, 1)))
    v[500:1000] = v[500] + 0.01 * r.standard_normal((500, 24))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got, want = found(spark, rows, "double", 7, sample=150), brute(rows, lambda i: i % 20 == 0, 7)
    assert got.keys() == want.keys() and all(len(x) == 7 for x in got.values()) and recall(got, want) >= 0.93


def test_windows_counted_alike():
    r = np.random.default_rng(2)
    v = r.standard_normal((700, 8))
    block = N.Block(np.arange(700), v, float(np.linalg.norm(v, axis=1).max()))
    shadows = r.standard_normal((5, N.PROJECTIONS)).astype(np.float32)
    for half in (0.01, 0.3, 1.0, 9.0):
        lo, width = block.windows(shadows, np.full(5, half))
        for j in range(5):
            inside = np.abs(np.take_along_axis(block.sorted, block.rank.astype(np.int64), 1) - shadows[j][:, None]) <= half
            for wide in (0.0, 2.0):
                N.WIDE = wide
                assert (block.colliding(lo[j], width[j]) == (inside.sum(0) >= N.THRESHOLD)).all()
    N.WIDE = 1 / 16


def test_vectors_that_take_no_part(spark):
    r = random.Random(3)
    good = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(1, 61)]
    odd = [(100, None), (120, []), (140, [0.0] * 4), (160, [1.0, None, 0.0, 0.0]), (180, [math.nan] * 4), (200, [math.inf, 0.0, 0.0, 0.0]), (220, [1.0] * 3), (None, [1.0] * 4)]
    got, want = found(spark, good + odd, "double", 100), brute(good, lambda i: i % 20 == 0, 100)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()} and len(want) == 3
    # Repeated rows are candidates each, one query; ties go to the smaller id.
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (2, [2.0, 0.0])]
    assert found(spark, rows) == {20: [(2.0, 2), (2.0, 3), (2.0, 3)]}
    assert found(spark, [(1, [1.0])]) == {} and found(spark, [(20, [1.0])]) == {} and found(spark, [(7, None)]) == {}
    clash = spark.createDataFrame([(20, [1.0], 1, 2, "x"), (1, [0.5], 1, 2, "x")], "vec_id long, embedding array<float>, shard int, id int, vec string")
    assert [tuple(x) for x in N.nearest(clash, lambda i: i % 20 == 0).collect()] == [(20, 1, 1, 0.5)]
    tiny = found(spark, [(20, [1e-200, 0.0]), (1, [1e-200, 1e-200]), (2, [1e140, 1.0]), (3, [1e300, 0.0])], "double")
    assert [i for _, i in tiny[20]] == [2, 1]  # the product with the first is zero in double precision


# 12

WORDS = ["a", "b", "c", "B", "é", "dd"]


def brute_phrases(rows, least, percent, top):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for lang in n:
        own = []
        for (g, p), a in cands.items():
            if g != lang or any(h == g and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= percent * a for (h, q), b in cands.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
            own.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def texts_of(seed, n=900):
    r = random.Random(seed)
    join = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \r\n", "\x00"]
    return [("".join(r.choice(WORDS) + r.choice(join) for _ in range(r.randrange(30))) if r.random() > 0.05 else r.choice([None, "", " ", ".;"]), r.choice(["en", "fr", None])) for _ in range(n)] + [("a b c dd . " * 200, "en")]


@pytest.mark.parametrize("bits, top", [(6, 2000), (16, 5)])
def test_collocations(spark, bits, top):
    """With a full sketch, which lets everything pass, and with an empty one."""
    rows = texts_of(bits)
    given = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, n int, phrase string").repartition(5)
    got = sorted(map(tuple, P.collocations(given, least=20, top=top, bits=bits).collect()))
    assert got == brute_phrases(rows, 20, 80, top) and len(got) > (10 if top > 5 else 9)


def test_collocations_without_rows(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert P.collocations(none).count() == 0
    assert P.collocations(spark.createDataFrame([(None, None), ("", "en"), ("rare words", "en")], "text string, lang string")).count() == 0
    long_ = spark.createDataFrame([("x" * 200_000 + " y " + "w v " * 60_000, None)], "text string, lang string")
    assert [tuple(r) for r in P.collocations(long_).where("phrase = 'w v'").collect()] == []  # inside 'w v w', 'v w v w'
    assert P.collocations(long_, max_words=2).where("phrase = 'w v'").first()[:4] == ("und", 1, "w v", 60_000)


def test_sketch_never_underestimates():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 5000).astype(np.uint64)
    h = np.repeat(h, r.integers(1, 60, 5000))
    sketch = np.zeros((P.SKETCHES, 1 << 12), np.uint8)
    for part in np.array_split(r.permutation(h), 7):
        P.add_to(sketch, part, 12, 30)
    packed = np.packbits(sketch.reshape(-1) >= 30)
    some, n = np.unique(h, return_counts=True)
    assert P.passes(packed, some[n >= 30], 12).all()


def test_halves_of_hashes():
    h, g = np.array([5, 5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1, 2], np.uint64)
    at, n = P.distinct(h, g)
    assert sorted(zip(h[at].tolist(), g[at].tolist(), n.tolist(), strict=True)) == [(5, 1, 2), (5, 2, 2), (7, 1, 1)]


def test_exact_beyond_64_bits(spark):
    a = 4 * 10**18
    counts = spark.createDataFrame([("en", 2, "x y", a), ("en", 1, "x", a), ("en", 1, "y", a + 1)], "lang string, k int, phrase string, n long")
    assert P.score(counts).first()["score"] == 2_000_000 * a // (2 * a + 1)


# 13


def plain_fim(text, key):
    h = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    one, two, plain, order = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not n or any(m in text for m in M.SENTINELS) or plain % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((one % (n + 1), two % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if order % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@SOME
@given(st.text(alphabet="a b<>PSMé😀\n\x00한", max_size=40), st.integers(0, 10**6))
def test_fill_in_middle(text, key):
    got = M.transform(text, str(key))
    assert got == plain_fim(text, key) and M.restore(got[4], got[1]) == text
    for unit in M.UNITS:
        n, form, p, m, out = M.transform(text, str(key), 3, unit, 100)
        edges = M.boundaries(np.frombuffer(text.encode("utf-32-le"), np.uint32), unit).tolist()
        assert M.restore(out, form) == text and (form == "plain" or {p, p + m} <= set(edges)) and n == len(edges) - 1


def test_units():
    points = np.frombuffer("ab  c1, d!\n\nx".encode("utf-32-le"), np.uint32)
    cut = lambda unit: ["ab  c1, d!\n\nx"[a:b] for e in [M.boundaries(points, unit).tolist()] for a, b in zip(e, e[1:], strict=False)]
    assert cut("words") == ["ab", "  ", "c1", ",", " ", "d", "!", "\n\n", "x"] and cut("lines") == ["ab  c1, d!\n", "\n", "x"]


def test_fill_in_middle_rows(spark):
    long_ = "é😀x " * 120_000
    rows = [(1, "plain text here"), (1, "plain text here"), (2, None), (3, ""), (None, "no id"), (4, "has <S> in it"), (5, long_), (6, "x" * 300_000)]
    given = spark.createDataFrame([(i, t, 7, "form", "o", "k") for i, t in rows], "doc_id long, text string, n int, form string, output string, _key string").repartition(3)
    made = M.fill_in_middle(given)
    assert set(made.columns) == {"doc_id", "text", "_key", "n", "form", "prefix_chars", "middle_chars", "output"}
    back = M.restored(made).collect()
    assert sorted((r.doc_id or 0, r.restored) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    for r in back:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.text or "", "" if r.doc_id is None else r.doc_id) and r._key == "k"
    assert M.fill_in_middle(given.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.fill_in_middle(given, marks=("<P>", "<S>", "><"))
    assert pa.array([1]).type == pa.int64()


@pytest.mark.parametrize("name", ["op12_collocations", "op13_fill_in_middle"])
def test_sql_of_the_new(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


def test_nothing_is_sampled(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries.QUERIES["op13_fill_in_middle"](spark, sf).count() == n
    ids = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert queries.QUERIES["op11_nearest"](spark, sf).select(F.col("query_id")).distinct().count() == ids
