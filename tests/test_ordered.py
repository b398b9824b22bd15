"""Running flags, ordered concatenation and batched lookups, with a key that holds most of the rows."""

import random

import pytest
from larder.operators import analysis as A
from larder.operators import ordered as O
from larder.sources import products as P
from pyspark.sql import functions as F


def events(seed, n=3000):
    r = random.Random(seed)
    said = ["x", "x", "x", "contem", "pode conter", None, " ", "sal"]
    return [(None if r.random() < 0.02 else "hot" if r.random() < 0.7 else f"k{r.randrange(40)}", i, r.choices(said, [30, 30, 30, 1, 0.3, 1, 1, 5])[0], r.choice([-1.0, 0.0, 2.5, None])) for i in r.sample(range(10 * n), n)]


SCHEMA = "k string, pos long, folded string, conf double"


@pytest.mark.parametrize("ranges", [1, 7, 200])
def test_running_flags(spark, ranges):
    rows = events(1)
    given = spark.createDataFrame(rows, SCHEMA)
    flags = {"a": F.col("folded") == "contem", "b": F.col("folded") == "pode conter"}
    got = {r.pos: (r.a, r.b) for r in O.running_any(given, "k", "pos", flags, ranges).collect()}
    seen, want = {}, {}
    for k, pos, text, _ in sorted(rows, key=lambda r: r[1]):
        a, b = seen.get(k, (False, False))
        seen[k] = want[pos] = (a or text == "contem", b or text == "pode conter")
    assert got == want
    told = {r.pos: r.declaration for r in A.declared(given, "k").collect()}
    assert told == {p: "tracos" if b else "contem" if a else "ingrediente" for p, (a, b) in want.items()}
    assert A.declared(given.limit(0), "k").count() == 0


def test_a_hot_key_is_spread(spark):
    hot = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("pos"), F.lit("x").alias("folded"))
    most = O.cut(hot, "pos", "r", 50).groupBy("k", "r").count().agg(F.max("count")).first()[0]
    assert most < 1000
    same = O.cut(hot.withColumn("pos", F.lit(3)), "pos", "r", 50)
    assert same.select("r").distinct().count() == 1


def test_words_in_order(spark):
    rows = events(2)
    given = spark.createDataFrame(rows, SCHEMA)
    got = {r.k: (r.raw_text, round(r.mean_confidence, 9)) for r in P.words_of_rows(given, "k", "pos", F.col("folded"), F.col("conf")).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        own = [(p, t.strip(), c) for kk, p, t, c in rows if kk == k and t is not None and t.strip() and c is not None and c >= 0]
        want[k] = (" ".join(t for _, t, _ in sorted(own)), round(sum(c for *_, c in own) / len(own), 9) if own else 0.0)
    assert got == want


def test_batched_lookup(spark, tmp_path):
    log = tmp_path / "asked"

    def fetch(codes):
        with log.open("a") as f:
            f.write(f"{len(codes)} {'bad' in codes}\n")
        if "bad" in codes:
            raise ConnectionError("no")
        return {c: f"body of {c}" for c in codes if c != "absent"}

    codes = spark.createDataFrame([(f"c{i}",) for i in range(40)] * 2 + [("bad",), ("absent",), (None,)], "code string").repartition(1)
    got = {r.code: (r.body, r.error) for r in P.lookup_batches(codes, fetch, size=16, tries=2, wait=0.0).coalesce(1).collect()}
    assert len(got) == 42 and got["bad"][0] is None and "no" in got["bad"][1] and got["absent"] == (None, None)
    assert all(got[f"c{i}"] == (f"body of c{i}", None) for i in range(40))
    asked = [line.split() for line in log.read_text().splitlines()]
    # Batches without the bad code are asked once, those with it twice, down to the code itself.
    assert sum(x[1] == "True" for x in asked) <= 2 * 6 and len(asked) < 30 and max(int(x[0]) for x in asked) <= 16
