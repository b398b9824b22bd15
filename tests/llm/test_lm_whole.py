"""The language model holds every n-gram of the training texts, whatever their number."""

import collections
import math

import numpy as np
import pytest
from larder.llm import bloom_lm
from pyspark.sql import functions as F


def test_rare_ngrams_are_held(spark, monkeypatch):
    monkeypatch.setattr(bloom_lm, "RESOLUTION", 64, raising=False)  # a corpus of many times that bound; nothing must depend on it
    r = np.random.default_rng(3)
    texts = {i: " ".join(f"w{x}" for x in r.zipf(1.6, 60) % 200) for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {x.doc_id: x for x in bloom_lm.score(docs, F.col("doc_id") % 10 == 0).collect()}
    words = {i: [None, *t.split(), None] for i, t in texts.items()}
    one = collections.Counter(w for i, t in words.items() if i % 10 for w in t[1:])
    two = collections.Counter(p for i, t in words.items() if i % 10 for p in zip(t, t[1:], strict=False))
    total, distinct = sum(one.values()), len(one)
    many = lambda n: float(bloom_lm.expected(bloom_lm.levels(np.array([n]), 1), 1)[0])
    near = 0
    for i, t in words.items():
        want = 0.0
        for a, b in zip(t, t[1:], strict=False):
            low = (many(one[b]) + 0.1) / (total + 0.1 * (distinct + 1))
            want += math.log10(min(1.0, (min(many(two[a, b]), many(one[a])) + 20 * low) / (many(one[a]) + 20)))
        assert got[i].score == pytest.approx(want, rel=0.05)
        near += got[i].score == pytest.approx(want, rel=0.005)
    assert near > 0.6 * len(words) and min(one.values()) == min(two.values()) == 1
