"""Recall of near duplicates by similarity, on planted edits whose similarity a plain alignment tells."""

import collections
import random

from larder.llm import common, near_dedup
from pyspark.sql import functions as F

FIRST = 10**9  # ids of planted rows


def labelled(text):
    words, seen, out = text.split(), collections.Counter(), []
    for i in range(len(words) - 4):
        s = tuple(words[i : i + 5])
        seen[s] += 1
        out.append((s, seen[s]))
    return out


def similarity(a, b):
    """Longest common subsequence by the plain table, over the shingles of both."""
    row = [0] * (len(b) + 1)
    for x in a:
        left, new = 0, [0]
        for j, y in enumerate(b):
            left = row[j] + 1 if x == y else max(left, row[j + 1])
            new.append(left)
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def edited(words, edits, r):
    words = list(words)
    for i in range(edits):
        at = r.randrange(len(words))
        kind = r.randrange(3)
        words[at : at + (kind != 1)] = [] if kind == 0 else [f"edit{r.random()}"]
    return " ".join(words)


def test_recall_by_similarity(spark, sf):
    """Each planted copy is one edit set of a text of the table, alone with it; recall at 0.8 and more must be whole."""
    r = random.Random(11)
    docs = common.documents(spark, sf).select("doc_id", "text")
    base = [x for x in docs.orderBy("doc_id").collect() if x.text and 60 <= len(x.text.split()) <= 300]
    planted, said = [], {}
    for n, x in enumerate(base * (1 + 600 // max(1, len(base)))):
        words = x.text.split()
        own = [w + f"~{n}" if i % 4 == 0 else w for i, w in enumerate(words)]  # no other pair shares shingles
        text, near = " ".join(own), edited(own, r.randrange(1, 2 + len(own) // 25), r)
        said[n] = similarity(labelled(text), labelled(near))
        planted += [(FIRST + 2 * n, text), (FIRST + 2 * n + 1, near)]
    rows = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    of = {x.doc_id: x.class_id for x in near_dedup.near_classes(rows).where(F.col("doc_id") >= FIRST).collect()}
    caught = collections.defaultdict(list)
    for n, s in said.items():
        caught[min(int(s * 20), 19)].append(of[FIRST + 2 * n] == of[FIRST + 2 * n + 1])
    print({f"{b / 20:.2f}": (len(c), sum(c) / len(c)) for b, c in sorted(caught.items())})
    assert sum(len(c) for b, c in caught.items() if b >= 16) > 100
    assert all(of[FIRST + 2 * n] == of[FIRST + 2 * n + 1] for n, s in said.items() if s >= 0.8)
    assert not any(of[FIRST + 2 * n] == of[FIRST + 2 * n + 1] for n, s in said.items() if s < 0.8)
