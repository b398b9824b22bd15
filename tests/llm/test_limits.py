"""Counter-examples of former limits, and operators against plain versions that share no code with them."""

import collections
import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from larder.llm import bloom_lm, common, decontaminate, line_dedup, near_dedup, quality_rules, substring_dedup, toxicity


def words_of(*texts):
    (_, _, data, offs), *_ = common.slices(pa.array(list(texts)), 1 << 40)
    return common.Words(data, offs)


def test_structured_words_differ():
    """A sequence and its complement of the Thue-Morse word cancel out in polynomials modulo a power of two."""
    text, swap = "a", str.maketrans("ab", "ba")
    for _ in range(12):
        text += text.translate(swap)
        other = text.translate(swap)
        w = words_of(f"{text} {other} {text}")
        for lane in (0, 1):
            assert w.lane(lane)[0] == w.lane(lane)[2] != w.lane(lane)[1]
        w = words_of(" ".join(text), " ".join(other))
        spans = common.span_hash(w.hash, w.first[:-1], w.first[1:])
        assert spans[0] != spans[1]


def test_spans_name_their_content():
    r = np.random.default_rng(0)
    values = r.integers(0, 3, 400).astype(np.uint64)
    start = r.integers(0, 360, 3000)
    end = start + r.integers(1, 40, 3000)
    named = collections.defaultdict(set)
    for a, b, h in zip(start, end, common.span_hash(values, start, end), strict=True):
        named[tuple(values[a:b])].add(int(h))
    assert all(len(x) == 1 for x in named.values()) and len({min(x) for x in named.values()}) == len(named)


def test_long_windows(spark):
    """Owned runs of more than 255 windows are cut, not spilled into other bits."""
    n, r = 620, np.random.default_rng(3)
    base = [f"w{i}" for i in r.permutation(1500)]
    docs = [(0, " ".join(base)), (1, " ".join(["x", *base[100:1300], "y"])), (2, " ".join(base[:700])), (3, " ".join(base[:n]))]
    found, name = substring_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string"), n=n)
    seen, want = set(), collections.defaultdict(set)
    for i, t in docs:
        w = t.split()
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            if key in seen:
                want[i] |= set(range(s, s + n))
            seen.add(key)
    for row in found.collect():
        assert {p for x in row[name] or [] for p in range(x >> 32, (x >> 32) + (x & 0xFFFFFFFF) + n - 1)} == want[row.doc_id]


# Near duplicates with shingles and alignment of their own.


def plain_similarity(a: str, b: str) -> float:
    def labelled(text):
        w, seen, out = text.split(), collections.Counter(), []
        for i in range(max(1, len(w) - 4) if w else 0):
            s = tuple(w[i : i + 5])
            out.append((s, seen[s]))
            seen[s] += 1
        return out

    x, y = labelled(a), labelled(b)
    if not x or not y:
        return float(a == b)
    row = [0] * (len(y) + 1)
    for p in x:
        last = row[:]
        for j, q in enumerate(y):
            row[j + 1] = last[j] + 1 if p == q else max(last[j + 1], row[j])
    return row[-1] / (len(x) + len(y) - row[-1])


def plain_classes(docs):
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, t) in enumerate(docs):
        for j, u in docs[:k]:
            if root(i) != root(j) and plain_similarity(t, u) >= 0.8 - 1e-9:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in docs}


def family(r, size, most):
    """Copies of one text with more or fewer words changed, as in a large group of near copies."""
    words = [f"w{i}" for i in range(900)]
    base = list(r.choice(words, 60))
    out = []
    for _ in range(size):
        own = list(base)
        for at in r.integers(0, len(own), r.integers(0, most)):
            own[at] = r.choice(words)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [4096, 6])
def test_family(spark, monkeypatch, block):
    """Wide buckets of several components, whole and in blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = np.random.default_rng(block)
    docs = list(enumerate([*family(r, 70, 7), *family(r, 20, 3), "one two", "one two", "", "  ", "three"]))
    got = {x.doc_id: x.class_id for x in near_dedup.near_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert got == {k: (v if docs[k][1].split() else min(i for i, t in docs if t == docs[k][1])) for k, v in plain_classes(docs).items()}


def test_joining_is_whole():
    r = np.random.default_rng(8)
    texts = family(r, 80, 8)
    (_, _, data, offs), *_ = common.slices(pa.array(texts), 1 << 30)
    _, labelled, first = near_dedup.shingles(data, offs)
    own = [labelled[first[i] : first[i + 1]] for i in range(len(texts))]
    n = np.array([len(x) for x in own])
    links = near_dedup.joining(np.full(len(n), 2), np.arange(len(n)), np.arange(len(n)), n, own, 0.8)
    parent = list(range(len(n)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        assert plain_similarity(texts[a], texts[b]) >= 0.8 - 1e-9 and root(a) != root(b)
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: root(i) for i in range(len(n))} == plain_classes(list(enumerate(texts)))


def test_decontaminate_in_blocks(spark):
    """A benchmark of several blocks gives what one block gives."""
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(f"i{i}", " ".join(r.choices(vocabulary, k=r.randrange(1, 14)))) for i in range(40)]
    docs = [(i, " ".join(r.choices(vocabulary, k=20) + r.choice(items)[1].split() + r.choices(vocabulary, k=5))) for i in range(60)]
    bench, texts = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3)

    def found(**how):
        out, (spans, hit, _) = decontaminate.find_spans(texts, bench, **how)
        return {x.doc_id: (list(x[spans]), sorted(x[hit])) for x in out.collect()}

    whole = found()
    assert found(block_windows=200) == whole
    for i, t in docs:
        w = t.split()
        want = {k for k, u in items if any(w[j : j + min(10, len(u.split()))] == u.split()[s : s + min(10, len(u.split()))] for s in range(max(1, len(u.split()) - 9)) for j in range(len(w)))}
        assert set(whole[i][1]) == want


def test_em_mostly_bad():
    """The share of good documents has no floor."""
    r = np.random.default_rng(2)
    good = r.random(20_000) < 0.2
    votes = np.ones((20_000, 6), int)
    for j, accuracy in enumerate((0.95, 0.9, 0.8, 0.85, 0.7, 0.6)):
        says, right = r.random(20_000) < 0.8, r.random(20_000) < accuracy
        votes[says, j] = np.where(good == right, 2, 0)[says]
    count = collections.Counter("".join(map(str, v)) for v in votes)
    share, _, post = quality_rules.fit(list(count), np.array(list(count.values()), float))
    by = dict(zip(count, post, strict=True))
    assert share == pytest.approx(0.2, abs=0.02)
    assert np.mean([(by["".join(map(str, v))] >= 0.5) == g for v, g in zip(votes, good, strict=True)]) > 0.93


def test_scores_by_hand(spark, sf):
    """The interpolated bigram model of quantised counts, in plain Python; the filter's false positives move few documents."""
    texts = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    got = bloom_lm.op7_lm_score(spark, sf).toPandas().set_index("doc_id")
    tokens = {i: [*(w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())), None] for i, t in texts.items()}
    one, two = collections.Counter(), collections.Counter()
    for i, w in tokens.items():
        if not got.held_out[i]:
            one.update(w)
            two.update(zip([None, *w], w, strict=False))
    total, distinct = sum(one.values()), len(one)

    def kept(n):
        if not n:
            return 0.0
        low = 1.5 ** math.floor(math.log(n) / math.log(1.5) + 1e-9)
        return max(low, low * 1.25 - 0.5)

    near = []
    for i, w in tokens.items():
        s = 0.0
        for a, b in zip([None, *w], w, strict=False):
            before, low = kept(one[a]), (kept(one[b]) + 0.1) / (total + 0.1 * (distinct + 1))
            s += math.log10(min(1.0, (min(kept(two[a, b]), before) + 20.0 * low) / (before + 20.0)))
        near.append(abs(s - got.score[i]) <= 0.02 * abs(s))
    assert np.mean(near) > 0.95


def test_forward_by_hand():
    """The network's logit of a window, step by step."""
    net, h = toxicity.Network(3), toxicity.HIDDEN
    text = "Some words, one of them rather long: " + "extraordinarily " * 3 + "x"
    (_, _, data, offs), *_ = common.slices(pa.array([text]))
    x = toxicity.Inputs(data, offs)
    vec = [net.p["words"][x.word_row[i]] + np.mean([net.p["grams"][g] for g in x.gram_row[x.gram_first[i] : x.gram_first[i + 1]]], 0) for i in range(x.n_words)]
    window = [vec[i] for i in x.windows[0] if i >= 0]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def states(d, seq):
        out, s = [], np.zeros(h)
        for v in seq:
            g, a = v @ net.p["w" + d] + net.p["b" + d], s @ net.p["u" + d]
            z, r = sigmoid(g[:h] + a[:h]), sigmoid(g[h : 2 * h] + a[h : 2 * h])
            s = (1 - z) * np.tanh(g[2 * h :] + r * a[2 * h :]) + z * s
            out.append(s)
        return out

    both = [np.concatenate(p) for p in zip(states("f", window), states("b", window[::-1])[::-1], strict=True)]
    ask = np.array([np.tanh(b @ net.p["att"]) @ net.p["ask"] for b in both])
    share = np.exp(ask - ask.max())
    want = (share / share.sum()) @ np.array(both) @ net.p["out"] + net.p["bias"][0]
    assert net.score(x)[0] == pytest.approx(want, abs=1e-4)


def test_line_stream():
    """Settled and waiting rows of all partitions together against counts by key, whatever the cuts and batches."""

    def plain(rows, least, first):
        seen = collections.defaultdict(set)
        for a, b, d, t, _ in rows:
            seen[a, b].add((d, t))
        return {(k, *x) for k, v in seen.items() if len(v) >= least for x in sorted(v)[first:]}

    for seed in range(150):
        r = random.Random(seed)
        some = {x[:4]: x for x in ((r.randint(0, 4), r.randint(0, 1), r.randint(0, 12), r.randint(0, 1), [r.randint(0, 3)]) for _ in range(r.randint(1, 90)))}
        rows = sorted([*some.values(), *r.choices(list(some.values()), k=5)])
        least, first = r.choice([1, 2, 3, 5]), r.random() < 0.5
        cuts = sorted(c for c in r.sample(range(1, len(rows)), min(3, len(rows) - 1)) if rows[c - 1][:4] != rows[c][:4])
        out = []
        for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            batches, at = [], lo
            while at < hi:
                end = min(hi, at + r.randint(1, 6))
                c = list(zip(*rows[at:end], strict=True))
                batches.append(pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.list_(pa.int32()))], names=["h1", "h2", "doc", "th", "lines"]))
                at = end
            out += [x for b in line_dedup._stream(least, first)(iter(batches)) for x in b.to_pylist()]
        key = lambda x: ((x["h1"], x["h2"]), x["doc"], x["th"])
        total, early = collections.Counter(), {}
        for x in out:
            if x["kind"] == 2:
                total[key(x)[0]] += x["n"]
            elif x["kind"] == 1:
                early[key(x)[0]] = min(early.get(key(x)[0], key(x)), key(x))
        gone = {key(x) for x in out if x["kind"] == 0 or x["kind"] == 1 and total[key(x)[0]] >= least and not (first and early[key(x)[0]] == key(x))}
        assert gone == plain(rows, least, first)


def test_collocations_rare_phrases_stay_out_of_full_cells(spark):
    """Far more rare phrases than cells: few rows pass, as long phrases are sketched only where their pairs passed."""
    import numpy as np
    from larder.llm import collocations as P

    r = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in r.integers(0, 600, 1500)) + ". new york city hall" for _ in range(80)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(2)
    bits, sent = 14, ()
    for sizes in (range(1, 3), range(3, 5)):
        sent += (spark.sparkContext.broadcast(P.merged_sketch(docs, sizes, 30, bits, sent).tobytes()),)
    rows = P.C.arrow_map(docs.select("lang", "text"), ["lang", "text"], P._COUNTED, P._survivors(sent, 4)).where("k >= 3").count()
    assert rows < 10_000  # of some 240 000 different ones, which all passed one sketch of all sizes
    got = {(x.phrase, x.n) for x in P.frequent(docs, bits=bits).where("k >= 2").collect()}
    assert got == {(x.phrase, x.n) for x in P.frequent(docs, bits=22).where("k >= 2").collect()} and ("new york city hall", 80) in got
