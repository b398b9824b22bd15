"""Each operator against brute force, its library, held-out accuracy or its SQL."""

import collections
import hashlib
import math
import re
import zlib

import corpus_pipeline
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from larder.llm import bloom_lm, common, decontaminate, language_id, line_dedup, near_dedup, pieces, quality_rules, queries, substring_dedup, toxicity
from pyspark.sql import functions as F

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SOME = settings(max_examples=60, deadline=None)


@pytest.fixture(scope="module")
def texts(sf):
    return pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")


def result(spark, sf, name):
    return queries.QUERIES[name](spark, sf).toPandas().set_index("doc_id").sort_index()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(name, same):
    same(queries.QUERIES[name], queries.SQL[name])


# Words and hashes.


@SOME
@given(st.lists(st.text(alphabet="ab é\n\tB1.", max_size=20), min_size=1, max_size=8))
def test_words(values):
    (_, _, data, offs), *_ = common.slices(pa.array(values))
    w = common.Words(data, offs)
    body = data.tobytes()
    assert [body[a:b].decode() for a, b in zip(w.start, w.end, strict=True)] == [x for v in values for x in WORD.findall(v)]
    assert w.counts.tolist() == [len(WORD.findall(v)) for v in values]
    named = collections.defaultdict(set)
    for a, b, h in zip(w.start, w.end, w.hash, strict=True):
        named[body[a:b]].add(int(h))
    assert all(len(x) == 1 for x in named.values()) and len({*map(tuple, named.values())}) == len(named)
    low = decontaminate.scan(data, offs)
    assert low.counts.tolist() == [len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), v))) for v in values]


# 1


@SOME
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=4), min_size=1, max_size=6))
def test_fm_index(seq, patterns):
    index = decontaminate.FMIndex(np.array(seq), 5)
    width = max(map(len, patterns))
    table = np.array([[0] * (width - len(p)) + p for p in patterns])
    lo, hi = index.search(table, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, lo, hi, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(seq) - len(p) + 1) if seq[i : i + len(p)] == p]


# 2 and 4


def test_tokens_library(spark, sf, texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    two, four = result(spark, sf, "op2_token_count"), result(spark, sf, "op4_sentencepiece")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in texts.text.items():
        ids = lib.encode(t) + [lib.eos_id()]
        assert tuple(two.loc[i]) == (len(t.encode()), len(ids) - 1, len(ids) - 1 > 4096)
        assert tuple(four.loc[i]) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aehtrinos  \n▁<>s/é😀\t.,$1"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoder(text):
    code, count = pieces.encoder(PATH), pieces.counter(PATH)
    ids = code.m.lib.encode(text)
    assert code.encode(text) == [*ids, code.m.end] and code.both(text)[1] == code.m.lib.decode(ids)
    assert count.count(pieces.keys(text)) == len(ids)
    assert code.m.decode([*ids, code.m.end]) == code.m.lib.decode(ids)


@SOME
@given(st.lists(st.integers(0, 31999), max_size=12))
def test_decoder(ids):
    m = pieces.model(PATH)
    ids = [i for i in ids if i not in (0, 1)]
    assert m.decode(ids) == m.lib.decode(ids)


# 3


def brute_repeats(docs, n):
    seen, gone = set(), collections.defaultdict(set)
    for i, t in sorted(docs):
        w = t.split()
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            if key in seen:
                gone[i] |= set(range(s, s + n))
            seen.add(key)
    return gone


@pytest.mark.parametrize(("n", "letters"), [(20, 2), (6, 3)])
def test_repeats_random(spark, n, letters):
    r = np.random.default_rng(n)
    base = [" ".join(r.choice(list("abcde"[:letters]), 90)) for _ in range(6)]
    docs = [(i, " ".join(base[r.integers(6)].split()[r.integers(40) :][: r.integers(90)] + list(r.choice(list("abc"), r.integers(30))))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    found, name = substring_dedup.repeats(df, n=n)
    want = brute_repeats(docs, n)
    for row in found.collect():
        got = {p for x in row[name] or [] for p in range(x >> 32, (x >> 32) + (x & 0xFFFFFFFF) + n - 1)}
        assert got == want[row.doc_id]


def test_winnowing_is_local():
    """Equal windows have equal anchors at equal places."""
    r = np.random.default_rng(1)
    a = " ".join(r.choice(list("abcdefgh"), 70))
    for pad in ("", "x y z ", "a b "):
        (_, _, data, offs), *_ = common.slices(pa.array([a, pad + a]))
        w = common.Words(data, offs)
        s, size, h, _ = substring_dedup.anchors(w, 20, 10)
        owner = {int(x) + j: int(g) for x, m, g in zip(s, size, h, strict=True) for j in range(m)}
        off = len(pad.split())
        assert all(owner[p] == owner[70 + off + p] for p in range(51))


# 5


def brute_classes(docs, threshold=0.8):
    label = {}
    for lo, hi, data, offs in common.slices(pa.array([t for _, t in docs])):
        _, labelled, first = near_dedup.shingles(data, offs)
        for r in range(hi - lo):
            label[docs[lo + r][0]] = labelled[first[r] : first[r + 1]].copy()
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, t) in enumerate(docs):
        for j, u in docs[:k]:
            if t == u or len(label[i]) and len(label[j]) and near_dedup.similarity(label[j], label[i], threshold) >= threshold:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i, _ in docs}


def test_near_brute(spark, sf, texts):
    got = result(spark, sf, "op5_near_dedup")
    assert got.class_id.to_dict() == brute_classes(list(texts.text.items()))


def test_near_chains(spark):
    """Large groups, some of whose members are linked by others only, over several partitions."""
    r = np.random.default_rng(5)
    docs, words = [], [f"w{i}" for i in range(4000)]
    for _ in range(4):
        base = list(r.choice(words, 200))
        for _ in range(60):
            base = list(base)
            for at in r.integers(0, 200, 2):
                base[at] = r.choice(words)
            docs.append((len(docs), " ".join(base)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = {x.doc_id: x.class_id for x in near_dedup.near_classes(df).collect()}
    assert got == brute_classes(docs)
    assert near_dedup.drop_near(df).count() == len(set(got.values()))


@SOME
@given(st.lists(st.integers(0, 12), max_size=20, unique=True), st.lists(st.integers(0, 12), max_size=20, unique=True))
def test_alignment(a, b):
    m = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1, j + 1] = m[i, j] + 1 if x == y else max(m[i, j + 1], m[i + 1, j])
    total = len(a) + len(b)
    want = m[-1, -1] / (total - m[-1, -1]) if total else 0
    got = near_dedup.similarity(np.array(a, np.uint64), np.array(b, np.uint64), 0.5) if total else 0
    assert got == pytest.approx(want) if want >= 0.5 else got < 0.5


# 6


def test_quality(spark, sf, texts):
    got = result(spark, sf, "op6_quality_rules")
    for i, t in texts.text.items():
        w = WORD.findall(t)
        often = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if often[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(got.loc[i, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert got.base_failed[i] == failed and not (failed and got.kept[i])
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").quality
    both = got.join(labels, how="inner")
    both = both[~both.base_failed]
    assert (both.kept == (both.quality == 1)).mean() > 0.95


def test_em_recovers():
    r = np.random.default_rng(2)
    good = r.random(20_000) < 0.8
    votes = np.ones((20_000, 6), int)
    for j, accuracy in enumerate((0.95, 0.9, 0.8, 0.85, 0.7, 0.6)):
        says = r.random(20_000) < 0.8
        right = r.random(20_000) < accuracy
        votes[says, j] = np.where(good == right, 2, 0)[says]
    count = collections.Counter("".join(map(str, v)) for v in votes)
    share, p, post = quality_rules.fit(list(count), np.array(list(count.values()), float))
    by = dict(zip(count, post, strict=True))
    assert share == pytest.approx(0.8, abs=0.02)
    assert p[1, 0, 2] / (1 - p[1, 0, 1]) == pytest.approx(0.95, abs=0.02)
    assert np.mean([(by["".join(map(str, v))] >= 0.5) == g for v, g in zip(votes, good, strict=True)]) > 0.95


# 7


def test_language_model(spark, sf, texts):
    got = result(spark, sf, "op7_lm_score")
    words = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), None] for i, t in texts.text.items()}
    teach = {i for i in words if zlib.crc32(str(i).encode()) % 10}
    count = collections.Counter(w for i in teach for w in words[i])
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        row = got.loc[i]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (i not in teach, len(w), sum(count[x] > 0 for x in w), n)
        assert row.base_score == pytest.approx(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (got.score <= 0).all()


def test_filter_levels():
    r = np.random.default_rng(4)
    fps = r.integers(0, 2**64, 20_000, dtype=np.uint64) >> np.uint64(2)  # the first of four segments
    n = np.maximum(1, r.zipf(1.5, 20_000) % 5000)
    f = bloom_lm.Filter({0: bloom_lm.segment_bits(fps, n, 1).tobytes()}, 2)
    level = f.level(fps)
    assert (level >= bloom_lm.levels(n, 1)).all() and (level == bloom_lm.levels(n, 1)).mean() > 0.95
    assert (f.level(r.integers(0, 2**64, 20_000, dtype=np.uint64) >> np.uint64(2)) > 0).mean() < 0.05
    ratio = bloom_lm.expected(bloom_lm.levels(n, 1), 1) / n
    assert ratio.min() > 0.7 and ratio.max() < 1.4


# 8


def test_gradients():
    net = toxicity.Network()
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    (_, _, data, offs), *_ = common.slices(pa.array([" ".join(f"word{i % 7}" for i in range(40)), "a b word1 c"]))
    x = toxicity.Inputs(data, offs)
    label = np.array([1.0, 0.0, 1.0])[: len(x.windows)]
    v = net.embed(x).astype(np.float64)

    def loss():
        p = toxicity._sigmoid(net.logits(v, x.windows))
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    g, dv = net.gradients(v, x.windows, label)
    for name, grad in [*g.items(), ("vectors", dv)]:
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        target = v if name == "vectors" else net.p[name]
        old, e = target[at], 1e-4
        target[at] = old + e
        up = loss()
        target[at] = old - e
        down = loss()
        target[at] = old
        assert (up - down) / (2 * e) == pytest.approx(grad[at], rel=0.02, abs=1e-5), name


def test_toxicity_learns():
    r = np.random.default_rng(6)
    plain, bad = [f"w{i}" for i in range(300)], [f"vile{x}" for x in "abcdefgh"]

    def doc(toxic, forms):
        w = list(r.choice(plain, r.integers(40, 160)))
        for at in r.integers(0, len(w), 4) if toxic else []:
            w[at] = r.choice(forms)
        return " ".join(w)

    y = [int(i % 3 == 0) for i in range(360)]
    net = toxicity.Network()
    net.fit([doc(t, bad[:6]) for t in y], y, rounds=8)
    test = [doc(t, bad[6:]) for t in y]  # other endings: only the characters tell
    p = np.concatenate([net.probability(toxicity.Inputs(d, o)) for _, _, d, o in common.slices(pa.array(test))])
    assert np.mean((p >= 0.7) == np.array(y)) > 0.9
    long = " ".join([doc(0, []) for _ in range(30)] + [doc(1, bad)] + [doc(0, []) for _ in range(30)])
    assert net.probability(toxicity.Inputs(*next(common.slices(pa.array([long])))[2:]))[0] >= 0.7


def test_toxicity_ignores_labels(spark, sf):
    """Scores of held-out rows don't change with their own labels; columns of the contract."""
    got = result(spark, sf, "op8_toxicity")
    assert list(got.columns) == ["held_out", "score", "predicted"] and got.score.between(0, 1).all()
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got.index)
    assert (got.predicted == (got.score >= 0.7)).all()


# 9


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_random(spark, keep_first):
    r = np.random.default_rng(9)
    docs = [(i, "\n".join(r.choice(["hot", " Hot ", "x", "y", "", "z z", f"own{i}", f"some{i % 20}"], r.integers(1, 9)))) for i in range(200)]
    want, seen = {}, collections.defaultdict(set)
    for i, t in docs:
        for k, key in enumerate(x.strip(" \t").lower() for x in t.split("\n")):
            seen[key].add(i)
    for i, t in docs:
        keep = [x for x in t.split("\n") if not (key := x.strip(" \t").lower()) or len(seen[key]) < 4 or keep_first and i == min(seen[key])]
        want[i] = "\n".join(keep)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {x.doc_id: x.text for x in line_dedup.drop_lines(df, min_docs=4, keep_first=keep_first).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


# 10


def test_language(spark, sf, texts):
    got = result(spark, sf, "op10_language_id")
    held = got.join(texts.lang)[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95


def test_profiles_brute(spark, sf, texts):
    table = language_id.profiles(spark.read.parquet(f"{sf}/documents.parquet"), "text", "lang", 40)

    def ranked(t):
        words = "".join(c.lower() if c.isalpha() else " " for c in t).split()
        count = collections.Counter(g for w in words for n in (1, 2, 3) for g in ((w[i : i + n] for i in range(len(w))) if n == 1 else ((" " + w + " ")[i : i + n] for i in range(len(w) + 3 - n))) if len(g) == n)
        code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
        return [code(g) for g in sorted(count, key=lambda g: (-count[g], code(g)))[: language_id.PROFILE]]

    some = texts.text.head(40)
    score = language_id._classifier(table)()
    got = score(pa.RecordBatch.from_arrays([pa.array(some.index), pa.array(some.tolist())], names=["i", "t"]))
    for t, lang in zip(some, got[1].to_pylist(), strict=True):
        far = {}
        for k, v in table.items():
            rank = {g: i for i, g in enumerate(v)}
            far[k] = sum(abs(rank[g] - i) if g in rank else language_id.PROFILE for i, g in enumerate(ranked(t)))
        assert far[lang] == min(far.values())


# The pipeline, stage by stage.


def test_pipeline(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    at = {}
    for name, stage in stages.items():
        docs = common.checkpoint(stage(spark, docs, sf))
        at[name] = docs.toPandas().set_index("doc_id").sort_index()
    net = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), toxicity.teaches())
    score = toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), net).toPandas().set_index("doc_id").score
    assert set(at["toxicity"].index) == set(score[score < corpus_pipeline.TOXIC].index)
    found = collections.Counter(k for t in at["toxicity"].text for k in {x.strip(" \t\n\x0b\x0c\r").lower() for x in t.split("\n")})
    for i, t in at["toxicity"].text.items():
        want = "\n".join(x for x in t.split("\n") if not (k := x.strip(" \t\n\x0b\x0c\r").lower()) or found[k] < 10)
        assert at["line_dedup"].text[i] == want and at["line_dedup"].n_chars[i] == len(want)
    classes = brute_classes(list(at["line_dedup"].text.items()))
    assert sorted(at["near_dedup"].index) == sorted(set(classes.values()))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    windows = set()
    for t in pd.read_parquet(f"{sf}/benchmark.parquet").text:
        w = words(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(x) for x in windows}
    for i, t in at["near_dedup"].text.items():
        w = words(t)
        hit = {k + j for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(n)}
        assert words(at["decontaminate"].text[i]) == [x for k, x in enumerate(w) if k not in hit]
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for i, t in at["decontaminate"].text.items():
        ids = lib.encode(t) + [2]
        assert list(at["sentencepiece"].ids[i]) == ids and at["sentencepiece"].decoded[i] == lib.decode(ids) and at["sentencepiece"].n_tokens[i] == len(ids)


def test_held_out_flags(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    got = [r[0] for r in df.orderBy("doc_id").select(common.crc_mod("doc_id", 4)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 4 for i in range(50)]
    assert F.lit(1) is not None
