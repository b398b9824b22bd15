"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the sum of a hashed word embedding and the mean of hashed character n-gram
embeddings (starts, ends and trigrams). The network reads windows of ``WINDOW`` words that overlap
by half; its hidden states are pooled by attention to one logit a window. A document's logit is its
highest window's; a logistic curve fitted on the training documents turns it into the score. All
windows of the whole text are read, so one toxic passage counts anywhere.

Training needs labels of documents only: in each round a toxic document's highest windows are
positive, and clean documents' highest and some other windows are negative. It uses at most
``per_class`` documents of each label and ``per_class_bytes`` bytes of their texts, those of least
hash of the text; the limits concern the fit alone. One task fits, not the driver; the fitted network (under 2 MB) goes to the tasks.

Defined results: null and empty text and texts without words score 0; rows without label or with a
null id teach nothing; several labels of a document count as the highest; equal rows get equal
results; without labels of both kinds all scores are 0; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

WINDOW, STRIDE = 32, 16
HIDDEN, SIZE = 12, 16
ROWS = 1 << 16  # of each embedding table
#: A word or character run has a vector if at least so many training texts hold it, or one in so many of the fewer label's texts.
RARE, SHARE = 8, 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Inputs:
    """Of a slice: its words as numbers of different words, these words' table rows, and the windows."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        low = C.LOWER[data]
        w = C.Words(low, offs, C.NOT_ALNUM)
        self.n_docs = len(offs) - 1
        some, first, self.word = np.unique(w.hash, return_index=True, return_inverse=True)
        self.n_words, self.hash = len(some), some
        self.kept = np.arange(self.n_words)  # where each word's rows stand
        self.word_row = (some % np.uint64(ROWS)).astype(np.int64)
        # Character n-grams of the different words, bounded by a mark: all trigrams, and starts and ends of 4 to 6.
        start, size = w.start[first], (w.end - w.start)[first]
        padded = np.append(low, np.zeros(8, np.uint8))
        wide = lambda i: padded[i].astype(np.uint64)
        owner, key = [], []
        count = size
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        who = np.repeat(np.arange(self.n_words), count)
        begin, left = start[who] + at, size[who] - at
        three = wide(begin) | wide(begin + 1) * (left > 1) << np.uint64(8) | wide(begin + 2) * (left > 2) << np.uint64(16)
        owner.append(who)
        key.append(three | np.where(at == 0, 1, 0).astype(np.uint64) << np.uint64(24))
        for k in (4, 5, 6):
            own = np.flatnonzero(size >= k)
            for tag, base in ((2, start[own]), (3, start[own] + size[own] - k)):
                value = np.zeros(len(own), np.uint64)
                for j in range(k):
                    value |= wide(base + j) << np.uint64(8 * j)
                owner.append(own)
                key.append(value | np.uint64(tag * 8 + k) << np.uint64(56))
        owner, key = np.concatenate(owner), C.mix(np.concatenate(key))
        order = np.argsort(owner, kind="stable")
        self.gram_row = (key[order] % np.uint64(ROWS)).astype(np.int32)
        self.gram_first = np.searchsorted(owner[order], np.arange(self.n_words + 1))
        # Windows: every STRIDE words until one reaches the end.
        many = np.where(w.counts > 0, 1 + np.maximum(0, -(-(w.counts - WINDOW) // STRIDE)), 0)
        self.doc = np.repeat(np.arange(self.n_docs), many)
        begin = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
        place = begin[:, None] + np.arange(WINDOW)
        inside = place < w.counts[self.doc][:, None]
        self.windows = np.where(inside, self.word[np.minimum(w.first[self.doc][:, None] + place, max(len(self.word) - 1, 0))] if len(self.word) else 0, -1).astype(np.int32)

    @classmethod
    def of(cls, texts: pa.Array) -> Inputs:
        """Of many texts, made slice by slice and put together. Each slice numbers its words anew, but the rows of a word of several slices stand once."""
        out, seen, words, docs = None, {}, 0, 0
        parts = {k: [] for k in ("windows", "doc", "kept", "word_row", "gram_row", "sizes")}
        for _, _, data, offs in C.slices(texts):
            x, before = cls(data, offs), len(seen)
            kept = np.array([seen.setdefault(h, len(seen)) for h in x.hash.tolist()], np.int32)
            new = np.flatnonzero(kept >= before)
            size = np.diff(x.gram_first)[new]
            grams = np.arange(size.sum()) + np.repeat(x.gram_first[new] - (np.cumsum(size) - size), size)
            own = (np.where(x.windows < 0, -1, x.windows + words).astype(np.int32), x.doc + docs, kept, x.word_row[new], x.gram_row[grams], size)
            for part, values in zip(parts.values(), own, strict=True):
                part.append(values)
            words, docs, out = words + x.n_words, docs + x.n_docs, x
        whole = {k: np.concatenate(parts.pop(k)) for k in list(parts)}
        out.gram_first = np.append(0, np.cumsum(whole.pop("sizes")))
        vars(out).update(whole, n_words=words, n_docs=docs, word=None, hash=None)
        return out


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        h = HIDDEN
        self.p = {
            "words": f(ROWS, SIZE, scale=0.05), "grams": f(ROWS, SIZE, scale=0.05),
            "wf": f(SIZE, 3 * h, scale=0.3), "wb": f(SIZE, 3 * h, scale=0.3), "uf": f(h, 3 * h, scale=0.2), "ub": f(h, 3 * h, scale=0.2),
            "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32),
            "att": f(2 * h, h, scale=0.3), "ask": f(h, scale=0.3), "out": f(2 * h, scale=0.3), "bias": np.full(1, -1, np.float32),
        }
        self.curve = (1.0, 0.0)

    def __getstate__(self) -> dict:
        """Most rows of the tables have no vector."""
        some = {name: np.flatnonzero(self.p[name].any(1)) for name in ("words", "grams")}
        return {"p": self.p | {name: self.p[name][own] for name, own in some.items()}, "some": some, "curve": self.curve}

    def __setstate__(self, state: dict) -> None:
        self.p, self.curve = dict(state["p"]), state["curve"]
        for name, own in state["some"].items():
            values = self.p[name]
            self.p[name] = np.zeros((ROWS, SIZE), values.dtype)
            self.p[name][own] = values

    def embed(self, x: Inputs, most: int = 20_000) -> np.ndarray:
        """Vectors of the different words, so many at a time."""
        out = self.p["words"][x.word_row]
        for lo in range(0, len(out), most):
            first = x.gram_first[lo : lo + most + 1]
            rows = x.gram_row[first[0] : first[-1]]
            out[lo : lo + most] += np.add.reduceat(self.p["grams"][rows], first[:-1] - first[0], axis=0) / np.diff(first)[:, None].astype(np.float32)
        return out

    def _direction(self, gates: np.ndarray, u: np.ndarray, index: np.ndarray, keep: bool, back: bool):
        """States (step x window x hidden) of one direction; gates has a last row for padding."""
        n, h = len(index), HIDDEN
        state = np.zeros((n, h), np.float32)
        states, memory = np.zeros((WINDOW, n, h), np.float32), []
        for t in reversed(range(WINDOW)) if back else range(WINDOW):
            own = index[:, t]
            x, live = gates[own], (own >= 0)[:, None]
            a = state @ u
            zr = _sigmoid(x[:, : 2 * h] + a[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * a[:, 2 * h :])
            nxt = np.where(live, new + z * (state - new), state)
            if keep:
                memory.append((t, state, z, r, new, a[:, 2 * h :], live))
            states[t] = state = nxt
        return states, memory

    def logits(self, vectors: np.ndarray, index: np.ndarray, keep: bool = False):
        p, h = self.p, HIDDEN
        gates = [np.concatenate([vectors @ p["w" + d] + p["b" + d], np.zeros((1, 3 * h), np.float32)]) for d in "fb"]
        f, mf = self._direction(gates[0], p["uf"], index, keep, False)
        b, mb = self._direction(gates[1], p["ub"], index, keep, True)
        both = np.concatenate([f, b], 2)
        hidden = np.tanh(both @ p["att"])
        e = np.where((index.T >= 0), hidden @ p["ask"], -1e9)
        e = np.exp(e - e.max(0))
        share = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", share, both)
        out = pooled @ p["out"] + p["bias"]
        return (out, (both, hidden, share, pooled, mf, mb)) if keep else out

    def score(self, x: Inputs, most: int = 4096) -> np.ndarray:
        """Logit of each window."""
        if not len(x.windows):
            return np.empty(0, np.float32)
        v = self.embed(x)
        return np.concatenate([self._part(v, x.kept, x.windows[i : i + most]) for i in range(0, len(x.windows), most)])

    def _part(self, vectors: np.ndarray, kept: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Logits of some windows, with the gates of their own words only."""
        some, local = np.unique(index, return_inverse=True)
        local = local.reshape(index.shape) - (some[0] < 0)
        return self.logits(vectors[kept[some[some >= 0]]], local)

    def gradients(self, vectors: np.ndarray, index: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean cross entropy, by parameter and by word vector."""
        p, h = self.p, HIDDEN
        out, (both, hidden, share, pooled, mf, mb) = self.logits(vectors, index, True)
        g: dict[str, np.ndarray] = {}
        d = ((_sigmoid(out) - label) / len(label)).astype(np.float32)
        g["out"], g["bias"] = d @ pooled, d.sum(keepdims=True)
        dp = d[:, None] * p["out"]
        dshare = np.einsum("tnh,nh->tn", both, dp)
        de = share * (dshare - (share * dshare).sum(0))
        g["ask"] = np.einsum("tn,tnh->h", de, hidden)
        dh = de[:, :, None] * p["ask"] * (1 - hidden**2)
        g["att"] = np.einsum("tni,tnj->ij", both, dh)
        dboth = share[:, :, None] * dp + dh @ p["att"].T
        dv = np.zeros_like(vectors)
        for name, memory, part in (("f", mf, dboth[:, :, :h]), ("b", mb, dboth[:, :, h:])):
            u, gu = p["u" + name], np.zeros_like(p["u" + name])
            dx = np.zeros((len(vectors) + 1, 3 * h), np.float32)
            carry = np.zeros_like(part[0])
            for t, state, z, r, new, an, live in reversed(memory):
                ds = part[t] + carry
                dl = np.where(live, ds, 0)
                dz, dn = dl * (state - new) * z * (1 - z), dl * (1 - z) * (1 - new**2)
                dr = dn * an * r * (1 - r)
                da = np.concatenate([dz, dr, dn * r], 1)
                gu += state.T @ da
                carry = np.where(live, dl * z, ds) + da @ u.T
                np.add.at(dx, index[:, t], np.concatenate([dz, dr, dn], 1))
            dx = dx[:-1]
            g["u" + name], g["w" + name], g["b" + name] = gu, vectors.T @ dx, dx.sum(0)
            dv += dx @ p["w" + name].T
        return g, dv

    def fit(self, texts: list[str], labels: list[int], rounds: int = 6, steps: int = 700, rate: float = 0.01, forget: float = 0.5, seed: int = 7) -> None:
        """At least so many rounds and about so many steps; in each, forget is the share of words known by their characters only, and of these some are hidden too."""
        r = np.random.default_rng(seed)
        x = Inputs.of(pa.array(texts, pa.string()))
        y = np.array(labels)
        first = np.searchsorted(x.doc, np.arange(x.n_docs + 1))
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        n_grams = np.maximum(np.diff(x.gram_first), 1)
        # Few texts: smaller batches and more rounds, so the number of steps stays.
        batch = 128 if len(x.doc) > 20_000 else 32
        self._forget_rare(x, first, max(RARE, int(min(y.sum(), len(y) - y.sum())) // SHARE))
        turn = -1
        while turn + 1 < rounds or step < steps:
            turn += 1
            logit = self.score(x) if turn > 1 else r.standard_normal(len(x.doc))
            use, target = [], []
            for d in range(x.n_docs):
                own = np.arange(first[d], first[d + 1])
                if not len(own):
                    continue
                top = own[np.argsort(-logit[own])]
                # At most six windows of a toxic text and five of a clean one in a round; scores see all.
                if y[d]:
                    take = top[: max(1, len(own) // 4) if turn > 1 else 6][:6]
                else:
                    take = np.concatenate([top[:2], r.choice(own, min(3, len(own)), replace=False)])
                use.append(take)
                target.append(np.full(len(take), y[d]))
            use, target = np.concatenate(use), np.concatenate(target).astype(np.float32)
            order = r.permutation(len(use))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                index = x.windows[use[at]]
                some, local = np.unique(index, return_inverse=True)
                local = local.reshape(index.shape) - (some[0] < 0)
                some = x.kept[some[some >= 0]]
                rows = np.concatenate([np.arange(x.gram_first[s], x.gram_first[s + 1]) for s in some])
                own = np.repeat(np.arange(len(some)), n_grams[some])
                grams = x.gram_row[rows]
                known = (r.random(len(some)) >= forget).astype(np.float32)[:, None] / (1 - forget)
                vec = self.p["words"][x.word_row[some]] * known
                seen = ((r.random(len(own)) >= forget / 2) / (1 - forget / 2) / n_grams[some][own])[:, None].astype(np.float32)
                np.add.at(vec, own, self.p["grams"][grams] * seen)
                g, dv = self.gradients(vec, local, target[at])
                step += 1
                for name, into, what in (("words", x.word_row[some], dv * known), ("grams", grams, dv[own] * seen)):
                    # Adam on the rows touched only.
                    hit, which = np.unique(into, return_inverse=True)  # rows without a vector keep none
                    grad = np.zeros((len(hit), SIZE), np.float32)
                    np.add.at(grad, which, what)
                    grad[~self.known[name][hit]] = 0
                    self._adam(name, grad, mean, square, step, rate, hit)
                for name, grad in g.items():
                    self._adam(name, grad, mean, square, step, rate, slice(None))
        self._calibrate(x, y)

    def _forget_rare(self, x: Inputs, first: np.ndarray, least: int) -> None:
        """Words and character runs of fewer training texts than least have no vector, as they could only be learned by heart; nor do those never seen."""
        seen = {"words": np.zeros(ROWS, np.int32), "grams": np.zeros(ROWS, np.int32)}
        for d in range(x.n_docs):
            own = np.unique(x.windows[first[d] : first[d + 1]])
            own = x.kept[own[own >= 0]]
            seen["words"][np.unique(x.word_row[own])] += 1
            if len(own):
                begin, size = x.gram_first[own], x.gram_first[own + 1] - x.gram_first[own]
                at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
                seen["grams"][np.unique(x.gram_row[at])] += 1
        self.known = {name: n >= least for name, n in seen.items()}
        for name, known in self.known.items():
            self.p[name][~known] = 0

    def _adam(self, name, grad, mean, square, step, rate, rows) -> None:
        m, s = mean[name], square[name]
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        s[rows] = 0.99 * s[rows] + 0.01 * grad**2
        self.p[name][rows] -= rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(s[rows] / (1 - 0.99**step)) + 1e-6)

    def _calibrate(self, x: Inputs, y: np.ndarray) -> None:
        """Logistic curve from a document's highest logit to its label, with Platt's softened targets."""
        top = np.full(x.n_docs, -10.0)
        np.maximum.at(top, x.doc, self.score(x).astype(float))
        pos, neg = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
        t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        weight = np.where(y > 0, 0.5 / pos, 0.5 / neg)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
            e, w = weight * (p - t), weight * p * (1 - p)
            g = np.array([(e * top).sum() + 1e-4 * (a - 1), e.sum()])
            hess = np.array([[(w * top * top).sum() + 1e-4, (w * top).sum()], [(w * top).sum(), w.sum() + 1e-6]])
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, g), -1, 1)
        self.curve = (max(float(a), 0.05), float(b))

    def probability(self, x: Inputs) -> np.ndarray:
        """Score of each document."""
        top = np.full(x.n_docs, -np.inf)
        np.maximum.at(top, x.doc, self.score(x).astype(float))
        with np.errstate(over="ignore"):
            return np.where(np.isfinite(top), 1 / (1 + np.exp(-np.clip(self.curve[0] * np.where(np.isfinite(top), top, 0) + self.curve[1], -700, 700))), 0.0)


def train(docs: DataFrame, labels: DataFrame, teach, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1500, per_class_bytes: int = 24 << 20) -> Network | None:
    """A network from labelled documents for which the column teach (of the id) is true."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    some = docs.where(teach).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    hashed = some.select("id", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("n")).where(F.col("n") <= per_class_bytes).distinct().join(own, "id")
    # Only hashes are sorted; each shard's least ones first.
    local = hashed.groupBy("y", "h").agg(F.max("n").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("y", F.pmod("h", F.lit(64))).orderBy("h"))).where(F.col("r") <= per_class)
    least = Window.partitionBy("y").orderBy("h")  # 64 * per_class rows at most
    chosen = local.withColumn("r", F.row_number().over(least)).withColumn("n", F.sum("n").over(least)).where((F.col("r") <= per_class) & (F.col("n") <= per_class_bytes)).select("y", "h")
    hashes = [r.h for r in chosen.select("h").distinct().collect()]  # 2 * per_class at most
    picked = some.withColumn("h", F.xxhash64("text")).where(F.col("h").isin(hashes)) if hashes else some.withColumn("h", F.lit(0)).limit(0)
    rows = picked.join(own, "id").groupBy("h").agg(F.first("text").alias("text"), F.max("y").alias("y"))
    found = rows.repartition(1).sortWithinPartitions("h").select("text", "y").mapInArrow(_fitted, "net binary").collect()
    return pickle.loads(found[0].net) if found else None


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The network of a task's texts, 2 * per_class at most, if they have both labels."""
    texts, y = [], []
    for batch in batches:
        texts += batch.column(0).to_pylist()
        y += [int(n > 0) for n in batch.column(1).to_pylist()]
    if 0 < sum(y) < len(y):
        net = Network()
        net.fit(texts, y)
        del texts
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])
    C.tidy()


def _scorer(net: Network | None):
    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        if net is None:
            return [batch.column(0), pa.array(np.zeros(batch.num_rows))]
        return [batch.column(0), pa.array(np.concatenate([net.probability(Inputs(data, offs)) for _, _, data, offs in C.slices(batch.column(1))]))]

    return lambda: each


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row."""
    kind, text = docs.schema[id_col].dataType.simpleString(), C.free_name(docs, "_text")
    return C.arrow_map(docs.select(F.col(id_col), F.col(text_col).alias(text)), [id_col, text], f"`{id_col}` {kind}, score double", _scorer(net))


def with_score(docs: DataFrame, net: Network | None, text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with a score column, and its name."""
    name = C.free_name(docs, "_score")

    at = docs.columns.index(text_col)

    def parts(batch: pa.RecordBatch):
        for lo, hi, data, offs in C.slices(batch.column(at)):
            yield lo, hi, pa.array(np.zeros(hi - lo) if net is None else net.probability(Inputs(data, offs)))

    return C.widened(docs, {name: "double"}, parts), name


def teaches(id_col: str = "doc_id"):
    return C.crc_mod(id_col, 3) != 1


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a third, by crc32 of the id, taught nothing."""
    docs = C.documents(spark, sf_dir)
    net = train(docs, C.documents(spark, sf_dir, "labels"), teaches())
    found = score(docs, net)
    return found.select("doc_id", F.coalesce(C.crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
