"""Quality by weak supervision: rules vote or abstain, and their accuracies are estimated from agreement.

Each rule says good, bad or nothing of a document, from counts of its whole text. Expectation-
maximisation over all documents' vote patterns estimates, without labels, how often documents are
good and how each rule votes for good and for bad ones; a document is kept if its posterior
probability of being good is at least ``threshold``. Patterns are counted on the cluster; only the
counts (3**rules rows at most, whatever the input) go to the driver.

Defined results: null and empty text have no words, so they fail the base rule (n_words < 50) and
aren't kept; equal rows get equal results; an empty table gives an empty table; posterior ties at
the threshold are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_ALPHA = _UPPER.copy()
_ALPHA[0x61:0x7B] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: More counts of the whole text that rules use.
MORE = ["n_upper", "n_alpha", "n_lines", "n_marks", "n_stops", "n_same"]

#: Rule: (bad if, good if) of the counts per word; else it abstains. One defect's absence says nothing of the
#: others, so most rules only accuse, and those that praise ask for several things at once.
RULES = {
    "symbols": ("n_symbols > 0.1 * n_words", "false"),
    "symbol_share": ("n_symbols > 0.02 * word_chars", "false"),
    "repeats": ("n_repeat_words > 0.25 * n_words", "false"),
    "same_word": ("n_same > 0.1 * n_words", "false"),
    "capitals": ("n_upper > 0.3 * n_alpha", "false"),
    "shouts": ("n_marks > 0.1 * n_words", "false"),
    "lines": ("n_dup_lines > 0.2 * n_lines", "false"),
    "word_size": ("word_chars < 3 * n_words OR word_chars > 12 * n_words", "false"),
    "sentences": ("n_stops > 0.6 * n_words", "n_stops > 0.01 * n_words AND n_upper < 0.15 * n_alpha AND n_symbols < 0.05 * n_words"),
    "tidy": ("false", "n_symbols < 0.05 * n_words AND n_marks < 0.05 * n_words AND n_same < 0.05 * n_words AND n_repeat_words < 0.25 * n_words"),
}


def _counts(batch: pa.RecordBatch) -> list[pa.Array]:
    out = []
    for _, _, data, offs in C.slices(batch.column(1)):
        n = len(offs) - 1
        w = C.Words(data, offs)
        inside = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=inside[1:])
        chars = C.by_document(inside[w.end] - inside[w.start], w.doc, n)

        def total(flags: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(flags, out=sums[1:])
            return np.diff(sums[offs])

        # Words in three-word windows that the text holds twice or more.
        at, grams = w.windows(3)
        key = C.mix(grams ^ C.mix(w.doc[at].astype(np.uint64)))
        _, which, often = np.unique(key, return_inverse=True, return_counts=True)
        step = np.zeros(len(w.start) + 1, np.int64)
        twice = at[often[which] > 1]
        np.add.at(step, twice, 1)
        np.add.at(step, twice + 3, -1)
        repeat = C.by_document(np.cumsum(step[:-1]) > 0, w.doc, n)
        same = np.zeros(len(w.start), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        body, dup, lines = data.tobytes(), [], []
        for a, b in zip(offs[:-1], offs[1:], strict=True):
            own = [x for x in body[a:b].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            dup.append(len(own) - len(set(own)))
            lines.append(len(own))
        out.append([w.counts, chars, total(_SYMBOL[data]), np.array(dup), repeat, total(_UPPER[data]), total(_ALPHA[data]), np.array(lines), total(data == 0x21), total(data == 0x2E), C.by_document(same, w.doc, n)])
    return [batch.column(0), *(pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True))]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the counts of each row."""
    kind, text = docs.schema[id_col].dataType.simpleString(), C.free_name(docs, "_text")
    return C.arrow_map(docs.select(F.col(id_col), F.col(text_col).alias(text)), [id_col, text], ", ".join([f"`{id_col}` {kind}", *(f"{c} long" for c in COUNTS + MORE)]), lambda: _counts)


def votes(counted: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds the pattern: a digit for each rule, 0 bad, 1 nothing, 2 good."""
    each = [F.when(F.expr(bad), "0").when(F.expr(good), "2").otherwise("1") for bad, good in rules.values()]
    return counted.withColumn("pattern", F.concat(*each))


def fit(patterns: list[str], n: np.ndarray, rounds: int = 200, smooth: float = 1.0, good: float = 0.85) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good documents, P(vote | class, rule) as class x rule x vote, posterior of each pattern) by EM.

    It starts from rules that are right four times in five; each rule stays no worse than chance, so good
    and bad can't change places. The share of good documents is free.
    """
    if not patterns:
        return good, np.full((2, 0, 3), 1 / 3), np.empty(0)
    vote = np.array([[int(x) for x in p] for p in patterns], np.int64).reshape(len(patterns), -1)
    one = np.eye(3)[vote]  # pattern x rule x vote
    share = (one * n[:, None, None]).sum(0) / max(n.sum(), 1)
    p = np.empty((2, vote.shape[1], 3))
    for c, tilt in ((0, (0.8, 0.5, 0.2)), (1, (0.2, 0.5, 0.8))):
        p[c] = (share + 0.05) * tilt
        p[c] /= p[c].sum(1, keepdims=True)
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        logs = np.log([1 - good, good]) + np.einsum("irv,crv->ic", one, np.log(p))
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            p[c] = np.einsum("i,irv->rv", w, one) + smooth
            p[c] /= p[c].sum(1, keepdims=True)
        # A good vote is never likelier for bad documents, nor a bad one for good documents.
        for v, hi in ((0, 0), (2, 1)):
            swap = p[hi, :, v] < p[1 - hi, :, v]
            p[:, swap, v] = p[:, swap, v].mean(0)
        p /= p.sum(2, keepdims=True)
        good = float((n @ post + smooth) / (n.sum() + 2 * smooth))
        if done:
            break
    return good, p, post


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, tuple[str, str]] | None = None, threshold: float = 0.5) -> DataFrame:
    """Counts, posterior and kept of each row."""
    counted = C.checkpoint(votes(counts(docs, id_col, text_col), RULES if rules is None else rules))
    found = counted.groupBy("pattern").count().orderBy("pattern").toPandas()  # 3**rules rows at most
    _, _, post = fit(found["pattern"].tolist(), found["count"].to_numpy(float))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    table = counted.sparkSession.createDataFrame(list(zip(found["pattern"].tolist(), post.tolist(), strict=True)) or [("", 0.0)], "pattern string, posterior double")
    judged = counted.join(F.broadcast(table), "pattern").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document."""
    return judge(C.documents(spark, sf_dir)).select("doc_id", *COUNTS, "base_failed", "kept", "posterior")
