"""The network is fitted by a task, never by the driver, and keeps a word of many slices once."""

import pickle

import numpy as np
import pyarrow as pa
from larder.llm import common, toxicity
from pyspark.sql import functions as F


def test_fit_leaves_the_driver(spark, monkeypatch):
    """Tasks run in processes of their own, so what is replaced here is the driver's."""

    def here(*_, **__):
        raise AssertionError("fitted by the driver")

    texts = [f"w{i} some words {'vile' if i % 2 else 'fine'}{i % 5} more words" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    with monkeypatch.context() as m:
        m.setattr(toxicity.Network, "fit", here)
        net = toxicity.train(docs, labels, F.lit(True))
        assert toxicity.train(docs, labels.where("toxic = 1"), F.lit(True)) is None
    alone = toxicity.Network()
    order = [r.text for r in docs.orderBy(F.xxhash64("text")).collect()]
    alone.fit(order, [int("vile" in t) for t in order])
    assert all(np.allclose(net.p[k], alone.p[k], atol=1e-5) for k in alone.p)
    assert len(pickle.dumps(net)) < 2 << 20


def test_words_of_many_slices_stand_once():
    texts = pa.array([" ".join(f"word{i % 90}" for i in range(20_000)) for _ in range(6)])
    x, parts = toxicity.Inputs.of(texts), [toxicity.Inputs(data, offs) for _, _, data, offs in common.slices(texts)]
    assert len(parts) > 2 and len(x.word_row) == 90 and x.n_words == 90 * len(parts)
    net = toxicity.Network()
    assert (net.embed(x)[x.kept] == np.concatenate([net.embed(p) for p in parts])).all()
    assert (net.score(x) == np.concatenate([net.score(p) for p in parts])).all()
