"""A word's trigrams are taken over the whole word, however long."""

import numpy as np
import pyarrow as pa
from larder.llm import common, toxicity


def test_trigrams_of_long_words():
    words = ["a" * 100 + x + "a" * 100 for x in ("aaa", "bcd")]
    (_, _, data, offs), *_ = common.slices(pa.array(words))
    x = toxicity.Inputs(data, offs)
    grams = [set(x.gram_row[x.gram_first[i] : x.gram_first[i + 1]].tolist()) for i in x.word[:2]]
    assert np.diff(x.gram_first).tolist() == [203 + 6] * 2 and len(grams[1] - grams[0]) == 5
