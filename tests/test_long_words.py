"""Digits between letters are replaced at any place of a word, however long."""

import random
import re

from larder.functions import text as X
from pyspark.sql import functions as F


def plain(text):
    def word(m):
        w = m[0]
        return "".join(X.DIGIT_LETTERS[c] if c in X.DIGIT_LETTERS and 0 < i < len(w) - 1 and w[i - 1].isalpha() and w[i + 1].isalpha() else c for i, c in enumerate(w))

    return re.sub(r"\b[a-zA-Z0-9]{3,}\b", word, text)


def test_digits_in_long_words(spark):
    r = random.Random(5)
    texts = ["x" * 60 + "0" + "y" * 60 + "1z", "tr1g0 a0b0c0d a01b é0a a_0b a0b_ 70% x8é", "a0b" * 3000]
    texts += ["".join(r.choice("ab0158 2é_") for _ in range(r.randrange(300))) for _ in range(200)]
    texts += ["".join(r.choice("abc0158") for _ in range(150)) for _ in range(50)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.digits_to_letters(F.col("t"))).collect()
    assert dict(got) == {i: plain(t) for i, t in enumerate(texts)}
