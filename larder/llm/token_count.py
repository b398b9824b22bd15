"""Token counts by the whole-token shortcut.

A worker proves once, by merging each vocabulary string, which of them encode alone as one token.
A text's chunks (a space mark and a word, see ``pieces``) that are such strings count directly; the
rest is merged, each different chunk once as long as the worker's bounded memory holds it.

Defined results: null and empty text have no tokens and no bytes; nothing is added for begin or end;
equal rows get equal results; an empty table gives an empty table. Memory is bounded by one slice of
texts (or one longer text) and ``pieces.MEMORY``.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import pieces

MODEL = "piece_bpe_32k.model"


def model_path(path: str | None) -> str:
    """Given, or that of the installed public tokenizer files (on whichever machine this runs)."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def texts_of(column: pa.Array):
    for _, _, data, offs in C.slices(column):
        body = data.tobytes()
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            yield body[a:b]


def _counter(path: str | None):
    count = pieces.counter(model_path(path))

    def each(b: pa.RecordBatch) -> list[pa.Array]:
        sizes, tokens = [], []
        for raw in texts_of(b.column(b.num_columns - 1)):
            sizes.append(len(raw))
            tokens.append(count.count(pieces.keys(raw.decode())))
        return [*b.columns[:-1], pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())]

    return each


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return C.arrow_map(docs.select(F.col(id_col), F.col(text_col).alias(C.free_name(docs, "_text"))), [id_col, C.free_name(docs, "_text")], f"`{id_col}` {kind}, n_bytes long, n_tokens long", partial(_counter, path))


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; over_limit: more than 4096."""
    return count_tokens(C.documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > 4096)
