"""SentencePiece encoding and decoding by backtracking over longest matches (see ``pieces``).

Defined results: null and empty text are the end id alone and decode to an empty text; equal rows get
equal results; an empty table gives an empty table; other columns pass through ``round_trip``,
whatever their names. A map over batches; memory is bounded by a slice of texts (or one longer
text) and the worker's bounded chunk memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import pieces
from .token_count import model_path, texts_of


def _encoded(column: pa.Array, path: str | None) -> Iterator[tuple[str, str]]:
    """(ids as text with the end id, decoded text) of each row."""
    code = pieces.encoder(model_path(path))
    for raw in texts_of(column):
        yield code.both(raw.decode())


def _forget(path: str | None) -> None:
    pieces.forget(model_path(path))


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """docs with the ids (array<int>, end id last) of text_col in the new column ids_col, and, if named, what they decode to in decoded_col."""
    at = docs.columns.index(text_col)

    def parts(batch: pa.RecordBatch):
        m, texts = pieces.model(model_path(path)), C.text_array(batch.column(at))
        for lo, hi, _, _ in C.slices(texts):
            own = [np.fromstring(x, np.int32, sep=" ") for x, _ in _encoded(texts.slice(lo, hi - lo), path)]
            ids = C.nested(np.concatenate(own), np.array([len(x) for x in own]))
            yield (lo, hi, ids) if decoded_col is None else (lo, hi, ids, pa.array([m.decode(x.tolist()) for x in own], pa.string()))

    return C.widened(docs, {ids_col: "array<int>"} | ({} if decoded_col is None else {decoded_col: "string"}), parts, partial(_forget, path))


def decode(docs: DataFrame, ids_col: str = "ids", path: str | None = None, text_col: str = "text", most: int = 500_000) -> DataFrame:
    """docs with the text of ids_col in the new column text_col; null ids give an empty text. It works on about most ids at a time."""
    at = docs.columns.index(ids_col)

    def parts(batch: pa.RecordBatch):
        m, lists = pieces.model(model_path(path)), batch.column(at)
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
        lo = 0
        while lo < len(lists):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
            yield lo, hi, pa.array([m.decode(x or []) for x in lists.slice(lo, hi - lo).to_pylist()], pa.string())
            lo = hi

    return C.widened(docs, {text_col: "string"}, parts)


def _digests(path: str | None):
    def each(b: pa.RecordBatch) -> list[pa.Array]:
        rows = [(ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) for ids, text in _encoded(b.column(1), path)]
        n, ids, text = zip(*rows, strict=True)
        return [b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)]

    each.done = partial(_forget, path)
    return each


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row, without sending the ids back."""
    kind, text = docs.schema[id_col].dataType.simpleString(), C.free_name(docs, "_text")
    return C.arrow_map(docs.select(F.col(id_col), F.col(text_col).alias(text)), [id_col, text], f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", partial(_digests, path))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to."""
    return digests(C.documents(spark, sf_dir))
