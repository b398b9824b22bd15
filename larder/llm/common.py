"""What the text operators share: vectorised word scanning over Arrow buffers, hashes, checkpoints.

All scanning works on whole Arrow batches cut into slices of about ``SLICE`` bytes at document
borders, so memory is bounded by the slice (or by one document when that is longer) and no Python
object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 18
_M = np.uint64(0x9E3779B97F4A7C15)
_REACH = 64  # bytes of a word whose hash values are tabulated

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All but digits, small ASCII letters and bytes of longer UTF-8 sequences (after lower-casing).
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(byte: np.ndarray, place: np.ndarray, lane: int) -> np.ndarray:
    """A pseudo-random value for each byte at each place of a word."""
    return mix((byte.astype(np.uint64) | place.astype(np.uint64) << np.uint64(8)) * _M + mix(np.array([lane + 1], np.uint64)))


#: By lane: the values of all bytes at the first places.
_TABLE = [_byte_values(np.tile(np.arange(256), _REACH), np.repeat(np.arange(_REACH), 256), lane) for lane in (0, 1)]


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of each non-empty word data[start:end]: the sum of a value for each byte and its place, so no word's
    structure can cancel out. Lanes are independent: two make 128 bits."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    byte = data[place + np.repeat(start, size)]
    value = _TABLE[lane][np.minimum(place, _REACH - 1) << 8 | byte]
    far = np.flatnonzero(place >= _REACH)
    if len(far):
        value[far] = _byte_values(byte[far], place[far], lane)
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * _M)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the runs values[start:end], none empty, of 64-bit hashes: two runs of a power of two, hashed as
    trees, cover each. Every joint is mixed, so equal sums can't cancel out."""
    out = np.empty(len(start), np.uint64)
    size = end - start
    tree, width, left = values, 1, size.max(initial=0)
    while width <= left:
        own = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(own):
            out[own] = mix(_joined(tree[start[own]], tree[end[own] - width]) + size[own].astype(np.uint64) * _M)
        tree = _joined(tree[:-width], tree[width:]) if len(tree) > width else tree[:0]
        width *= 2
    return out


class Words:
    """Words of one slice: byte spans, document number of each, first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        gap = breaks[data]
        inner = ~gap
        first, last = inner.copy(), inner.copy()
        first[1:] &= gap[:-1]
        last[:-1] &= gap[1:]
        edge = offsets[:-1]
        edge = edge[edge < len(data)]
        first[edge] = inner[edge]
        edge = edge[edge > 0] - 1
        last[edge] = inner[edge]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self._lanes: dict[int, np.ndarray] = {}

    def lane(self, lane: int) -> np.ndarray:
        """One of two independent 64-bit hashes of each word."""
        if lane not in self._lanes:
            self._lanes[lane] = word_hash(self.data, self.start, self.end, lane)
        return self._lanes[lane]

    @property
    def hash(self) -> np.ndarray:
        return self.lane(0)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all runs of k words inside one document."""
        n = len(self.start)
        if n < k:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return at, span_hash(self.hash, at, at + k)


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of documents; null counts as empty."""
    column = text_array(column)
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, body = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, body[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def by_document(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of integer values by document number."""
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)


def pad_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of half-open spans within each document, in order; touching spans become one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = doc.astype(np.int64) << 32
    reach = np.maximum.accumulate(base + end)
    new = np.ones(len(doc), bool)
    new[1:] = (base + start)[1:] > reach[:-1]
    new[1:] |= doc[1:] != doc[:-1]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc)) - 1
    return doc[head], start[head], reach[tail] - base[tail]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(column: str, m: int):
    """crc32 of the column as text, modulo m."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def crc_of(value: object, m: int) -> int:
    return zlib.crc32(str(value).encode()) % m


def with_checkpoints(spark: SparkSession) -> None:
    """The cluster's shared folder is used as it is set; a folder of this machine only where all runs on it, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints")
        spark.sparkContext.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """df written as a table in the shared checkpoint folder and read from there; Spark removes it when it ends.

    Unlike a checkpointed RDD, a table tells its true size; the estimates of loops of joins would multiply without end.
    """
    spark = df.sparkSession
    with_checkpoints(spark)
    jvm, path = spark.sparkContext._jvm, f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop_checkpoint(df: DataFrame) -> None:
    """Removes the table of a checkpoint() that nothing will read again."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._table_path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tidy() -> None:
    """Gives a finished task's free memory back to the machine, as workers wait for the next task and share an executor's memory."""
    gc.collect(1)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def widened(docs: DataFrame, kinds: dict[str, str], parts: Callable[[pa.RecordBatch], Iterator[tuple]], done: Callable[[], None] = lambda: None) -> DataFrame:
    """docs with further columns (or such in place of those of that name): parts gives (first row, row after the last, an array for each) of runs of a batch's rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    fields = {k: StructField(k, _parse_datatype_string(v)) for k, v in kinds.items()}
    schema = StructType([*(fields.get(f.name, f) for f in docs.schema), *(f for k, f in fields.items() if k not in docs.columns)])
    arrow = to_arrow_schema(schema)
    own, at = len(docs.columns), [arrow.names.index(k) for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for lo, hi, *arrays in parts(batch):
                    columns = [*batch.slice(lo, hi - lo).columns, *[None] * (len(arrow) - own)]
                    for i, array in zip(at, arrays, strict=True):
                        columns[i] = array.cast(arrow.types[i])
                    yield pa.RecordBatch.from_arrays(columns, names=arrow.names)
        finally:
            done()
            tidy()

    return docs.mapInArrow(run, schema)


def arrow_map(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array] | None]]) -> DataFrame:
    """Applies make()'s function to each batch of the columns; it returns the arrays of the schema.

    make runs once per task, so what it builds is shared by the batches of a task; the function's ``done``, if it has
    one, is called at the end.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        try:
            for batch in batches:
                if batch.num_rows:
                    out = each(batch)
                    for part in [out] if isinstance(out, list) else out:
                        yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(part, arrow, strict=True)], schema=arrow)
        finally:
            getattr(each, "done", lambda: None)()
            tidy()

    return df.select(*columns).mapInArrow(run, kind)


def nested(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
