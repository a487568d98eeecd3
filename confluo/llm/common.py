"""Shared helpers: the shared folder, written intermediate tables, Arrow batches and numpy hashing of words."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; texts of a batch are worked on in slices of SLICE_BYTES.
BATCH_ROWS = 8192
BATCH_BYTES = 4 << 20
SLICE_BYTES = 2 << 20


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, so that long texts never meet in one large batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@functools.lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="confluo-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a session of one local process gets a temporary folder; on a cluster that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.conf.get("spark.master", "").startswith("local") or "cluster" in spark.conf.get("spark.master", ""):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = _own_dir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there and survives lost executors.

    With ``drop_shuffles`` Spark deletes the shuffle files of the write as it ends, instead of when objects are collected.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(CLEANUP)
    try:
        spark.conf.set(CLEANUP, "true" if drop_shuffles else before)
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing needs any more: it does so as the driver's objects are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives freed memory back to the system as it ends; workers live on from task to task."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
        if trim is not None:
            trim(0)

    return over


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input, as Spark estimates them, of one range; rows where it has no estimate.
RANGE_BYTES, RANGE_ROWS = 128 << 20, 100_000


def ranges(df: DataFrame) -> int:
    """Into how many ranges a table is cut that is sorted range by range: by its size, and no fewer than shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = -(-size // RANGE_BYTES) if 0 <= size < 1 << 55 else -(-df.count() // RANGE_ROWS)
    return max(partitions(df.sparkSession), int(wanted))


def split_points(df: DataFrame, column: str, n: int) -> list[int]:
    """At most n - 1 increasing values that cut the column into ranges of about equal counts."""
    if n < 2:
        return []
    shares = ",".join(str(k / n) for k in range(1, n))
    found = df.selectExpr(f"percentile_approx({column}, array({shares}), {max(10_000, 4 * n)}) as p").first()[0]
    return sorted(set(found or []))


def range_of(column: str, points: list[int]) -> "F.Column":
    """The number of points up to a value, found by halving; null values are in range 0."""
    if not points:
        return F.lit(0)
    values = F.split(F.lit(",".join(map(str, points))), ",").cast("array<bigint>")  # folded into one literal
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(points)).alias("hi"))

    def halve(s: "F.Column", _: "F.Column") -> "F.Column":
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = (s["lo"] < s["hi"]) & (F.get(values, mid) <= F.col(column))
        lo, hi = F.when(up, mid + 1).otherwise(s["lo"]), F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid)
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(points).bit_length())), start, halve)["lo"]


def repeats_ids(docs: DataFrame) -> bool:
    """Whether rows share a doc_id; a scan of the ids tells."""
    n, distinct = docs.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    return n != distinct


def one_per_id(docs: DataFrame) -> DataFrame:
    """Rows with a doc_id, one for each: where several rows share one, the row of the smallest text stands for them.

    Rows of equal texts are told apart by the other columns that can be ordered. Nothing is shuffled if no id repeats.
    """
    docs = docs.where("doc_id is not null")
    if not repeats_ids(docs):
        return docs
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    ordered = ["text", *(c for c in others if "map<" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString())]
    row = F.struct("text", *others)
    return docs.groupBy("doc_id").agg(F.min_by(row, F.struct(*ordered)).alias("r")).select("doc_id", "r.*").select(*docs.columns)


def held_out() -> "F.Column":
    """crc32 of doc_id as text leaves remainder 2 when divided by four."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


# --- Arrow -----------------------------------------------------------------------------------------------------------


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes: (first row, end row, bytes, offsets from 0).

    A null text has no bytes. A row longer than ``limit`` is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


# --- hashing of words --------------------------------------------------------------------------------------------------

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, over an array of unsigned 64-bit integers."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0xA0761D6478BD642F  # odd, so it has an inverse modulo 2 ** 64
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Polynomial hashes of any substrings of an array of bytes, by differences of prefix sums."""

    def __init__(self, data: np.ndarray, table: np.ndarray = BYTE_VALUES):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(_U)
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + length * _U(0x9E3779B97F4A7C15))


#: Separators of terms: ASCII other than digits, lower-case letters and the apostrophe.
NOT_TERM = np.ones(256, bool)
NOT_TERM[[*range(0x30, 0x3A), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = False


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITESPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than separators, and how many each row has."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    black = ~separators[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~black[:-1]
    starts = np.flatnonzero(black & (before | fresh[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~black[1:]
    ends = np.flatnonzero(black & (after | fresh[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))
