"""Shared parts: the folder all executors see, written stages, batches of UTF-8 bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.shared import released, written  # noqa: F401
from graphloom.shipping import ship

#: Rows and bytes of an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 200, 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Readies a session for Arrow work: batches bounded by rows and, where this Spark has the setting, by bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What Python workers keep between tasks, and for whom.
CACHES: list[dict] = []
_owner: list[str] = [""]
_frozen: list[bool] = []


def in_pieces(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """A large batch in parts, so that Spark never holds it as a whole."""
    for i in range(0, len(batch), rows):
        yield batch.slice(i, rows)


def trim() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def task(name: str) -> Callable:
    """For functions on the batches of a task: a worker that last ran another operator drops that one's caches first, and each task
    gives its memory back at its end, as workers stay. What a worker has imported is left out of that collection, which would else take some
    70 ms of each task."""

    def wrap(f: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not _frozen:
                _frozen.append(True)
                gc.freeze()
            if _owner[0] != name:
                _owner[0] = name
                for c in CACHES:
                    c.clear()
                trim()
            yield from f(batches)
            trim()

        return run

    return wrap


def fresh(df: DataFrame, n: int) -> list[str]:
    """n column names that df doesn't have, whatever its own are called."""
    taken = {c.lower() for c in df.columns}
    return list(islice((x for k in count() if (x := f"_own_{k}") not in taken), n))


def numbers(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a table of bounded size at the driver, by Arrow: a few bytes a number and no object a row."""
    table = df.toArrow()
    return {c: table[c].to_numpy() for c in table.column_names}


#: Bits of a sieve, at least and at most: 128 KB to 16 MB for all executors.
SIEVE = (1 << 20, 1 << 27)


def sieve_bits(n: int) -> int:
    """Bits of a sieve for n entries: 16 each, a power of two. Beyond `SIEVE` it lets more through that is not in it, and loses nothing."""
    return min(SIEVE[1], max(SIEVE[0], 1 << max(0, 16 * n - 1).bit_length()))


def sieve(places: DataFrame, size: int) -> np.ndarray:
    """Bytes in which the bits of all places (column k, under `size`) are set; no more rows than size / 64 come to the driver."""
    ones = numbers(places.groupBy(F.floor(F.col("k") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k % 64 as int))")).alias("x")))
    words = np.zeros(size // 64, "<i8")
    words[ones["w"]] = ones["x"]
    return words.view(np.uint8)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_id_text(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def held_out(col: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text is divisible by 5 (a null id counts as an empty text)."""
    return F.crc32(doc_id_text(col)) % 5 == 0


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column end to end, and n + 1 offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]] if len(offsets) else bytes_, offsets - offsets[0]


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """[first, last) rows of at most `most` bytes together, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes: each input bit changes half of the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x
