"""Array helpers shared by the text operators: Arrow string columns as flat byte
buffers, word spans, 64-bit hashes of spans, and the shared scratch folder.

Everything here works on one block of rows inside a task; a block holds at most
``BLOCK_BYTES`` of text unless a single text is longer.
"""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
#: Arrow batches sent to Python workers hold about so many bytes; Spark's own default is 64 MB, which several workers can't afford.
BATCH_BYTES = 4 << 20

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_RADIX = 0x5851F42D4C957F2D
_RADIX_INVERSE = pow(_RADIX, -1, 1 << 64)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: The first n bytes of eight, for n of 0 to 8.
_SHORT = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)

_powers: dict[str, np.ndarray] = {}


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding at most ``limit`` bytes of ``column`` each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffer_of(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and row offsets into them; a null row is empty."""
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z made lower case and nothing else changed."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word [^\\x20\\x09-\\x0D]+, and the index of the first word of each row (rows + 1 values);
    ``white`` marks other bytes to part words at."""
    solid = ~white[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        full = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        full[0] = 1
        have = np.multiply.accumulate(full)
        if n <= 2 * BLOCK_BYTES:
            _powers[name] = have
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the bytes, from which ``hash_between`` gets the hash of any span."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _RADIX, n), out=total[1:])
    return total


def hash_between(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes; equal bytes give equal hashes wherever they stand."""
    value = (total[ends] - total[starts]) * _power("down", _RADIX_INVERSE, len(total))[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _GOLD)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``hash_between`` over the data."""
    return hash_between(prefix_sums(data), starts, ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes (spans aren't empty): every eight bytes are scrambled with a key of their place in
    the span before they are summed, so words that differ by a pattern, which a polynomial can map to one value, stay apart."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    padded = np.append(data, np.zeros(8, dtype=np.uint8))
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    total = mix(eights[starts] & _SHORT[np.minimum(lengths, 8)] ^ mix(np.full(1, _M1)))
    long = np.flatnonzero(lengths > 8)
    if len(long):  # the lanes after the first
        lanes = (lengths[long] - 1) >> 3
        first = np.cumsum(lanes) - lanes
        lane = np.arange(1, int(lanes.sum()) + 1) - np.repeat(first, lanes)
        at = np.repeat(starts[long], lanes) + 8 * lane
        value = eights[at] & _SHORT[np.minimum(np.repeat(ends[long], lanes) - at, 8)]
        total[long] += np.add.reduceat(mix(value ^ mix(lane.astype(np.uint64) * _GOLD + _M1)), first)
    return mix(total + lengths.astype(np.uint64) * _GOLD)


def spans_as_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as one Arrow string array (bytes between spans are dropped)."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[ranges(starts, lengths)])))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def fold(column: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """True where crc32 of the id's decimal text leaves remainder ``part``; a null id is never in the fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts == part, F.lit(False))


def in_fold(value: int, parts: int, part: int) -> bool:
    """The same rule as ``fold`` for one Python integer."""
    return zlib.crc32(str(value).encode()) % parts == part


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's tasks, unless a smaller bound is set already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary
    folder if all of Spark runs on this machine, else a folder of the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        alone = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        base = _own_folder() if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def stored(frame: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """The frame written as Parquet to the shared folder and read back: cuts lineage and survives lost executors.
    ``made`` collects the paths, for ``discard``."""
    spark = frame.sparkSession
    path = scratch(spark, name)
    frame.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove scratch tables that nothing reads any more, through Spark's file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    paths.clear()


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage: Spark removes the shuffle files of finished queries only then. A plan hangs on
    references of two kinds, so one collection isn't enough."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
