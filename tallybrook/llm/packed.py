"""64-bit keys in packed form: arrays as compressed bytes, counts of keys that travel as differences of sorted parts, bitmaps.

Keys are hashes.  Their first bits part them into ranges; within a range, sorted keys lie close together, so that a
difference takes less than six bytes.  A range is counted by one group, which holds some ``_RANGE`` keys
whatever their number; a key that is met often comes once a part only, as parts are combined before they travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallybrook.llm.text import mix

FLUSH = 1_000_000
_RANGE = 1 << 19
_LEAST_BITS, BITS, MOST_BITS = 16, 26, 28
_SLICES = 6


def distinct(keys: np.ndarray) -> np.ndarray:
    """The keys in order, each once; sorting is several times faster than the hash table behind ``np.unique``."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]


def pack(x: np.ndarray) -> bytes:
    """An array's bytes, those of one place of all numbers together, compressed."""
    return pa.compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unpack(packed: pa.Scalar | bytes, n: int, kind: type) -> np.ndarray:
    """The array of ``n`` numbers that ``pack`` was given."""
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(packed if isinstance(packed, bytes) else packed.as_buffer(), decompressed_size=n * width, codec="zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, n).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Keys in order, as differences."""
    return pack(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def unpack_keys(packed: pa.Scalar | bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(packed, n, np.uint64), dtype=np.uint64)


def ranges_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of keys in order: the ranges (the first ``bits`` bits) that have any, and where they begin and the last ends."""
    at = (keys >> np.uint64(64 - bits)).astype(np.int32)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    return at[first], np.append(first, len(keys))


def range_bits(rows: int) -> int:
    """Bits that part so many keys into ranges of some ``_RANGE`` each."""
    return max(3, min(24, (rows // _RANGE).bit_length()))


def _summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Identities in order, their key columns and their counts, of parts of the same form."""
    ident, *columns, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(ident)
    ident = ident[order]
    first = np.flatnonzero(np.append(True, ident[1:] != ident[:-1])[: len(ident)])
    return [ident[first], *(c[order[first]] for c in columns), np.add.reduceat(counts[order], first) if len(first) else counts]


def _once(keys: np.ndarray) -> list[np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return [keys[first], np.diff(np.append(first, len(keys)))]


def combined(made: Callable, out: Callable, flush: int) -> Callable:
    """A task that counts what ``made`` gives of its batches, arrays of identities and key columns, and puts out parts by ``out``: the
    identities in order, the key columns, the counts. What is met is gathered and sorted once a part."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        new: list[list[np.ndarray]] = []
        size = 0

        def merged() -> list[np.ndarray]:
            if new:
                ident, *columns = (np.concatenate(c) for c in zip(*new, strict=True))
                new.clear()
                parts.append(_summed([[ident, *columns, np.ones(len(ident), np.int64)]]) if columns else _once(ident))
            return parts[0] if len(parts) == 1 else _summed(parts)

        for arrays in made(batches):
            new.append(arrays)
            size += len(arrays[0])
            if size > flush:
                parts = [merged()]
                size = len(parts[0][0])
                if size > flush // 2:
                    yield out(parts[0])
                    parts, size = [], 0
        if parts or new:
            yield out(merged())

    return task


def tallied(rows: DataFrame, made: Callable, support: int, expected: int, names: tuple[str, ...] = (), ident: Callable | None = None) -> DataFrame:
    """(k, c): the keys that ``made`` gives of the rows' batches at least ``support`` times, and how often. Keys travel in packed
    parts by ranges, and a range's parts are counted together; ``expected`` bounds the number of keys. With ``names`` the key
    columns that ``made`` gives beside each key stand in its place; ``ident`` makes the key of them again."""
    columns = names or ("k",)

    def merge(parts: pa.Table) -> pa.Table:
        keys, *found, counts = _together(parts, names, ident)
        kept = counts >= support
        return pa.table([*(pa.array(c[kept].view(np.int64)) for c in found or [keys]), pa.array(counts[kept])], names=[*columns, "c"])

    return _parted(rows, made, range_bits(expected), names).groupBy("b").applyInArrow(merge, "".join(f"{c} long, " for c in columns) + "c long")


def bitmap_of_tallied(rows: DataFrame, made: Callable, support: int, expected: int, size: int = BITS) -> np.ndarray:
    """The bitmap of the keys that ``tallied`` gives. Each range makes its own part, so the keys themselves go nowhere."""
    bits = min(range_bits(expected), size - 6)

    def merge(parts: pa.Table) -> pa.Table:
        keys, counts = _together(parts, (), None)
        return _slice(parts.column("b")[0].as_py(), keys[counts >= support], size, bits)

    return _gathered(_parted(rows, made, bits, ()).groupBy("b").applyInArrow(merge, "b int, bits binary"), size, bits)


def _parted(rows: DataFrame, made: Callable, bits: int, names: tuple[str, ...]) -> DataFrame:
    """Packed parts (b, n, keys or the named key columns, c) by range."""

    def out(part: list[np.ndarray]) -> pa.RecordBatch:
        keys, *columns, counts = part
        at, cuts = ranges_of(keys, bits)
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        sent = [[pack(c[a:b]) for a, b in spans] for c in columns] or [[pack_keys(keys[a:b]) for a, b in spans]]
        sent.append([pack(counts[a:b]) for a, b in spans])
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.diff(cuts)), *(pa.array(x, pa.binary()) for x in sent)], names=["b", "n", *(names or "k"), "c"])

    sent = "".join(f"{c} binary, " for c in names or "k")
    return rows.mapInArrow(combined(made, out, FLUSH // max(1, len(names))), f"b int, n long, {sent}c binary")


def _together(parts: pa.Table, names: tuple[str, ...], ident: Callable | None) -> list[np.ndarray]:
    """Keys of one range's parts in order, each once, the named key columns and the counts."""
    n = parts.column("n").to_pylist()
    columns = [np.concatenate([unpack(x, m, np.uint64) for x, m in zip(parts.column(name), n, strict=True)]) for name in names]
    keys = ident(*columns) if names else np.concatenate([unpack_keys(x, m) for x, m in zip(parts.column("k"), n, strict=True)])
    return _summed([[keys, *columns, np.concatenate([unpack(x, m, np.int64) for x, m in zip(parts.column("c"), n, strict=True)])]])


def _slice(at: int, keys: np.ndarray, size: int, bits: int) -> pa.Table:
    """(b, bits): what range ``at`` has of a bitmap of 2^``size`` bits."""
    flags = np.zeros(1 << (size - bits), dtype=bool)
    flags[(keys << np.uint64(bits)) >> np.uint64(64 - size + bits)] = True
    return pa.table([pa.array([at], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["b", "bits"])


def _gathered(found: DataFrame, size: int, bits: int) -> np.ndarray:
    out = np.zeros((1 << bits, 1 << (size - bits - 6)), dtype="<u8")
    got = found.toArrow()  # 2^size bits at most, whatever the input
    for at, part in zip(got.column("b").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[at] = np.frombuffer(part, "<u8")
    return out.ravel()


def bits_for(keys: int) -> int:
    """Bits, as a power of two, for so many keys: eight or more a key, 2^28 at most."""
    return min(MOST_BITS, max(_LEAST_BITS, (8 * keys).bit_length()))


def bitmap(keys: DataFrame, size: int = BITS, *, hashed: bool = True) -> np.ndarray:
    """2^``size`` bits, those set that stand for one of the keys (column k); keys that aren't ``hashed`` are scrambled first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        rows = 0

        def out() -> pa.RecordBatch:
            found = distinct(np.concatenate(parts))
            at, cuts = ranges_of(found, _SLICES)
            packed = [pack_keys(found[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.diff(cuts)), pa.array(packed, pa.binary())], names=["b", "n", "k"])

        for batch in batches:
            k = batch.column("k").to_numpy().view(np.uint64)
            parts.append((k if hashed else mix(k)) >> np.uint64(64 - size) << np.uint64(64 - size))
            rows += len(k)
            if rows > FLUSH:
                yield out()
                parts, rows = [], 0
        if rows:
            yield out()

    def merge(parts: pa.Table) -> pa.Table:
        found = [unpack_keys(packed, n) for packed, n in zip(parts.column("k"), parts.column("n").to_pylist(), strict=True)]
        return _slice(parts.column("b")[0].as_py(), np.concatenate(found), size, _SLICES)

    packed = keys.select("k").mapInArrow(task, "b int, n long, k binary")
    return _gathered(packed.groupBy("b").applyInArrow(merge, "b int, bits binary"), size, _SLICES)


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where the bitmap doesn't prove the key absent."""
    at = keys >> np.uint64(64 - (len(bits).bit_length() + 5))
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
