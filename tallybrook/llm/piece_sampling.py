"""Sampled SentencePiece segmentations: forward filtering, backward sampling.

A text is read as bytes with one space before it (the library's dummy prefix).  The
lattice has an edge for every vocabulary piece that matches, and single-byte edges
(the byte pieces) for characters that no one-character piece covers.  No piece holds
a space after another character, so the lattice falls apart at every space that
follows a non-space, and the segments between are sampled independently: that is
the same distribution as over the whole text.

Forward filtering runs once per distinct segment of a block, a slice of segments at a time
by position; backward sampling runs for all occurrences at once, each draw from a
counter hash of (seed, row key, segment number, step).  So a row's pieces depend on
its key and text alone, not on partitions or neighbours.

Weights: P(piece) is proportional to (rank + 10) ** -theta, rank being the piece's
place in the vocabulary (a BPE model's scores are ranks); a larger theta is closer to
the best segmentation.  Decoding joins the pieces' bytes and drops the first space.
It is lossless for every text: spaces, control characters and a literal U+2581 too,
which is written with byte pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.text import blocks, buffer_of, hash_between, mix, prefix_sums, ranges, small_batches, span_hashes

_SPACE_MARK = "▁"
_FIRST_BYTE = 3
_BLOCK = 2 << 20
#: Distinct segments are filtered in slices of so many bytes: their edges are what takes memory.
_SLICE = 128 << 10
_lattices: dict[tuple[str, float], "Vocabulary"] = {}

_K1 = np.uint64(0xD6E8FEB86659FD93)
_K2 = np.uint64(0xA0761D6478BD642F)


@dataclass
class Vocabulary:
    """Piece bytes by id, and a hash table of the pieces by length."""

    path: str
    theta: float

    def __post_init__(self) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        size = model.get_piece_size()
        self.pieces: list[bytes] = [b""] * size
        usable = []
        for i in range(size):
            if model.is_byte(i):
                self.pieces[i] = bytes([i - _FIRST_BYTE])
                if model.id_to_piece(i) != f"<0x{i - _FIRST_BYTE:02X}>":
                    raise ValueError("byte pieces are expected in order from id 3")
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.pieces[i] = model.id_to_piece(i).replace(_SPACE_MARK, " ").encode()
                usable.append(i)
        if any(b" " in self.pieces[i].lstrip(b" ") for i in usable):
            raise ValueError("a piece holds a space after another character")
        lengths = np.array([len(p) for p in self.pieces])
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(self.pieces), dtype=np.uint8)
        self.log_weight = -self.theta * np.log(np.arange(size) + 10.0)
        self.log_weight[_FIRST_BYTE : _FIRST_BYTE + 256] = -self.theta * np.log(size + 10.0)
        ids = np.array(usable)
        keys = span_hashes(self.bytes, self.starts[ids], self.starts[ids] + lengths[ids])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.by_length = sorted({int(n) for n in lengths[ids]})
        bits = 20
        self.shift = np.uint64(64 - bits)
        slot = (self.keys >> self.shift).astype(np.int64)
        self.slots = np.searchsorted(slot, np.arange((1 << bits) + 1))
        self.crowd = int(np.diff(self.slots).max())

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 if none."""
        slot = (keys >> self.shift).astype(np.int64)
        at, end = self.slots[slot], self.slots[slot + 1]
        found = np.full(len(keys), -1, dtype=np.int64)
        live = np.flatnonzero(at < end)
        for step in range(self.crowd):
            if not len(live):
                break
            where = at[live] + step
            hit = self.keys[where] == keys[live]
            found[live[hit]] = self.ids[where[hit]]
            live = live[~hit & (where + 1 < end[live])]
        return found

    def edges(self, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, id) of the lattice of segments ``data[first:end]`` that fill the data."""
        n = len(data)
        limit = np.repeat(end, end - first)
        lead = (data & 0xC0) != 0x80
        width = np.select([data < 0x80, data < 0xE0, data < 0xF0], [1, 2, 3], 4)
        place, total = np.flatnonzero(lead), prefix_sums(data)
        out, single = [], np.zeros(n + 1, dtype=bool)
        for length in self.by_length:
            place = place[place + length <= limit[place]]
            if not len(place):
                break
            ids = self.lookup(hash_between(total, place, place + length))
            got = ids >= 0
            at = place[got]
            out.append((at, at + length, ids[got]))
            single[at[width[at] == length]] = True
        lonely = np.flatnonzero(lead & ~single[:n])
        spots = ranges(lonely, np.minimum(width[lonely], limit[lonely] - lonely))
        out.append((spots, spots + 1, data[spots].astype(np.int64) + _FIRST_BYTE))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _vocabulary(path: str, theta: float) -> Vocabulary:
    if (path, theta) not in _lattices:
        _lattices[path, theta] = Vocabulary(path, theta)
    return _lattices[path, theta]


def _filtered(vocab: Vocabulary, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges sorted by where they end, as (from, id, key): key is the end plus the cumulative chance of
    the edges that end there, by forward filtering, so a uniform draw finds its edge by one search."""
    a, b, ids = vocab.edges(data, first, end)
    origin = np.repeat(first, end - first)
    depth = b - origin[a]
    order = np.argsort(depth << 37 | b << 6 | b - a)
    a, b, ids, depth = a[order], b[order], ids[order], depth[order]
    weight = vocab.log_weight[ids]
    alpha = np.zeros(len(data) + 1)  # an end of one segment is the first place of the next, which is never read
    fresh = np.append(True, b[1:] != b[:-1])
    share = np.empty(len(a))
    cuts = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo == hi:
            continue
        value = np.where(a[lo:hi] == origin[a[lo:hi]], 0.0, alpha[a[lo:hi]]) + weight[lo:hi]
        heads = np.flatnonzero(fresh[lo:hi])
        sizes = np.diff(np.append(heads, hi - lo))
        top = np.maximum.reduceat(value, heads)
        part = np.exp(value - np.repeat(top, sizes))
        sums = np.add.reduceat(part, heads)
        alpha[b[lo:hi][heads]] = top + np.log(sums)
        running = np.cumsum(part)
        share[lo:hi] = (running - np.repeat(running[heads] - part[heads], sizes)) / np.repeat(sums, sizes)
    by_end = np.argsort(b << 6 | b - a)
    a, b, ids, share = a[by_end], b[by_end], ids[by_end], share[by_end]
    last = np.append(b[1:] != b[:-1], True)
    share[last] = 1.0
    return a, ids, b + np.minimum(share, 1.0) - 1.0


def _draws(seed: int, keys: np.ndarray, number: np.ndarray, step: int) -> np.ndarray:
    """Uniform values in (0, 1) from (seed, row key, segment number, step)."""
    x = mix(keys ^ (number.astype(np.uint64) * _K1) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52


def _segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of segments: rows' first bytes, and spaces that follow a non-space."""
    space = data == 0x20
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def encode_block(vocab: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, one row after the other, and row offsets into them. Rows begin with the prefix space."""
    starts = _segments(data, offsets)
    rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint16), np.zeros(rows + 1, np.int64)
    bounds = np.append(starts, len(data)).astype(np.int32)
    kinds = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    table, bound = buffer_of(kinds.dictionary)
    kind = kinds.indices.to_numpy().astype(np.int64)
    edges = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(rows), np.diff(edges))
    number = np.arange(len(starts)) - edges[row]
    key = keys[row]
    order = np.argsort(kind)  # equal segments side by side: the searches then walk a slice's edges in order
    drawn: list[tuple[int, np.ndarray, np.ndarray]] = []
    taken = np.zeros(len(starts), dtype=np.int64)
    low = 0
    while low < len(bound) - 1:
        high = max(low + 1, int(np.searchsorted(bound, bound[low] + _SLICE, side="right")) - 1)
        first, end = bound[low:high] - bound[low], bound[low + 1 : high + 1] - bound[low]
        came, ids, search = _filtered(vocab, table[bound[low] : bound[high]], first, end)
        live, step = order[np.searchsorted(kind, low, sorter=order) : np.searchsorted(kind, high, sorter=order)], 0
        at, stop = end[kind[live] - low], first[kind[live] - low]
        while len(live):
            u = _draws(seed, key[live], number[live], step)
            edge = np.searchsorted(search, at + u - 1.0, side="left")
            drawn.append((step, live, ids[edge].astype(np.uint16)))
            taken[live] += 1
            at = came[edge]
            more = at > stop
            live, at, stop, step = live[more], at[more], stop[more], step + 1
        low = high
    after = np.cumsum(taken)
    out = np.empty(int(after[-1]), dtype=np.uint16)
    for back, who, what in drawn:
        out[after[who] - 1 - back] = what
    return out, np.concatenate([[0], after])[edges]


def decode_block(vocab: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Bytes of the pieces, joined."""
    return vocab.bytes[ranges(vocab.starts[ids], vocab.lengths[ids])]


def _with_prefix(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col]
    return docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col].cast("string")).alias("key"), F.when(text.isNotNull(), F.concat(F.lit(" "), text)).alias("text"))


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, theta: float = 1.0) -> DataFrame:
    """Per row: id, pieces (array of piece ids). A null text has null pieces, an empty one the lone space piece
    that the prefix gives. Repeated rows get equal pieces; a null id is a key like any other.
    ``model`` is the path of a SentencePiece file with byte fallback, readable on every executor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(model, theta)
        for block in blocks(batches, "text", _BLOCK):
            data, offsets = buffer_of(block.column("text"))
            ids, at = encode_block(vocab, data, offsets, _row_keys(block), seed)
            mask = block.column("text").is_null()
            pieces = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=mask if mask.true_count else None)
            yield pa.RecordBatch.from_arrays([block.column("id"), pieces], names=[id_col, "pieces"])

    small_batches(docs.sparkSession)
    rows = _with_prefix(docs, id_col, text_col)
    return rows.mapInArrow(task, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, pieces array<int>")


def _row_keys(block: pa.RecordBatch) -> np.ndarray:
    return mix(block.column("key").to_numpy().view(np.uint64) * _K2)


def decode(encoded: DataFrame, model: str, *, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, text (null for null pieces)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(model, 1.0)
        for batch in batches:
            texts = [None if p is None else decode_block(vocab, np.array(p, dtype=np.int64)).tobytes()[1:].decode() for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string())], names=[id_col, "text"])

    small_batches(encoded.sparkSession)
    rows = encoded.select(id_col, "pieces")
    return rows.mapInArrow(task, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, theta: float = 1.0) -> DataFrame:
    """Encode and decode in one pass, keeping digests instead of the ids: id, n_pieces (long, null for a null text),
    pieces_sha256 (of the ids as little-endian 16-bit numbers), text_sha256 (of the decoded text), lossless.

    ``lossless`` compares the decoded bytes with the input's; it is null for a null text.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(model, theta)
        for block in blocks(batches, "text", _BLOCK):
            data, offsets = buffer_of(block.column("text"))
            ids, at = encode_block(vocab, data, offsets, _row_keys(block), seed)
            plain = decode_block(vocab, ids)
            sizes = np.concatenate([[0], np.cumsum(vocab.lengths[ids])])[at]
            null = block.column("text").is_null().to_numpy(zero_copy_only=False)
            counts, digests, texts, same = [], [], [], []
            for r in range(block.num_rows):
                if null[r]:
                    counts.append(None), digests.append(None), texts.append(None), same.append(None)
                    continue
                whole = plain[sizes[r] : sizes[r + 1]]
                counts.append(int(at[r + 1] - at[r]))
                digests.append(hashlib.sha256(ids[at[r] : at[r + 1]].astype("<u2").tobytes()).hexdigest())
                texts.append(hashlib.sha256(whole[1:].tobytes()).hexdigest())
                same.append(bool(np.array_equal(whole, data[offsets[r] : offsets[r + 1]])))
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(same, pa.bool_())], names=[id_col, "n_pieces", "pieces_sha256", "text_sha256", "lossless"])

    small_batches(docs.sparkSession)
    rows = _with_prefix(docs, id_col, text_col)
    return rows.mapInArrow(task, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_pieces long, pieces_sha256 string, text_sha256 string, lossless boolean")
