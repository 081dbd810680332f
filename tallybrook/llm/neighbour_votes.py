"""Quality by votes of the nearest labelled documents in a latent-semantic space.

A text's terms are the shapes of its words (runs of capitals, small letters and digits folded to one character each, other bytes
as they are), pairs of neighbouring shapes with what parts them, words that repeat the word before, and the
lower-case words, each hashed into a fixed number of bins.  Bins are weighted by log frequency and by inverse document
frequency over all documents; the first singular vectors of a sample make the latent space.  The labelled vectors, a bounded
sample of them where there are more than ``memory``, go to every task, which multiplies blocks of documents with all of
them.  A document's ``k`` nearest (all that tie with the k-th too) vote with their labels, weighted by a power of
their cosine; a few votes for the overall rate steady documents with distant neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.text import WHITE, blocks, buffer_of, lower_ascii, small_batches, span_hashes, word_spans

#: Bins of shapes, of pairs of shapes, of repeats and of words.
_BINS = (512, 1024, 2, 510)
BINS = sum(_BINS)
_BLOCK = 1 << 20
_ROWS = 256
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")


def term_counts(column: pa.Array) -> np.ndarray:
    """Terms by bin of each text of a block, one row a text."""
    rows = len(column)
    data, offsets = buffer_of(column)
    starts, ends, edges = word_spans(data, offsets)
    row = np.repeat(np.arange(rows), np.diff(edges))
    out = np.zeros(rows * BINS, dtype=np.float32)
    if not len(starts):
        return out.reshape(rows, BINS)
    cls = _SHAPE[data]
    keep = ~WHITE[data]
    keep[1:] &= cls[1:] != cls[:-1]
    keep[starts] = True
    before = np.append(0, np.cumsum(keep))
    shape = span_hashes(cls[keep], before[starts], before[ends])
    word = span_hashes(lower_ascii(data), starts, ends)
    next_to = row[1:] == row[:-1]
    lines = np.append(0, np.cumsum(data == 10))
    broken = (lines[starts[1:]] != lines[ends[:-1]]).astype(np.uint64)
    pair = (shape[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[1:] * np.uint64(0xBF58476D1CE4E5B9) + broken) * np.uint64(0x94D049BB133111EB) >> np.uint64(33)
    same = word[1:] == word[:-1]
    first, second, third = _BINS[0], _BINS[0] + _BINS[1], _BINS[0] + _BINS[1] + _BINS[2]
    spots = [
        row * BINS + (shape >> np.uint64(20)).astype(np.int64) % _BINS[0],
        (row[1:] * BINS + first + pair.astype(np.int64) % _BINS[1])[next_to],
        (row[1:] * BINS + second)[next_to & same],
        (row[1:] * BINS + second + 1)[next_to & ~same],
        row * BINS + third + (word >> np.uint64(20)).astype(np.int64) % _BINS[3],
    ]
    return np.bincount(np.concatenate(spots), minlength=rows * BINS).astype(np.float32).reshape(rows, BINS)


@dataclass
class Space:
    """The latent space: weights of the bins and the directions kept."""

    idf: np.ndarray
    axes: np.ndarray

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of counts; a row without terms is zero."""
        return unit(_weighted(counts, self.idf) @ self.axes)


@dataclass
class Memory:
    """Labelled vectors, their labels, and the rate of label 1."""

    space: Space
    vectors: np.ndarray
    labels: np.ndarray
    rate: float


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log frequencies, weighted, at unit length."""
    return unit(np.log1p(counts) * idf)


def _frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts and, by bin, of texts with a term of it, over all rows; tasks send one row each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(BINS, dtype=np.int64)
        for block in blocks(batches, "text", _BLOCK):
            n += block.num_rows
            df += (term_counts(block.column("text")) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BINS)), pa.array(np.append(n, df))], names=["bin", "n"])

    total = np.zeros(BINS + 1, dtype=np.int64)
    for r in docs.select("text").mapInArrow(task, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        total[r.bin + 1] = r.n
    return int(total[0]), total[1:]


def _counts_of(rows: DataFrame) -> pa.Table:
    """(key, label, bins, counts) of a bounded table."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", _BLOCK):
            counts = term_counts(block.column("text"))
            r, b = np.nonzero(counts)
            bounds = pa.array(np.searchsorted(r, np.arange(block.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, x) for x in (pa.array(b.astype(np.int32)), pa.array(counts[r, b]))]
            yield pa.RecordBatch.from_arrays([block.column("key"), block.column("label"), *lists], names=["key", "label", "bins", "counts"])

    return rows.select("key", "label", "text").mapInArrow(task, "key long, label double, bins array<int>, counts array<float>").toArrow()


def directions(sample: np.ndarray, size: int, *, rounds: int = 12) -> np.ndarray:
    """The sample's first right singular vectors as columns, by subspace iteration from a fixed start."""
    found = np.random.default_rng(5).standard_normal((sample.shape[1], size + 16)).astype(np.float32)
    for _ in range(rounds):
        found, _ = np.linalg.qr(sample.T @ (sample @ found))
    _, _, turn = np.linalg.svd(sample @ found, full_matrices=False)
    return np.ascontiguousarray(found[:, : len(turn)] @ turn.T)[:, :size] if len(turn) == found.shape[1] else np.ascontiguousarray(found[:, :size])


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", memory: int = 16_384, fit: int = 4_096, size: int = 32) -> Memory:
    """The space and the labelled vectors.

    Labels that are 0 or 1 count, those of null ids and of ids without a document don't; of several labels of an id the mean
    counts, and a repeated document counts once for each text. At most ``memory`` labelled ids are kept, those of the smallest hashes,
    and the space's directions are fitted on the first ``fit`` of them: both are the bounds of what is sampled. Document frequencies are
    over all rows of ``docs``. Without labelled documents every score will be 0.5.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    n, df = _frequencies(rows)
    idf = (np.log((1 + n) / (1 + df)) + 0.25).astype(np.float32)
    key = F.xxhash64(F.col("id").cast("string"), F.lit(23))
    given = labels.select(labels[id_col].alias("id"), labels[label_col].cast("double").alias("label")).filter(F.col("label").isin(0.0, 1.0) & F.col("id").isNotNull())
    given = given.groupBy("id").agg(F.avg("label").alias("label"))
    chosen = given.join(rows.select("id"), "id", "left_semi").select("id", "label", key.alias("key")).orderBy("key", "id").limit(memory)
    got = _counts_of(rows.join(F.broadcast(chosen), "id").dropDuplicates(["id", "text"]))
    order = np.argsort(got.column("key").to_numpy(), kind="stable")[:memory]
    sizes = np.diff(got.column("bins").combine_chunks().offsets.to_numpy()) if len(order) else np.zeros(0, int)
    bins = got.column("bins").combine_chunks().flatten().to_numpy() if len(order) else np.zeros(0, np.int32)
    values = got.column("counts").combine_chunks().flatten().to_numpy() if len(order) else np.zeros(0, np.float32)
    begin = np.append(0, np.cumsum(sizes))

    def dense(which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), BINS), dtype=np.float32)
        for x, r in enumerate(which):
            out[x, bins[begin[r] : begin[r + 1]]] = values[begin[r] : begin[r + 1]]
        return out

    sample = _weighted(dense(order[:fit]), idf)
    space = Space(idf, directions(sample, size))
    vectors = [space.place(dense(order[x : x + 1024])) for x in range(0, len(order), 1024)]
    marks = got.column("label").to_numpy()[order].astype(np.float32) if len(order) else np.zeros(0, np.float32)
    return Memory(space, np.concatenate(vectors) if vectors else np.zeros((0, size), np.float32), marks, float(marks.mean()) if len(marks) else 0.5)


def votes(x: np.ndarray, memory: Memory, *, k: int, power: float, steady: float) -> np.ndarray:
    """Scores of unit vectors: the weighted labels of the nearest, computed exactly a block of rows at a time."""
    out = np.full(len(x), memory.rate)
    if not len(memory.labels):
        return out
    for a in range(0, len(x), _ROWS):
        near = np.round(x[a : a + _ROWS] @ memory.vectors.T, 5)
        least = np.partition(near, -k, axis=1)[:, -k] if k < near.shape[1] else near.min(axis=1)
        r, c = np.nonzero(near >= np.maximum(least, 1e-5)[:, None])
        weight = near[r, c].astype(np.float64) ** power
        yes = np.bincount(r, weights=weight * memory.labels[c], minlength=len(near))
        every = np.bincount(r, weights=weight, minlength=len(near))
        out[a : a + _ROWS] = (yes + steady * memory.rate) / (every + steady)
    return out


def score(docs: DataFrame, memory: Memory, *, id_col: str = "doc_id", text_col: str = "text", k: int = 25, power: float = 2.0, steady: float = 0.5) -> DataFrame:
    """Per row: the id and score (0 to 1, higher: label 1 likelier), from the whole text alone.

    A null or empty text, or one of white space only, has no neighbours and gets the rate of label 1 among the labelled. Rows are kept
    as they are, with null and repeated ids; equal texts get equal scores (cosines are rounded to 5 places, and all that tie
    with the k-th neighbour vote). An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(memory)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", _BLOCK):
            for a in range(0, block.num_rows, 2048):
                part = block.slice(a, 2048)
                found = votes(sent.value.space.place(term_counts(part.column("text"))), sent.value, k=k, power=power, steady=steady)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(found, 0.0, 1.0))], names=["id", "score"])

    small_batches(spark)
    kind = docs.select(docs[id_col]).schema[0].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(task, f"id {kind}, score double").select(F.col("id").alias(id_col), "score")
