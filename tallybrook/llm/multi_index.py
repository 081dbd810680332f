"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Largest inner product becomes smallest angle by one more component that brings every
row to the largest norm (0 for queries).  Codes are signs after rotations learned by
iterative quantisation (alternating signs and the orthogonal Procrustes solution) on a
bounded sample; several rotations fill the code when vectors are short.  A code is cut
into 16-bit substrings and each block of rows keeps, for each substring, a table from its
values to their rows.  Two codes within radius r agree up to floor(r / m) bits in some
substring of m (pigeonhole, with the remainder shared out), so looking up
the values within that distance retrieves every code within the radius; those that are
really within it are ranked by the exact inner product of the original vectors.

The radius holds a stated share of the nearest rows that some sampled queries have in the
whole table, so it is as small as the table's structure allows.  A query with fewer than k
codes within the radius in all blocks is compared with every code in a second round and gets
those of each block that are nearest, so nobody is left short.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.text import ranges, small_batches, stored
from tallybrook.llm.vectors import dimension, distinct_rows, matrix, top_by_blocks, usable

_POPCOUNT = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))
#: All 16-bit masks by number of bits, and how many have at most so many.
_MASKS = np.argsort(_POPCOUNT, kind="stable").astype(np.uint16)
_UP_TO = np.cumsum(np.bincount(_POPCOUNT))

#: A matrix product differs from the sum of a row's products by less than this, for vectors of norm 1.
_ROUNDING = 1e-12


@dataclass
class Coder:
    """Rotations (one matrix), the norm that rows are brought to, and the search radius."""

    turn: np.ndarray
    norm: float
    radius: int = 0

    def rows(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0.0))
        return self._codes(np.column_stack([x, extra]))

    def queries(self, q: np.ndarray) -> np.ndarray:
        return self._codes(np.column_stack([q, np.zeros(len(q))]))

    def _codes(self, x: np.ndarray) -> np.ndarray:
        """Codes as 16-bit substrings, one column each."""
        return np.packbits(x @ self.turn > 0, axis=1).view(np.uint16)


def fit(sample: np.ndarray, norm: float, *, bits: int, seed: int = 0, steps: int = 30) -> Coder:
    """Learn the rotations on a sample of rows."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([sample, np.sqrt(np.maximum(norm**2 - (sample * sample).sum(axis=1), 0.0))])
    d = x.shape[1]
    _, basis = np.linalg.eigh(x.T @ x)
    turns: list[np.ndarray] = []
    while sum(t.shape[1] for t in turns) < bits:
        width = min(d, bits)
        base = basis[:, ::-1][:, :width]
        v = x @ base
        r, _ = np.linalg.qr(rng.standard_normal((width, width)))
        for _ in range(steps):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        turns.append(base @ r)
    return Coder(np.column_stack(turns)[:, :bits], norm)


def radius_of(rows: DataFrame, coder: Coder, ids: np.ndarray, queries: np.ndarray, *, k: int, target: float, block_rows: int = 8_192) -> int:
    """The radius that holds ``target`` of the asked queries' ``k`` nearest rows, which are found exactly in one pass over
    the whole table: each task keeps ``k`` rows a query, so the radius follows how near neighbours really are."""
    d, codes = queries.shape[1], coder.queries(queries)

    def task(batches):
        held = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(ids)
        for batch in batches:
            for a in range(0, batch.num_rows, block_rows):
                part = batch.slice(a, block_rows)
                x, own = matrix(part.column("v"), d), part.column("id").to_numpy()
                scores, mine = queries @ x.T, coder.rows(x)
                scores[ids[:, None] == own[None, :]] = -np.inf
                for i in range(len(ids)):
                    few = np.argpartition(-scores[i], min(k, len(own)) - 1)[:k]
                    few = few[scores[i][few] > -np.inf]
                    value = np.append(held[i][0], scores[i][few])
                    apart = np.append(held[i][1], _POPCOUNT[mine[few] ^ codes[i]].sum(axis=1, dtype=np.int64))
                    best = np.argsort(-value, kind="stable")[:k]
                    held[i] = (value[best], apart[best])
        q = np.repeat(np.arange(len(ids)), [len(h[0]) for h in held])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([h[0] for h in held])), pa.array(np.concatenate([h[1] for h in held]))], names=["q", "score", "apart"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "apart"))
    found = rows.select("id", "v").mapInArrow(task, "q long, score double, apart long").withColumn("rank", rank).filter(F.col("rank") <= k).select("apart").toArrow()
    return int(np.quantile(found.column("apart").to_numpy(), target, method="higher")) if found.num_rows else coder.turn.shape[1]


class MultiIndex:
    """For each substring: rows in order of its value, and where each value's rows begin."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.wide = np.ascontiguousarray(codes).view(np.uint64)
        self.orders = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(codes[:, j], minlength=1 << 16))]) for j in range(codes.shape[1])]
        self.values = [np.flatnonzero(np.diff(s)).astype(np.uint16) for s in self.starts]
        self.probed = 0

    def probes(self, j: int, value: np.uint16, reach: int) -> np.ndarray:
        """Values of substring j within ``reach`` bits: each is looked up, unless fewer values than that occur at all."""
        if reach < 0:
            return self.values[j][:0]
        if _UP_TO[min(reach, 16)] <= len(self.values[j]):
            return value ^ _MASKS[: _UP_TO[min(reach, 16)]]
        return self.values[j][_POPCOUNT[self.values[j] ^ value] <= reach]

    def distance(self, rows: np.ndarray | slice, code: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.wide[rows] ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius: probe each substring, then check whole codes."""
        m = len(self.orders)
        near, share = divmod(radius, m)
        hit = np.zeros(len(self.codes), dtype=bool)
        for j in range(m):
            probed = self.probes(j, code[j], near if j <= share else near - 1).astype(np.int64)
            first, lengths = self.starts[j][probed], self.starts[j][probed + 1] - self.starts[j][probed]
            hit[self.orders[j][ranges(first, lengths)]] = True
        rows = np.flatnonzero(hit)
        self.probed += len(rows)
        return rows[self.distance(rows, code) <= radius]


def neighbours(frame: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, bits: int = 256, target: float = 0.98, sample_rows: int = 8192, sample_queries: int = 256, block_rows: int = 16_384, block_queries: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score (double) of the ``k`` largest inner products found for each query among all other ids.

    Queries are the rows whose id is divisible by ``every``; ties go to the smaller id; fewer candidates give fewer
    rows. The rotations are fitted on at most ``sample_rows`` rows (those of smallest id hash), the radius on the nearest rows that
    ``sample_queries`` of them have in the whole table; every row is indexed. Queries that find fewer than ``k`` rows within the
    radius are compared with every code.
    Rows with a null id, a null, empty or zero vector, a null or non-finite component, or another length than the most
    common one take no part. Rows repeated under one id count once (of different vectors, the smallest). Columns
    other than the two are not read; an empty table gives no rows.
    """
    if bits % 64:
        raise ValueError("bits must be a multiple of 64")
    small_batches(frame.sparkSession)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = usable(frame, id_col, vector_col).withColumn("norm", norm).filter("norm > 0")
    d = dimension(rows)
    rows = rows.filter(f"size(v) = {d}")
    longest = rows.agg(F.max("norm")).first()[0]
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow() if d else None
    coder = fit(matrix(sample.column("v"), d), float(np.sqrt(longest)), bits=bits) if d else None
    if coder is not None:
        ids, first = distinct_rows(sample.column("id").to_numpy(), matrix(sample.column("v"), d))
        ask = np.random.default_rng(1).permutation(len(ids))[:sample_queries]
        coder.radius = radius_of(rows, coder, ids[ask], first[ask], k=k, target=target)
    total = rows.count() if d else 0

    def search(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, q: np.ndarray, radius: int | None = None) -> tuple[list, list, list]:
        index = MultiIndex(coder.rows(x))
        codes = coder.queries(q)
        out: tuple[list, list, list] = ([], [], [])
        for query, vector, code in zip(queries.tolist(), q, codes, strict=True):
            if radius is None:
                near = index.within(code, coder.radius)
                near = near[ids[near] != query]
            else:  # so many of the nearest codes, however far
                far = index.distance(slice(None), code)
                far[ids == query] = np.iinfo(np.int64).max
                others = len(ids) - int((ids == query).any())
                near = np.flatnonzero(far <= np.partition(far, min(radius, others) - 1)[min(radius, others) - 1]) if others else np.zeros(0, dtype=np.int64)
            if len(near) > 4 * k:
                rough = x[near] @ vector
                near = near[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - _ROUNDING * coder.norm**2]
            scores = (x[near] * vector).sum(axis=1)  # row by row, so equal rows have equal scores in every block
            best = np.lexsort((ids[near], -scores))[:k]
            out[0].extend([query] * len(best))
            out[1].extend(ids[near[best]].tolist())
            out[2].extend(scores[best].tolist())
        return out

    blocks = {"block_rows": block_rows, "block_queries": block_queries}
    found = top_by_blocks(rows.select("id", "v"), every, k, max(d, 1), search, "double", **blocks)
    if not d or total <= 1:
        return found
    found = stored(found, "neighbours")
    asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    short = stored(asked.join(found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id")), "id", "left_anti"), "short")
    if short.isEmpty():
        return found
    rest = top_by_blocks(rows.select("id", "v"), every, k, d, functools.partial(search, radius=4 * k), "double", asked=short, **blocks)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(*found.columns).unionByName(rest)
