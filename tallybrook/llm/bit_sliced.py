"""Exact top-k by inner product on a bit-sliced index.

Each component is quantised to floor(scale * x).  A block of rows is indexed as bitmaps:
slice (d, j) holds bit j of component d (less the component's minimum) of every row.
A query's scores are sums of slices weighted by the bits of its own components, added
with bitmap arithmetic: all bitmaps of one weight go through full adders, three to one
plus a carry of the next weight, until one bitmap a weight is left, which are the slices
of the score.  A negative component takes the complement of the slices and a constant.
The top rows come from the slices, most significant first: a slice either fills the
answer with rows or narrows the candidates; what is left at the end are rows with equal
scores, and those of smallest id are taken.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tallybrook.llm.vectors import dimension, top_by_blocks, usable


class SlicedIndex:
    """Bitmaps of a block of integer rows; bit r of a bitmap is row r."""

    def __init__(self, x: np.ndarray):
        self.n, d = x.shape
        self.low = x.min(axis=0)
        up = (x - self.low).astype(np.uint64)
        self.bits = max(1, int(up.max()).bit_length())
        words = -(-self.n // 64)
        self.all = self._packed(np.ones(self.n, dtype=bool), words)
        self.slices = np.zeros((2, d, self.bits, words), dtype=np.uint64)
        for i in range(d):
            for j in range(self.bits):
                plain = self._packed((up[:, i] >> np.uint64(j)) & np.uint64(1) == 1, words)
                self.slices[0, i, j] = plain
                self.slices[1, i, j] = plain ^ self.all

    @staticmethod
    def _packed(bits: np.ndarray, words: int) -> np.ndarray:
        out = np.zeros(words * 8, dtype=np.uint8)
        packed = np.packbits(bits, bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def scores(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the query's inner product with every row, less a constant of the query."""
        size = np.abs(q)
        addends: dict[int, list[tuple[int, int, int]]] = {}
        for i in np.flatnonzero(size).tolist():
            value, sign, b = int(size[i]), int(q[i] < 0), 0
            while value >> b:
                if value >> b & 1:
                    for j in range(self.bits):
                        addends.setdefault(b + j, []).append((sign, i, j))
                b += 1
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        weight = 0
        while weight <= max(addends, default=-1) or carried:
            mine = addends.get(weight, [])
            stack = [self.slices[tuple(np.array(mine).T)]] if mine else []
            pile = np.concatenate([*stack, *carried]) if stack or carried else np.zeros((1, len(self.all)), np.uint64)
            carried = []
            while len(pile) > 2:
                m = len(pile) // 3
                a, b, c = pile[:m], pile[m : 2 * m], pile[2 * m : 3 * m]
                odd = a ^ b
                carried.append((a & b) | (odd & c))
                pile = np.concatenate([odd ^ c, pile[3 * m :]])
            if len(pile) == 2:
                carried.append((pile[0] & pile[1])[None])
                pile = (pile[0] ^ pile[1])[None]
            out.append(pile[0])
            carried = [c for c in carried if c.any()]
            weight += 1
        return out

    def top(self, slices: list[np.ndarray], k: int, allowed: np.ndarray) -> np.ndarray:
        """Rows of the ``k`` largest scores among the allowed; of equal ones at the boundary, the first rows."""
        sure, maybe = np.zeros_like(allowed), allowed
        need = k
        if int(np.bitwise_count(maybe).sum()) > need:
            for s in reversed(slices):
                high = maybe & s
                count = int(np.bitwise_count(high).sum())
                if count >= need:
                    maybe = high
                    if count == need:
                        break
                else:
                    sure = sure | high
                    need -= count
                    maybe = maybe & ~s
        rows = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
        return np.concatenate([rows(sure), rows(maybe)[:need]])


def top_k(frame: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256, block_rows: int = 32_768, block_queries: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score (long) of the ``k`` largest integer inner products of each query with all other ids.

    Queries are the rows whose id is divisible by ``every``; ties go to the smaller id; fewer candidates give fewer
    rows. Rows with a null id, a null or empty vector, a null or non-finite component, or another length than the
    most common one take no part. Rows repeated under one id count once (of different vectors, the smallest).
    Scores must fit 63 bits. Columns other than the two are not read; an empty table gives no rows.
    """
    rows = usable(frame, id_col, vector_col)
    d = dimension(rows)
    rows = rows.filter(f"size(v) = {d}")

    def search(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, q: np.ndarray) -> tuple[list, list, list]:
        whole, asked = np.floor(scale * x).astype(np.int64), np.floor(scale * q).astype(np.int64)
        index = SlicedIndex(whole)
        out: tuple[list, list, list] = ([], [], [])
        for query, vector in zip(queries.tolist(), asked, strict=True):
            allowed = index.all.copy()
            own = int(np.searchsorted(ids, query))
            if own < len(ids) and ids[own] == query:
                allowed[own // 64] &= ~np.uint64(1 << own % 64)
            best = index.top(index.scores(vector), k, allowed)
            scores = whole[best] @ vector
            out[0].extend([query] * len(best))
            out[1].extend(ids[best].tolist())
            out[2].extend(scores.tolist())
        return out

    return top_by_blocks(rows, every, k, max(d, 1), search, "long", block_rows=block_rows, block_queries=block_queries)
