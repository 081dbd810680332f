"""Periodic runs of words by a sparse diagonal recurrence over lags.

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and
``times`` periods long, that neither neighbour extends.  On the diagonal of lag q the match length at
word i is one more than at word i - 1 if word i equals word i - q, else 0; a run of period q is a diagonal
that reaches (times - 1) * q matches.  Only diagonals that can get there are kept active, and of a
word's earlier occurrences only the nearest one per band of lags is looked at:

Take lags in [L, 2L).  A run of such a period holds at least 3L matches in a row, so it is enough to match a
word together with the 3L - 1 words after it.  If that stretch u of 3L words also occurred at a smaller
lag p, two cases arise.  p < L: u has periods p and q with p + q <= 3L, so (Fine and Wilf) it has their common
divisor as a period; u is longer than q, so the whole run has it, and q isn't its smallest period.
L <= p < q: two occurrences lie q - p < L apart, which is the first case again.  So within a run of smallest period q the nearest
earlier occurrence of u is exactly q back, and the diagonal of lag q is the stretch of words whose nearest lag is q.
Each band costs one look at each word that still repeats, and bands double: n words cost n log n steps
however often a word occurs, and no pair of occurrences is ever listed.

Stretches are compared by names given to pairs of names (2L from L and L), which are exact, no hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.text import blocks, buffer_of, ranges, small_batches, spans_as_strings, word_spans

_JOIN_WORDS = 1 << 16
RUNS_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _named(keys: np.ndarray) -> np.ndarray:
    """Equal keys get equal names from 0 on; a key that occurs once gets -1, as nothing can repeat through it."""
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    names = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)
    return names[which]


def diagonals(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, *, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run, in words of the block; ``doc`` is each word's row, ``ends`` that row's end."""
    n = len(words)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    name = _named(doc * (int(words.max(initial=0)) + 1) + words)
    longest = int(np.bincount(doc).max(initial=0)) if n else 0
    span = 1
    while times * span <= longest and (name >= 0).any():
        live = np.flatnonzero(name >= 0)
        live = live[live + 2 * span <= ends[live]]
        live = live[name[live + span] >= 0]
        two = np.full(n, -1, dtype=np.int64)
        if len(live):
            two[live] = _named(name[live] * n + name[live + span])
        at = live[two[live] >= 0]
        at = at[at + 3 * span <= ends[at]]
        at = at[name[at + 2 * span] >= 0]
        key = two[at] * n + name[at + 2 * span]
        order = np.argsort(key, kind="stable")
        here, key = at[order], key[order]
        lag = np.zeros(len(here), dtype=np.int64)
        lag[1:] = np.where(key[1:] == key[:-1], here[1:] - here[:-1], 0)
        near = (lag >= span) & (lag < 2 * span)
        here, lag = here[near], lag[near]
        order = np.argsort(here)
        here, lag = here[order], lag[order]
        if len(here):
            fresh = np.append(True, (here[1:] != here[:-1] + 1) | (lag[1:] != lag[:-1]) | (doc[here[1:]] != doc[here[:-1]]))
            first = np.flatnonzero(fresh)
            steps = np.diff(np.append(first, len(here)))
            period = lag[first]
            length = steps - 1 + 3 * span + period
            full = length >= np.maximum(least, times * period)
            found.append(((here[first] - period)[full], length[full], period[full]))
        name, span = two, 2 * span
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """The words, one space apart."""
    parts = []
    for x in range(0, len(starts), _JOIN_WORDS):
        s, lengths = starts[x : x + _JOIN_WORDS], ends[x : x + _JOIN_WORDS] - starts[x : x + _JOIN_WORDS]
        out = np.full(int(lengths.sum()) + len(lengths), 32, dtype=np.uint8)
        out[ranges(np.cumsum(lengths + 1) - lengths - 1, lengths)] = data[ranges(s, lengths)]
        parts.append(out.tobytes())
    return b"".join(parts)[:-1].decode()


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """Per row: the id, n_words, runs (start, length, period in words, by start, then period) and collapsed: the words, one
    space apart, without those that a run contains after its first period.

    Words are ``[^\\x20\\x09-\\x0D]+`` and are compared as they are. A null or empty text, or one of white space, has no words, no runs and an
    empty collapsed text. Rows are kept as they are, with null and repeated ids too; an empty table gives no rows; other
    columns are left out, whatever their names. Several runs can start at one word with different periods; a word is dropped
    once. A text's words stand in one task, some 60 bytes each; its cost grows as n log n at most. ``times`` must be 4 or more,
    for the bands to hold.
    """
    if times < 4:
        raise ValueError("times must be 4 or more")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            data, offsets = buffer_of(block.column("text"))
            s, e, edges = word_spans(data, offsets)
            many = np.diff(edges)
            doc = np.repeat(np.arange(block.num_rows), many)
            ids = spans_as_strings(data, s, e).dictionary_encode().indices.to_numpy().astype(np.int64)
            start, length, period = diagonals(ids, doc, edges[1:][doc], least=least, times=times)
            kept = np.zeros(len(s) + 1, dtype=np.int64)
            np.add.at(kept, start + period, 1)
            np.add.at(kept, start + length, -1)
            kept = np.cumsum(kept[:-1]) == 0
            owner = doc[start]
            bounds = np.searchsorted(owner, np.arange(block.num_rows + 1)).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(start - edges[:-1][owner]), pa.array(length), pa.array(period)], names=["start", "length", "period"]))
            texts = []
            for r in range(block.num_rows):
                a, b = edges[r], edges[r + 1]
                mine = kept[a:b]
                texts.append(_joined(data, s[a:b][mine], e[a:b][mine]))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(many.astype(np.int64)), runs, pa.array(texts, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    small_batches(docs.sparkSession)
    kind = docs.select(docs[id_col]).schema[0].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(task, f"id {kind}, n_words long, runs {RUNS_TYPE}, collapsed string").select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")
