"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile is the most frequent letter n-grams (n = 1 to 3, words padded by one space)
in rank order.  A language's profile comes from the counts over all training texts;
a document's from its whole text.  The distance sums, over the document's n-grams,
how far each is out of place in the language's profile, an absent one counting as
much as the profile is long.  Equal counts are ranked by n-gram, equal distances by
language name, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.text import blocks, buffer_of, ranges, small_batches, spans_as_strings, word_spans

UNKNOWN = "und"
_BLOCK = 2 << 20
_FLUSH = 1 << 20

Profiles = dict[str, np.ndarray]


def letters(text: Column) -> Column:
    """Lower-case words of letters, one space apart; empty for a null text."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(""))


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of letter texts: word kinds in order, first word of each row, n-gram codes in order,
    and by kind where its n-grams (indices into the codes) start, how many, and the indices."""
    data, offsets = buffer_of(column)
    starts, ends, edges = word_spans(data, offsets)
    words = spans_as_strings(data, starts, ends).dictionary_encode()
    flat = np.frombuffer((" " + " ".join(words.dictionary.to_pylist()) + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    space = flat == 32
    word = np.cumsum(space) - 1  # of a space: the word after it
    inner = np.flatnonzero(~space)
    pair = np.arange(len(flat) - 1)
    triple = inner[(inner > 0) & (inner < len(flat) - 1)]
    owner = np.concatenate([word[inner], np.where(space[:-1], word[pair], word[pair]), word[triple]])
    code = np.concatenate([flat[inner], flat[:-1] << 21 | flat[1:], flat[triple - 1] << 42 | flat[triple] << 21 | flat[triple + 1]])
    codes, which = np.unique(code, return_inverse=True)
    order = np.argsort(owner, kind="stable")
    kinds = len(words.dictionary)
    begin = np.searchsorted(owner[order], np.arange(kinds + 1))
    return words.indices.to_numpy().astype(np.int64), edges, codes, begin[:-1], np.diff(begin), which[order]


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", size: int = 400) -> Profiles:
    """Profiles of every non-null language: its ``size`` most frequent n-grams over all given texts, as codes in rank order.

    Counts are summed in each task before the shuffle; the driver gets ``size`` rows a language.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size_held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])
            held.clear()

        for block in blocks(batches, "text", _BLOCK):
            kind, edges, codes, begin, many, which = _grams(block.column("text"))
            rows = np.repeat(np.arange(block.num_rows), np.diff(edges))
            names = block.column("lang").dictionary_encode()
            tag = names.indices.to_numpy().astype(np.int64)[rows]
            spots = ranges(begin, many)
            for x, lang in enumerate(names.dictionary.to_pylist()):
                used = np.bincount(kind[tag == x], minlength=len(begin))
                counts = np.bincount(which[spots], weights=np.repeat(used, many), minlength=len(codes))
                there = np.flatnonzero(counts)
                held.setdefault(lang, []).append((codes[there], counts[there]))
                size_held += len(there)
            if size_held > _FLUSH:
                yield from flush()
                size_held = 0
        yield from flush()

    small_batches(docs.sparkSession)
    rows = docs.filter(docs[lang_col].isNotNull()).select(docs[lang_col].alias("lang"), letters(docs[text_col]).alias("text")).filter("text != ''")
    total = rows.mapInArrow(task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in ranked.select("lang", "rank", "gram").collect():
        found.setdefault(r.lang, []).append((r.rank, r.gram))
    return {lang: np.array([g for _, g in sorted(v)], dtype=np.int64) for lang, v in sorted(found.items())}


def _distances(column: pa.Array, profiles: Profiles, size: int) -> np.ndarray:
    """Distance of each row to each profile, as a share of the largest one; NaN for a text without letters."""
    out = np.full((len(column), len(profiles)), np.nan)
    kind, edges, codes, begin, many, which = _grams(column)
    place = np.full((len(profiles), len(codes)), size, dtype=np.int64)
    for x, profile in enumerate(profiles.values()):
        order = np.argsort(profile)
        at = np.minimum(np.searchsorted(profile[order], codes), len(profile) - 1)
        hit = profile[order][at] == codes
        place[x, hit] = order[at[hit]]
    for r in range(len(column)):
        mine = kind[edges[r] : edges[r + 1]]
        if not len(mine):
            continue
        counts = np.bincount(which[ranges(begin[mine], many[mine])], minlength=len(codes))
        there = np.flatnonzero(counts)
        top = there[np.argsort(-counts[there], kind="stable")[:size]]
        ranks = place[:, top]
        out[r] = np.where(ranks == size, size, np.abs(ranks - np.arange(len(top)))).sum(axis=1) / (size * len(top))
    return out


def identify(docs: DataFrame, profiles: Profiles, *, id_col: str = "doc_id", text_col: str = "text", size: int = 400, keep: list[str] | None = None) -> DataFrame:
    """Per row: id, lang_pred, score (1 - distance to the nearest profile, as a share of the largest distance),
    margin (how much farther the second language is, same scale).

    A null text, one without a letter, or no profile at all gives 'und' with score 0. Rows are kept as they are,
    repeated ones too; an empty table gives no rows. ``keep`` names further columns to carry.
    """
    names = list(profiles)
    carried = [c for c in (keep or []) if c != id_col]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__letters", _BLOCK):
            if names:
                far = _distances(block.column("__letters"), profiles, size)
            else:
                far = np.full((block.num_rows, 1), np.nan)
            known = ~np.isnan(far[:, 0])
            best = np.argmin(np.where(np.isnan(far), 2.0, far), axis=1)
            ordered = np.sort(np.where(np.isnan(far), 2.0, far), axis=1)
            score = np.where(known, 1.0 - ordered[:, 0], 0.0)
            margin = np.where(known, ordered[:, 1] - ordered[:, 0], 0.0) if far.shape[1] > 1 else score
            labels = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), *(block.column(c) for c in carried), pa.array(labels, pa.string()), pa.array(score), pa.array(margin)], names=[id_col, *carried, "lang_pred", "score", "margin"])

    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col], *(docs[c] for c in carried), letters(docs[text_col]).alias("__letters"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(task, ", ".join([*(f"`{c}` {kinds[c]}" for c in [id_col, *carried]), "lang_pred string, score double, margin double"]))
