"""Phrase collocations: frequent phrases by Toivonen's sampling, then the cohesion of their cuts.

Mining: a sample of the documents proposes phrases, those it holds often enough for a lowered threshold. One full
pass counts exactly, over all documents, every proposed phrase together with the negative border: phrases whose first words and
whose last words (all but one) are both proposed, and every single word. If a phrase of the border turns out
frequent, longer phrases over it may have gone uncounted: it joins the proposed ones and a further full pass counts what that
adds, until no frequent phrase is missing among the proposed ones. As every part of a frequent phrase is
frequent, all frequent phrases have then been counted, whatever the sample held.

The passes count 64-bit keys of phrases, so that what is rare, nearly all of the border, is shuffled as numbers. A key's count is
that of its phrase or, where keys collide, more, so no frequent phrase is lost; a last pass counts the phrases of the keys that
reach the support by the phrases themselves, and what counts is exact. Proposed phrases reach the tasks as a
Bloom filter of keys, sized by their number (at most 2^28 bits, 32 MB). A phrase that is let through by mistake is counted
like any other, so a full filter costs work and never changes a count. Counts are summed in each block before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybrook.llm.text import blocks, buffer_of, discard, lower_ascii, mix, release, small_batches, span_hashes, spans_as_strings, stored, word_spans

UNKNOWN = "und"
#: Bytes that end a piece of text; words inside a piece are parted by spaces and tabs.
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_PART = _BREAK.copy()
_PART[[0x20, 0x09]] = True
_BLOCK = 2 << 20
_OUT_BYTES = 2 << 20
_MOST_BITS = 28
_A = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """The words of a block: distinct ones, and by position which one, in which language, and whether the next belongs to the same piece."""

    kinds: pa.Array
    kind: np.ndarray
    langs: pa.Array
    lang: np.ndarray
    goes_on: np.ndarray
    edges: np.ndarray
    keys: np.ndarray  # of each distinct (language, word)
    ids: np.ndarray  # of each position, into keys


def _words(block: pa.RecordBatch) -> Words:
    data, offsets = buffer_of(block.column("text"))
    data = lower_ascii(data)
    starts, ends, edges = word_spans(data, offsets, _PART)
    row = np.repeat(np.arange(block.num_rows), np.diff(edges))
    piece = np.cumsum(_BREAK[data])[starts] if len(starts) else starts
    goes_on = np.zeros(len(starts), dtype=bool)
    goes_on[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    found = spans_as_strings(data, starts, ends).dictionary_encode()
    kind = found.indices.to_numpy().astype(np.int64)
    langs = block.column("lang").dictionary_encode()
    lang = langs.indices.to_numpy().astype(np.int64)[row]
    ldata, loff = buffer_of(langs.dictionary)
    by_lang = span_hashes(ldata, loff[:-1], loff[1:])
    wdata, woff = buffer_of(found.dictionary)
    by_word = span_hashes(wdata, woff[:-1], woff[1:])
    codes, ids = np.unique(lang * max(1, len(by_word)) + kind, return_inverse=True)
    keys = mix(by_lang[codes // max(1, len(by_word))] * _A + by_word[codes % max(1, len(by_word))])
    return Words(found.dictionary, kind, langs.dictionary, lang, goes_on, edges, keys, ids)


def _longer(keys_first: np.ndarray, keys_last: np.ndarray) -> np.ndarray:
    """Keys of phrases from those of their first words and of their last words."""
    return mix(keys_first * _A + keys_last)


@dataclass
class Proposed:
    """A Bloom filter of phrase keys, two bits a key."""

    bits: np.ndarray  # 64 in each element

    @staticmethod
    def of(keys: DataFrame, least_bits: int = 0) -> Proposed:
        """The filter of a table's column ``key``; its size follows the number of keys, or is 2^``least_bits``."""
        size = least_bits or min(_MOST_BITS, max(16, int(16 * max(1, keys.count()) - 1).bit_length()))
        low = F.lit((1 << size) - 1)
        spots = keys.select(F.explode(F.array(F.col("key").bitwiseAND(low), F.shiftrightunsigned("key", 36).bitwiseAND(low))).alias("spot"))
        words = spots.groupBy(F.shiftright("spot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")).toArrow()
        bits = np.zeros(1 << (size - 6), dtype=np.uint64)
        bits[words.column("at").to_numpy()] = words.column("bits").to_numpy().astype(np.int64).view(np.uint64)
        return Proposed(bits)

    @property
    def size(self) -> int:
        return len(self.bits).bit_length() + 5

    def has(self, keys: np.ndarray) -> np.ndarray:
        low = np.uint64((len(self.bits) << 6) - 1)
        spots = (keys & low, keys >> np.uint64(36) & low)
        return np.logical_and(*((self.bits[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63)) & np.uint64(1)).astype(bool) for s in spots))


def _grown(w: Words, longest: int, now: Proposed | None, before: Proposed | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: (words, key of each distinct phrase, its first position, its count, whether an earlier pass counted it), of
    phrases whose first words and last words the filter ``now`` has; without a filter of all phrases."""
    ids, keys, at = w.ids, w.keys, np.arange(len(w.ids))
    _, first, counts = np.unique(ids, return_index=True, return_counts=True)
    done = np.full(len(keys), before is not None)
    for k in range(1, longest + 1):
        if not len(keys):
            return
        yield k, keys, first, counts, done
        live = now.has(keys)[ids] if now is not None else np.ones(len(ids), bool)
        known = done & before.has(keys) if before is not None else done
        on = live[:-1] & live[1:] & w.goes_on[at[:-1]] & (at[1:] == at[:-1] + 1)
        at = at[:-1][on]
        codes, first, mine, counts = np.unique(ids[:-1][on] * len(keys) + ids[1:][on], return_index=True, return_inverse=True, return_counts=True)
        first, head, tail = at[first], codes // len(keys), codes % len(keys)
        done, keys, ids = known[head] & known[tail], _longer(keys[head], keys[tail]), mine


def _key_counts(rows: DataFrame, longest: int, new: Broadcast | None = None, old: Broadcast | None = None) -> DataFrame:
    """(key, words, n) of the phrases that a filter lets through and the one before it didn't."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = new.value if new is not None else None, old.value if old is not None else None
        for block in blocks(batches, "text", _BLOCK):
            for k, keys, _, counts, done in _grown(_words(block), longest, now, before):
                fresh = ~done
                yield pa.RecordBatch.from_arrays([pa.array(keys[fresh].view(np.int64)), pa.array(np.full(int(fresh.sum()), k, dtype=np.int8)), pa.array(counts[fresh])], names=["key", "words", "n"])

    return rows.mapInArrow(task, "key long, words byte, n long").groupBy("key").agg(F.min("words").alias("words"), F.sum("n").alias("n"))


def _phrases(w: Words, k: int, first: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Phrases of ``k`` words at the positions with their counts, in batches of bounded size."""
    lengths = pc.binary_length(w.kinds).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sum(lengths[w.kind[first + j]] for j in range(k)) + k)
    x = 0
    while x < len(first):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + _OUT_BYTES, side="right")))
        parts = [w.kinds.take(pa.array(w.kind[first[x:y] + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
        yield pa.RecordBatch.from_arrays([w.langs.take(pa.array(w.lang[first[x:y]])), phrase, pa.array(counts[x:y])], names=["lang", "phrase", "f"])
        x = y


def _phrase_counts(rows: DataFrame, longest: int, wanted: Broadcast) -> DataFrame:
    """(lang, phrase, f) of the phrases whose keys a filter has, exact, and under an empty phrase the number of all word
    occurrences of the language."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", _BLOCK):
            w = _words(block)
            if not len(w.ids):
                continue
            many = np.bincount(w.lang, minlength=len(w.langs))
            yield pa.RecordBatch.from_arrays([w.langs, pa.array([""] * len(w.langs), pa.string()), pa.array(many)], names=["lang", "phrase", "f"])
            for k, keys, first, counts, _ in _grown(w, longest, wanted.value, None):
                there = wanted.value.has(keys)
                yield from _phrases(w, k, first[there], counts[there])

    return rows.mapInArrow(task, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _unseen(keys: DataFrame, proposed: Broadcast) -> int:
    """How many keys the filter doesn't have."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            missing = ~proposed.value.has(b.column("key").to_numpy().astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([int(missing.sum())], pa.int64())], names=["n"])

    return keys.select("key").mapInArrow(task, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def frequent(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", support: int = 30, longest: int = 4, share: float = 0.125, slack: float = 0.55, made: list[str] | None = None) -> tuple[DataFrame, int]:
    """(lang, phrase, words, f) of all phrases of up to ``longest`` words that occur at least ``support`` times in a language, and
    one row with an empty phrase and 0 words for the number of all word occurrences of each language; and the number of full
    passes that counted keys.

    ``share`` of the documents, by a hash of their ids, is the sample; its threshold is ``slack`` times the expected
    count of a phrase that just has the support. Both change the number of passes only. Phrases don't cross the ends of pieces
    and texts; a null text is empty, a null language 'und'. Rows with equal or null ids all count. An empty table gives no
    rows. Other columns are ignored. A text stands in one task as a whole, however long.
    """
    spark, made = docs.sparkSession, made if made is not None else []
    small_batches(spark)
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[lang_col].cast("string"), F.lit(UNKNOWN)).alias("lang"), docs[text_col].cast("string").alias("text"))
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20))).drop("id")
    rows = rows.drop("id")
    old, passes, often = None, 0, None
    proposed = Proposed.of(stored(_key_counts(sample, longest - 1).filter(F.col("n") >= max(1, int(slack * share * support))).select("key"), "proposed", made))
    while True:
        release(spark)
        new = spark.sparkContext.broadcast(proposed)
        passes += 1
        found = stored(_key_counts(rows, longest, new, old).filter(F.col("n") >= support), "counted", made)
        often = found if often is None else often.unionAll(found)
        if passes >= longest or not _unseen(found.filter(F.col("words") < longest), new):
            break
        proposed = Proposed(proposed.bits | Proposed.of(found.filter(F.col("words") < longest), least_bits=proposed.size).bits)
        old = new
    release(spark)
    wanted = spark.sparkContext.broadcast(Proposed.of(often))
    whole = stored(_phrase_counts(rows, longest, wanted).filter((F.col("f") >= support) | ((F.col("phrase") == "") & (F.col("f") > 0))), "phrases", made)
    release(spark)
    size = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1)
    return whole.select("lang", "phrase", size.cast("int").alias("words"), "f"), passes


def _big(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def collocations(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", support: int = 30, longest: int = 4, scale: int = 2_000_000, absorbed: int = 80, top: int = 2000, share: float = 0.125, slack: float = 0.55) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words by score.

    a is the phrase's count; cut after its first words, l and r are the counts of both parts and the score is
    floor(``scale`` * a / (l + r)). The lowest-scoring cut counts, of equal ones the earliest. A phrase whose words stand in a longer
    candidate that has ``absorbed`` per cent of its count is left out. Equal scores are ordered by count, then by the phrase's
    bytes. Arithmetic is exact (decimals of 38 digits). Nulls, empty texts and tables: as in ``frequent``.
    """
    spark, made = docs.sparkSession, []
    mined, _ = frequent(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, support=support, longest=longest, share=share, slack=slack, made=made)
    candidates = mined.filter("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    shorter = mined.filter(F.col("words").between(1, longest - 1))
    spots = candidates.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    spots = spots.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("words")), " ").alias("rest"))
    left = shorter.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = shorter.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr(f"cast((cast(a as decimal(20,0)) * {scale}BD) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    cuts = spots.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    inside = candidates.filter("words >= 3").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (_big(F.col("most")) * 100 < _big(F.col("a")) * absorbed))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    totals = mined.filter("words = 0").select("lang", F.col("f").alias("n"))
    out = stored(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score")), "collocations")
    discard(spark, made)
    return out
