"""Language-model scores by a probabilistic suffix tree over words.

The tree's states are contexts of up to ``depth`` words.  It grows level by level from counts
over all training texts: every sequence met at least ``support`` times is an entry of its
context, whatever the corpus' size, so the tree grows with the corpus.  A context is retained
as a state if the divergence of its next-word distribution from that of its longest retained
suffix, times its count, exceeds half a log N for each of its entries; growing ends early
where no sequence of a level has support.  Distributions are smoothed by absolute discounting:
what is taken off goes to the suffix state's distribution, and at the root to add-one unigrams with one
unseen word, so each state's probabilities sum to one.  A token is scored from the longest
retained state that ends its history.

Counts and states are tables, shares in single precision.  Texts are dealt into groups of some
4 MB; each group asks for the distinct keys it needs, these meet the tables by ranges of keys, and
the answers, values alone in the order of the keys, meet the group's texts again, which tell the
keys once more.  So a frequent key is asked for once a group and not once a token.  Texts travel
compressed, keys as differences of sorted arrays, which take less than six bytes each.  Sent to every
task are at most ``heads`` frequent words (24 bytes each), 2^22 frequent entries and states a
level (12 bytes each) and bitmaps of 2^26 bits, for scoring up to 2^28 by the number of entries. These only spare requests: an unset bit proves
that a sequence is in no table, and whatever is not sent is looked up.
Sequences are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.packed import FLUSH, bitmap, bitmap_of_tallied, bits_for, combined, distinct, maybe, pack, pack_keys, range_bits, ranges_of, tallied, unpack, unpack_keys
from tallybrook.llm.text import blocks, buffer_of, discard, lower_ascii, mix, release, small_batches, stored, word_hashes, word_spans

_END = np.uint64(0x5BF03635A1D1F1C3)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 20
_GROUP = 4 << 20
_DISCOUNT = 0.75
_ENTRIES = 1 << 22


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and row offsets; a null text is an end alone."""
    data, offsets = buffer_of(column)
    data = lower_ascii(data)
    starts, ends, edges = word_spans(data, offsets)
    rows = len(edges) - 1
    out = np.full(len(starts) + rows, _END)
    word = np.ones(len(out), dtype=bool)
    word[edges[1:] + np.arange(rows)] = False
    out[word] = word_hashes(data, starts, ends)
    return out, edges + np.arange(rows + 1)


def joined(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Key of the sequence whose first words have key ``x`` and whose last have key ``s``, one word further on."""
    return mix(x * _GOLD + s)


def sequences(hashes: np.ndarray, edges: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``n`` words: the key of the sequence that ends at each place, and whether the text has one there."""
    place = np.arange(len(hashes)) - np.repeat(edges[:-1], np.diff(edges))
    keys = hashes
    for words in range(1, n + 1):
        yield keys, place >= words - 1
        keys = np.append(keys[:1], joined(keys[:-1], keys[1:]))


def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, -1 if absent."""
    if not len(table):
        return np.full(len(values), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


class Lookup:
    """A table of sorted keys and their values. 2^22 flags tell most absent keys without a search."""

    def __init__(self, keys: np.ndarray, column: np.ndarray):
        self.keys, self.column = keys, column
        self.there = np.zeros(1 << 22, dtype=bool)
        self.there[keys >> np.uint64(42)] = True

    def get(self, values: np.ndarray, other: float) -> np.ndarray:
        """The column's entry for each value, ``other`` for absent ones."""
        out = np.full(len(values), other)
        asked = np.flatnonzero(self.there[values >> np.uint64(42)])
        at = _find(self.keys, values[asked])
        out[asked[at >= 0]] = self.column[at[at >= 0]]
        return out


@dataclass
class Heads:
    """What every task gets: the sizes, the frequent words in order with count and share left, the frequent entries and
    states (keys in order and values), the bitmap of all other entries and states."""

    total: int
    distinct: int
    depth: int
    words: np.ndarray
    counts: np.ndarray
    rest: np.ndarray
    gains: tuple[np.ndarray, np.ndarray]
    rests: tuple[np.ndarray, np.ndarray]
    bits: np.ndarray

    def __getstate__(self) -> dict:
        """Packed, as a broadcast is a file on the driver's disk and every executor's."""
        keys, values = lambda x: (len(x), pack_keys(x)), lambda x: (len(x), x.dtype, pack(x))
        pairs = {name: (keys(k), values(v)) for name in ("gains", "rests") for k, v in [getattr(self, name)]}
        return self.__dict__ | pairs | {"words": keys(self.words)} | {name: values(getattr(self, name)) for name in ("counts", "rest", "bits")}

    def __setstate__(self, state: dict) -> None:
        keys, values = lambda x: unpack_keys(x[1], x[0]), lambda x: unpack(x[2], x[0], x[1])
        pairs = {name: (keys(k), values(v)) for name in ("gains", "rests") for k, v in [state[name]]}
        self.__dict__ |= state | pairs | {"words": keys(state["words"])} | {name: values(state[name]) for name in ("counts", "rest", "bits")}


@dataclass
class Tree:
    """The model: ``heads``; tables (k, v, c) of entries with what they gain over the suffix state, and of states with
    the share they leave to it; c is the count. ``paths``: the folders of these tables and of the words."""

    heads: Heads
    gains: DataFrame
    rests: DataFrame
    paths: list[str]


def _each(make: Callable) -> Callable:
    """``make`` over the tokens of every block of the batches."""
    return lambda batches: (make(*tokens(block.column("text"))) for block in blocks(batches, "text", _BLOCK))


def _words(rows: DataFrame) -> DataFrame:
    """(k, c): all words and how often each occurs, counted in each task first."""

    def out(part: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1])], names=["k", "c"])

    return rows.mapInArrow(combined(_each(lambda hashes, _: (hashes,)), out, FLUSH), "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the key of the sequence in place of its suffix."""
    for b in batches:
        k = joined(*(b.column(c).to_numpy().view(np.uint64) for c in "xs"))
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *(b.column(c) for c in ("x", "c", "n", "below"))], names=["k", "x", "c", "n", "below"])


def grow(docs: DataFrame, *, text_col: str = "text", heads: int = 1 << 22, depth: int = 2, support: int = 2) -> tuple[Tree, DataFrame]:
    """The tree learnt from all given texts, and the table (k, c) of the counts of all their words."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs[text_col].alias("text"))
    tables: list[str] = []
    counts = stored(_words(rows), "words", tables)
    stats = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(stats.n), int(stats.v)
    none = spark.createDataFrame([], "k long, v float, c long")
    gains, rests, word_rests = none, none, none
    entries = counts.filter(F.col("c") >= support).withColumn("p", (F.col("c") + 1) / F.lit(float(total + distinct + 1)))
    made: list[str] = []
    used: list[str] = []
    between: list[DataFrame] = []
    for words in range(2, depth + 2):
        seen = spark.sparkContext.broadcast(bitmap(entries))  # 8 MB, as is the next one
        sent = [seen]

        def grams(hashes: np.ndarray, edges: np.ndarray, words: int = words, seen=seen) -> tuple[np.ndarray, ...]:
            *_, (keys, _), (ident, there) = sequences(hashes, edges, words)
            # a sequence isn't met more often than its first words or its last
            asked = there[1:] & maybe(seen.value, keys[:-1]) & maybe(seen.value, keys[1:])
            return ident[1:][asked], keys[:-1][asked], keys[1:][asked]

        def bare(hashes: np.ndarray, edges: np.ndarray, grams=grams) -> tuple[np.ndarray, ...]:
            return grams(hashes, edges)[:1]

        # most are met once: bare keys, which are packed, are counted first, and those of support go on
        often = spark.sparkContext.broadcast(bitmap_of_tallied(rows, _each(bare), support, total))
        sent.append(often)
        release(spark)

        def grams(hashes: np.ndarray, edges: np.ndarray, grams=grams, often=often) -> tuple[np.ndarray, ...]:
            columns = grams(hashes, edges)
            asked = maybe(often.value, columns[0])
            return tuple(x[asked] for x in columns)

        found = stored(tallied(rows, _each(grams), support, total, ("x", "s"), joined), "found", made)
        release(spark)  # the packed parts needn't stay while their sums are joined
        contexts = entries.select(F.col("k").alias("x"), F.col("c").alias("n"))
        suffixes = entries.select(F.col("k").alias("s"), F.col("p").alias("below"))
        level = stored(found.join(suffixes.hint("shuffle_hash"), "s").join(contexts.hint("shuffle_hash"), "x").mapInArrow(_keyed, "k long, x long, c long, n long, below double"), "level", made)
        for one in sent:  # a broadcast is a file in every executor
            one.destroy()
        release(spark)
        if level.isEmpty():
            break
        states = stored(_states(level, total), "states", tables)
        rests = rests.unionByName(states.select(F.col("x").alias("k"), F.col("v").cast("float").alias("v"), F.col("n").alias("c")))
        if words == 2:
            word_rests = rests
        gain = (F.col("c") - _DISCOUNT) / F.col("n")
        last = words == depth + 1
        kept = level.join(states.drop("n"), "x", "inner" if last else "left")
        share = [] if last else [F.coalesce(gain + F.col("v") * F.col("below"), "below").alias("p")]
        entries = stored(kept.select("k", F.when(F.col("v").isNotNull(), gain).cast("float").alias("v"), "c", *share), "entries", used)
        discard(spark, made)
        if last:
            gains = gains.unionByName(entries)
            tables.append(used.pop())
        else:
            between.append(entries)
    for entries in between:  # without the shares that the next level needed
        gains = gains.unionByName(stored(entries.filter("v IS NOT NULL").select("k", "v", "c"), "gains", tables))
    discard(spark, [*made, *used])
    frequent = counts.filter(F.col("c") * heads >= total).join(word_rests.drop("c"), "k", "left").select("k", "c", F.coalesce("v", F.lit(1.0)).alias("v")).toArrow()  # at most ``heads`` rows
    signed = frequent.column("k").to_numpy().view(np.uint64)
    order = np.argsort(signed)
    release(spark)
    known = signed[order], frequent.column("c").to_numpy()[order], frequent.column("v").to_numpy()[order]
    rare = gains.union(rests).filter(_rare(total))
    bits = bitmap(rare, bits_for(gains.count() + rests.count()))
    return Tree(Heads(total, distinct, depth, *known, _frequent(gains, total), _frequent(rests, total), bits), gains, rests, tables), counts


def _rare(total: int) -> Column:
    return F.col("c") * _ENTRIES < total


def _frequent(table: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and values of the table's frequent rows: at most ``_ENTRIES`` a level, as counts add up to the total."""
    got = table.filter(~_rare(total)).select("k", "v").toArrow()
    keys = got.column("k").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got.column("v").to_numpy()[order]


def _states(level: DataFrame, total: int) -> DataFrame:
    """(x, n, v) of the contexts that are retained: count, and what each leaves to its suffix.  ``level``: entries with context x, its
    count n, their own count c and their probability in the suffix state."""
    c, n = F.col("c"), F.col("n")
    sums = level.groupBy("x").agg(F.max("n").alias("n"), F.count("*").alias("e"), F.sum("c").alias("met"), F.sum("below").alias("below"), F.sum(c * F.log(c / n / F.col("below"))).alias("gained"))
    left = n - F.col("met")
    others = F.when(left > 0, left * F.log(left / n / F.greatest(1 - F.col("below"), F.lit(1e-300)))).otherwise(0.0)
    worth = F.col("gained") + others > 0.5 * F.col("e") * F.log(F.lit(float(max(total, 2))))
    return sums.filter(worth).select("x", "n", ((left + _DISCOUNT * F.col("e")) / n).alias("v"))


def _dealt(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (id, text) by blocks: group ``g`` and the compressed ``block``. Texts that follow each other in a partition share a
    group, some ``limit`` bytes a group."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = TaskContext.get().partitionId() << 32, 0
        for block in blocks(batches, "text", min(_BLOCK, limit)):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(block)
            yield pa.RecordBatch.from_arrays([pa.array([part + size // limit]), pa.array([out.getvalue().to_pybytes()])], names=["g", "block"])
            size += len(buffer_of(block.column("text"))[0])

    return rows.mapInArrow(task, "g long, block binary")


def _opened(packed: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(packed.as_buffer()).read_next_batch()


def _boxed(bits: int) -> Callable:
    """A task that packs table rows (kind, k, v) by range of keys and kind: (b, kind, n, k, v), values of 32 bits, integers for words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            kind, k, v = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("kind", "k", "v"))
            for which in np.unique(kind):
                keys, values = k[kind == which].view(np.uint64), v[kind == which].astype(np.float32 if which else np.int32)
                order = np.argsort(keys)
                keys, values = keys[order], values[order]
                at, cuts = ranges_of(keys, bits)
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                columns = [pa.array(at), pa.array(np.full(len(at), which, np.int32)), pa.array(np.diff(cuts)), pa.array([pack_keys(keys[a:b]) for a, b in spans], pa.binary()), pa.array([pack(values[a:b]) for a, b in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["b", "kind", "n", "k", "v"])

        size = 0
        for batch in batches:
            parts.append(batch)
            size += batch.num_rows
            if size >= FLUSH:
                yield from out()
                parts, size = [], 0
        if size:
            yield from out()

    return task


def _met(asked: pa.Table, tables: pa.Table) -> pa.Table:
    """Of each request (b, g, n, k) for keys of one range, the values of the three kinds (g, b, n, v0, v1, v2) in the order of the
    keys, 0 for keys that a table doesn't have; no table has a 0."""
    kinds = []
    for which in range(3):
        mine = tables.filter(pc.equal(tables.column("kind"), which))
        n = mine.column("n").to_pylist()
        k = np.concatenate([np.zeros(0, np.uint64), *(unpack_keys(x, m) for x, m in zip(mine.column("k"), n, strict=True))])
        kind = np.float32 if which else np.int32
        v = np.concatenate([np.zeros(0, kind), *(unpack(x, m, kind) for x, m in zip(mine.column("v"), n, strict=True))])
        order = np.argsort(k)
        kinds.append((k[order], v[order]))
    values: list[list[bytes]] = [[], [], []]
    for packed, n in zip(asked.column("k"), asked.column("n").to_pylist(), strict=True):
        keys = unpack_keys(packed, n)
        for (k, v), to in zip(kinds, values, strict=True):
            at = _find(k, keys)
            to.append(pack(np.where(at >= 0, v[at], v.dtype.type(0)) if len(k) else np.zeros(n, v.dtype)))
    return pa.table([asked.column("g"), asked.column("b"), asked.column("n"), *(pa.array(x, pa.binary()) for x in values)], names=["g", "b", "n", "v0", "v1", "v2"])


def _wanted(model: Heads, hashes: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """The keys that a block's scores need and that aren't known to every task."""
    words = distinct(hashes) if len(model.words) < model.distinct else hashes[:0]
    parts = [words[_find(model.words, words) < 0]]
    for n, (keys, there) in enumerate(sequences(hashes, edges, model.depth + 1), 1):
        if n > 1:
            parts.append(distinct(keys[there & maybe(model.bits, keys)]))
    return parts


def score(docs: DataFrame, tree: Tree, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", spend: bool = False) -> DataFrame:
    """Per row: id, n_tokens (words and one end), n_known (in training), train_tokens, base_score (add-one
    unigrams) and score (the tree), both log10 of the text's probability.

    A null or empty text is one end token. Rows are kept as they are, repeated ones and null ids too; other columns
    are not read; an empty table gives no rows. Without training texts every token is unseen. A text is scored whole,
    in memory of some twenty times its size. Texts are dealt once, into a stored table that both the requests and the
    scores are made from, so it doesn't matter in which order ``docs`` comes when it is read again. With ``spend`` the tree's tables are removed
    once all requests are answered; the tree and the counts can't be used again then.
    """
    heads = tree.heads
    small_batches(docs.sparkSession)
    send = docs.sparkSession.sparkContext.broadcast(heads)  # bounded by ``heads`` of ``grow`` and 2^26 bits
    den = heads.total + heads.distinct + 1
    limit = _GROUP
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    dealt = stored(_dealt(rows, limit), "dealt")

    gains, rests = (t.filter(_rare(heads.total)) for t in (tree.gains, tree.rests))
    words = counts.filter(F.lit(len(heads.words) < heads.distinct))  # every task may know them all
    bits = range_bits((heads.distinct if len(heads.words) < heads.distinct else 0) + tree.gains.count() + tree.rests.count())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = send.value
        group, parts = None, []

        def request() -> pa.RecordBatch:
            keys = distinct(np.concatenate(parts))
            at, cuts = ranges_of(keys, bits)
            packed = [pack_keys(keys[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), group)), pa.array(np.diff(cuts)), pa.array(packed, pa.binary())], names=["b", "g", "n", "k"])

        for batch in batches:
            for g, packed in zip(batch.column("g").to_pylist(), batch.column("block"), strict=True):
                if group is not None and g != group:
                    yield request()
                    parts = []
                group = g
                parts += _wanted(model, *tokens(_opened(packed).column("text")))
        if group is not None:
            yield request()

    def answer(texts: pa.Table, found: pa.Table) -> pa.Table:
        model = send.value
        opened = [(block.column("id"), *tokens(block.column("text"))) for block in map(_opened, texts.column("block"))]
        asked = distinct(np.concatenate([x for _, hashes, edges in opened for x in _wanted(model, hashes, edges)])) if opened else np.zeros(0, np.uint64)
        found = found.sort_by("b")
        n = found.column("n").to_pylist()
        words, gains, rests = (
            Lookup(asked, np.concatenate([np.zeros(0, kind), *(unpack(x, m, kind) for x, m in zip(found.column(c), n, strict=True))])) for c, kind in (("v0", np.int32), ("v1", np.float32), ("v2", np.float32))
        )
        rests.column[rests.column == 0] = 1.0  # what isn't found leaves all to its suffix
        often, left = Lookup(*model.gains), Lookup(*model.rests)
        out = []
        for ids, hashes, edges in opened:
            kinds, which = np.unique(hashes, return_inverse=True)
            head = _find(model.words, kinds)
            c, rest = words.get(kinds, 0.0), np.minimum(rests.get(kinds, 1.0), left.get(kinds, 1.0))  # where it isn't found, 1
            if len(model.words):
                c, rest = np.where(head >= 0, model.counts[head], c), np.where(head >= 0, model.rest[head], rest)
            base = (c + 1.0) / den
            known, prob, rest = (c > 0)[which], base[which], rest[which]
            base = np.log10(base)[which]
            for n, (keys, there) in enumerate(sequences(hashes, edges, model.depth + 1), 1):
                if n == 1:
                    continue
                order = np.argsort(keys)  # keys in order are found several times faster
                keys = keys[order]
                gain = np.empty(len(keys))
                gain[order] = np.maximum(gains.get(keys, 0.0), often.get(keys, 0.0))
                prob[1:] *= np.where(there[1:], rest[:-1], 1.0)
                prob += np.where(there, gain, 0.0)
                if n <= model.depth:
                    rest[order] = np.minimum(rests.get(keys, 1.0), left.get(keys, 1.0))
            sums = [np.add.reduceat(x, edges[:-1]) for x in (known, base, np.log10(prob))]  # every row has its end
            out.append(pa.RecordBatch.from_arrays([ids, pa.array(np.diff(edges)), pa.array(sums[0].astype(np.int64)), *map(pa.array, sums[1:])], names=["id", "n_tokens", "n_known", "base_score", "score"]))
        return pa.Table.from_batches(out)

    table = words.select(F.lit(0).cast("byte").alias("kind"), "k", F.col("c").cast("double").alias("v"))
    for kind, part in enumerate((gains, rests), 1):
        table = table.union(part.select(F.lit(kind).cast("byte"), "k", "v"))
    table = table.mapInArrow(_boxed(bits), "b int, kind int, n long, k binary, v binary")
    asked = dealt.mapInArrow(ask, "b int, g long, n long, k binary")
    found = stored(asked.groupBy("b").cogroup(table.groupBy("b")).applyInArrow(_met, "g long, b int, n long, v0 binary, v1 binary, v2 binary"), "answers")
    if spend:
        discard(docs.sparkSession, tree.paths)
    release(docs.sparkSession)  # requests and tables needn't stay while scores are made
    kind = rows.schema["id"].dataType.simpleString()
    scored = dealt.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(answer, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(heads.total).cast("long").alias("train_tokens"), "base_score", "score")
