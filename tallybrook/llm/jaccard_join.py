"""Exact n-gram Jaccard self-join by a partition of the token universe (pigeonhole).

Two sets of sizes r and s with Jaccard of p / 100 at least differ in at most
H(r, s) = (r + s)(100 - p) / (100 + p) tokens.  Sizes fall into overlapping bands;
within a band, hashing deals every token to one of m segments.  With v_i the number
of differences given to segment i, sum(v_i) > H forces some segment to differ by less
than v_i: v_i = 1 is matched by the signature of the segment's subset, v_i = 2 by
signatures of the subset and of its one-deletion neighbourhood, v_i = 0 not at all.

Allocation follows cost.  Bands of short texts (H of 2 at most), where single segments
would hold few tokens, take v_i = 2 with half the segments.  In other bands every
document puts v_i = 1 on its H + 1 cheapest segments: those whose subset is rarest in
the whole table.  The order (count, signature) is the same for all documents, so two
similar ones, sharing at least m - H of m segments, still meet in one both have chosen.
A document with H + 1 segments of its own can link to none and is dropped right there.

Texts of equal words in order, by a 128-bit digest of them, are one class from the start.  In a bucket of equal signatures a
representative is compared first, so a large group of near copies becomes a component
with as many comparisons as members.  What is left of a bucket (members of different
components) is compared pairwise.  Before texts are fetched, every pair must pass an exact
bound: tokens are dealt to eight times as many bits as differences are allowed, a bit being
the parity of its tokens, and each bit that differs is a difference.  It removes nearly all
pairs of groups whose members drifted apart.  Every link between classes is checked on the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybrook.llm.components import connected, starred
from tallybrook.llm.packed import bitmap, bits_for, maybe, tallied
from tallybrook.llm.text import WHITE, blocks, buffer_of, discard, lower_ascii, mix, release, small_batches, stored, word_hashes, word_spans

_RATIO = 1.5
_SLACK = 1.1
_DELETION_H = 2
_K1 = np.uint64(0x9E6C63D0676A9A99)
_K2 = np.uint64(0xC13FA9A902A6328F)


class Bands:
    """Size bands for one threshold (per cent): segments and signatures needed for each size."""

    def __init__(self, percent: int):
        self.p = percent
        self.low = [1]

    def most_apart(self, n: int) -> int:
        """H(n): differences that a set of size n can have with any set it links to."""
        return (n + 100 * n // self.p) * (100 - self.p) // (100 + self.p)

    def of(self, n: int) -> list[int]:
        """Bands of size n: its own, and earlier ones that reach up to it."""
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * _RATIO)))
        own = int(np.searchsorted(self.low, n, side="right")) - 1
        found = [own]
        while found[-1] and n <= 100 * (self.low[found[-1]] - 1) // self.p:
            found.append(found[-1] - 1)
        return found

    def shape(self, band: int) -> tuple[int, bool]:
        """Number of segments, and whether they are matched with one deletion."""
        h = self.most_apart(self.low[band + 1] - 1)
        if not h:
            return 1, False
        return ((h + 2) // 2, True) if h <= _DELETION_H else (int(np.ceil(_SLACK * (h + 1))), False)


def token_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; one for a shorter non-empty text; none without words."""
    data, offsets = buffer_of(column)
    data = lower_ascii(data)
    starts, ends, edges = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    grams = mix(words)
    for k in range(1, width):
        grams = mix(grams[: len(grams) - 1] + words[k:]) if len(grams) > 1 else grams[:0]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            x = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                x = mix(x + words[k : k + 1])
            yield x
        else:
            yield np.zeros(0, dtype=np.uint64)


def signatures(tokens: np.ndarray, band: int, segments: int, deletion: bool) -> np.ndarray:
    """Signatures of a set's segments in a band; with ``deletion`` also those of each segment less one token."""
    salt = np.uint64((band + 1) * 0xD1B54A32D192ED03 & (2**64 - 1))
    x = mix(tokens ^ salt)
    seg = ((x >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    y = mix(x + _K1)
    sums = np.zeros(segments, dtype=np.uint64)
    np.add.at(sums, seg, y)
    place = np.arange(segments, dtype=np.uint64) * _K2 + salt
    whole = mix(sums + place)
    return np.unique(np.concatenate([whole, mix(sums[seg] - y + place[seg])])) if deletion else whole


def _normal_rows(data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """Each row's words, one space apart, of lower-case data."""
    white = WHITE[data]
    keep = ~white
    keep[1:] |= ~white[:-1]
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    packed = np.where(white[keep], 0x20, data[keep]).astype(np.uint8).tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield packed[a:b].strip(b" ")


def _sketches(rows: DataFrame, kind: str, width: int) -> DataFrame:
    """Per row: id, n (set size), h1 and h2 (digest of the words in order, by which exact copies are one class)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            data, offsets = buffer_of(block.column("text"))
            digests = b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in _normal_rows(lower_ascii(data), offsets))
            h = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
            sizes = [len(tokens) for tokens in token_sets(block.column("text"), width)]
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(sizes, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["id", "n", "h1", "h2"])

    return rows.mapInArrow(task, f"id {kind}, n long, h1 long, h2 long")


def _signatures(percent: int, width: int, one_of: Callable) -> Callable:
    """Of batches (id, text): by block, ids and signatures of the texts whose id's hash passes ``one_of``; the lowest four bits
    of a signature tell its band, modulo 16."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bands = Bands(percent)
        for block in blocks(batches, "text"):
            block = block.filter(pa.array(one_of(mix(block.column("id").to_numpy().view(np.uint64)))))
            ids, sigs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for key, tokens in zip(block.column("id").to_pylist(), token_sets(block.column("text"), width), strict=True):
                for band in bands.of(len(tokens)) if len(tokens) else ():
                    sigs.append(signatures(tokens, band, *bands.shape(band)) & ~np.uint64(15) | np.uint64(band & 15))
                    ids.append(np.full(len(sigs[-1]), key))
            yield np.concatenate(ids), np.concatenate(sigs)

    return made


def _allotted(classes: DataFrame, percent: int) -> DataFrame:
    """(id, n, band, spare, most) of each class and band of its size: how many more signatures than its segments it must use, and
    how many signatures it has at most."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            out: list[tuple[int, ...]] = []
            for key, n in zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for band in bands.of(n):
                    segments, deletion = bands.shape(band)
                    out.append((key, n, band & 15, 0 if deletion else bands.most_apart(n) + 1 - segments, segments + n * deletion))
            a = np.array(out, dtype=np.int64).reshape(-1, 5)
            kinds = {"id": np.int64, "n": np.int64, "band": np.int32, "spare": np.int32, "most": np.int64}
            yield pa.RecordBatch.from_arrays([pa.array(a[:, i].astype(kind)) for i, kind in enumerate(kinds.values())], names=list(kinds))

    return classes.select("rep", "n").mapInArrow(task, "id long, n long, band int, spare int, most long")


def word_set(text: str, width: int) -> set:
    """The set itself, on words."""
    words = text.encode().lower().split()  # bytes: lowers A-Z only and splits at \x20 and \x09-\x0D only
    return set(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else {tuple(words)} if words else set()


def shared_sizes(a: str, b: str, width: int) -> tuple[int, int, int]:
    """Sizes of two texts' sets and of what they share, on the words themselves: words are numbered, then pairs of
    numbers, until each number stands for a whole n-gram."""
    x, y = a.encode().lower().split(), b.encode().lower().split()
    if min(len(x), len(y)) < width:
        p, q = word_set(a, width), word_set(b, width)
        return len(p), len(q), len(p & q)
    numbers: dict[bytes, int] = {}
    every = np.array([numbers.setdefault(w, len(numbers)) for w in (*x, *y)])
    grams = every
    for k in range(1, width):
        grams = np.unique(grams[:-1] * len(numbers) + every[k:], return_inverse=True)[1]
    # n-grams across the seam of the two texts are left out
    p, q = np.unique(grams[: len(x) - width + 1]), np.unique(grams[len(x) :])
    return len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs whose sets, made of the words themselves, link."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for ta, tb in zip(batch.column("ta"), batch.column("tb"), strict=True):
                p, q, both = shared_sizes(ta.as_py() or "", tb.as_py() or "", width)
                good.append(both > 0 and 100 * both >= percent * (p + q - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(task, "a long, b long")


def _marks(texts: DataFrame, percent: int, width: int) -> DataFrame:
    """(id, w, n, mark): for each band, bit i of the mark is the parity of the number of tokens dealt to i; there are
    eight bits for each difference that the band allows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for block in blocks(batches, "text"):
            ids, ws, ns, marks = [], [], [], []
            for key, tokens in zip(block.column("id").to_pylist(), token_sets(block.column("text"), width), strict=True):
                for band in bands.of(len(tokens)) if len(tokens) else ():
                    bits = 64 * -(-8 * (bands.most_apart(bands.low[band + 1] - 1) + 1) // 64)
                    at = (mix(tokens + _K1) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)
                    ids.append(key)
                    ws.append(band & 15)
                    ns.append(len(tokens))
                    marks.append(np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1 == 1).view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(m) for m in marks])]).astype(np.int32)
            mark = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *marks])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ws, pa.int32()), pa.array(ns, pa.int64()), mark], names=["id", "w", "n", "mark"])

    return texts.select("id", "text").mapInArrow(task, "id long, w int, n long, mark array<long>")


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, width: int = 3, star_rounds: int = 5) -> DataFrame:
    """Per row: id, n_shingles (set size), component_id (smallest id reachable by links, itself included).

    ``id_col`` is a long and names the document: rows that share an id are one document and each keeps its
    row; of different texts under one id, all take the smallest.  A text that is null or has no word has an empty
    set and links with nothing; a null id gets a null component and links with nothing.  Columns other than the two
    are not read.  An empty table gives no rows.
    """
    spark, made, passed = docs.sparkSession, [], []
    small_batches(spark)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    sketch = stored(_sketches(rows, "long", width), "sketches")
    texts_of = sketch.filter("id is not null").groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi"))
    if not texts_of.filter("lo != hi").isEmpty():
        one = rows.filter("id is not null").groupBy("id").agg(F.min("text").alias("text"))
        rows = stored(rows.filter("id is not null").select("id").join(one, "id").union(rows.filter("id is null")), "rows")
        sketch = stored(_sketches(rows, "long", width), "sketches")
    classes = sketch.filter("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"))
    classes = stored(classes, "classes")  # read twice; and joined rows of one large class can then be split
    named = sketch.select("id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))

    # one text of each class is signed: an unset bit proves that an id stands for none, and the join with the allotment drops what else passes
    spread = spark.sparkContext.broadcast(bitmap(classes.select(F.col("rep").alias("k")), bits_for(classes.count()), hashed=False))
    allotted = _allotted(classes, percent)
    expected = allotted.agg(F.coalesce(F.sum("most"), F.lit(0))).first()[0]
    read = rows.filter("id is not null").select("id", "text")

    def sigs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray]]:
        return ((s,) for _, s in _signatures(percent, width, lambda h: maybe(spread.value, h))(batches))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, s in _signatures(percent, width, lambda h: maybe(spread.value, h))(batches):
            met = maybe(common.value, s)
            yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(s[met].view(np.int64))], names=["id", "sig"])

    # made twice: cheaper than to write and read it; first bare signatures, which are packed, then those that aren't proven to be met once
    shared = stored(tallied(read, sigs, 2, expected).select(F.col("k").alias("sig"), F.col("c").cast("int")), "shared", passed)
    release(spark)
    common = spark.sparkContext.broadcast(bitmap(shared.select(F.col("sig").alias("k")), bits_for(shared.count())))
    own = Window.partitionBy("id", "band")
    chosen = (
        read.mapInArrow(signed, "id long, sig long")
        .join(shared, "sig")
        .withColumn("band", F.col("sig").bitwiseAND(15).cast("int"))
        .join(allotted.drop("most"), ["id", "band"])
        .withColumn("rank", F.row_number().over(own.orderBy("c", "sig")))
        .withColumn("met", F.count("*").over(own))
        .filter("spare + met > 0")
        .select("id", F.col("band").alias("w"), "n", "sig", (F.col("rank") <= F.col("spare") + F.col("met")).alias("chosen"))
    )
    met = stored(chosen, "met", passed)
    for sent in (spread, common):
        sent.destroy()
    release(spark)
    probes = met.filter("chosen").select("id", "w", "n", "sig")
    busy = probes.groupBy("sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo != hi").select("sig")
    probes = stored(probes.join(busy, "sig", "left_semi"), "probes", made)
    discard(spark, passed)
    wanted = probes.select("id").distinct()
    texts = stored(rows.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "texts", made)

    marks = stored(_marks(texts, percent, width), "marks", made)
    other = marks.select("w", F.col("id").alias("other"), F.col("n").alias("m"), F.col("mark").alias("marked"))

    fits = "100 * least(n, m) >= {p} * greatest(n, m)".format(p=percent)
    # a bit that differs is a difference at least
    closer = f"{100 + percent} * aggregate(zip_with(mark, marked, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) <= {100 - percent} * (n + m)"
    # downward links; nodes that hang on the same one are linked, so a step of the components' search a turn tells most
    # pairs that needn't be compared, and only what is compared pairwise waits for all steps
    hung = probes.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)

    def labelled(on: DataFrame) -> DataFrame:
        return probes.join(on, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")

    def linked(pairs: DataFrame) -> tuple[DataFrame, int, int]:
        """The pairs that link; how many there were and how many of them do."""
        pairs = stored(pairs, "pairs", made)
        compared = pairs.count()
        good = stored(_verified(pairs, texts, percent, width), "links", made) if compared else pairs
        return good, compared, good.count() if compared else 0

    def least_of(e: DataFrame) -> DataFrame:
        return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))

    for turn in range(star_rounds):
        now = labelled(least_of(hung)) if turn else probes.withColumn("comp", F.col("id"))
        middle = now.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("other"), F.col("n").alias("m"), F.col("comp").alias("with"))).alias("r")).filter("lo != hi").select("sig", "r.*")
        near = now.join(middle, "sig").filter("comp != with").filter(fits).groupBy(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")).agg(F.min("w").alias("w"))
        good, compared, found = linked(near.join(marks, ["id", "w"]).join(other, ["other", "w"]).filter(closer).select(F.col("id").alias("a"), F.col("other").alias("b")))
        if not found:
            break
        links = good.select(F.col("b").alias("u"), F.col("a").alias("v"))
        hung = stored(starred(hung.union(links) if turn else links), "hung", made)
        release(spark)
        if found < compared / 3:  # the turns left would spare little
            break
    component = connected(hung, a="u", b="v")
    now = labelled(component)
    open_ = now.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("sig")
    # a pair is taken in the least bucket that both are in: the one before which they share none
    before = F.collect_list("sig").over(Window.partitionBy("id", "w").orderBy("sig").rowsBetween(Window.unboundedPreceding, -1))
    left = now.drop("n").join(open_, "sig", "left_semi").join(marks, ["id", "w"]).select("sig", "id", "n", "comp", "mark", before.alias("before"))
    left = stored(left, "left", made)
    # both sides read the same columns, so that Spark shuffles them once
    both = f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n)"
    apart = f"{100 + percent} * aggregate(zip_with(l.mark, r.mark, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) <= {100 - percent} * (l.n + r.n)"
    pairs = left.alias("l").join(left.alias("r"), F.expr(f"l.sig = r.sig and l.id < r.id and l.comp != r.comp and {both} and {apart} and not arrays_overlap(l.before, r.before)"))
    good, _, found = linked(pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct())
    if found:
        component = connected(component.select(F.col("id").alias("a"), F.col("component").alias("b")).union(good))
    discard(spark, made)
    release(spark)
    final = component.select(F.col("id").alias("rep"), F.col("component"))
    return named.join(final, "rep", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
