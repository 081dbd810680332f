"""Packed keys: counts and bitmaps; what the suffix tree and the similarity join spare by them."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallybrook.llm import jaccard_join, packed, suffix_tree
from tallybrook.llm.text import mix


def keys_of(batches):
    for b in batches:
        yield (mix(b.column("v").to_numpy().view(np.uint64)),)


def pairs_of(batches):
    for b in batches:
        x = b.column("v").to_numpy().view(np.uint64)
        yield suffix_tree.joined(x, x + np.uint64(1)), x, x + np.uint64(1)


def test_keys_are_counted_by_ranges_and_bitmaps_hold_all_of_them(spark, monkeypatch):
    monkeypatch.setattr(packed, "FLUSH", 64)
    values = [i * i % 300 for i in range(2000)] + list(range(1000, 1400))
    met = {k: c for k, c in Counter(values).items() if c > 1}
    rows = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    known = {int(mix(np.array([k], np.uint64)).view(np.int64)[0]): c for k, c in met.items()}
    got = packed.tallied(rows, keys_of, 2, len(values))
    assert {r.k: r.c for r in got.collect()} == known
    assert {(r.x, r.s): r.c for r in packed.tallied(rows, pairs_of, 2, len(values), ("x", "s"), suffix_tree.joined).collect()} == {(k, k + 1): c for k, c in met.items()}
    for size in (16, 20, 26):
        bits = packed.bitmap(got, size)
        assert np.array_equal(bits, packed.bitmap_of_tallied(rows, keys_of, 2, 1 << 30, size)) and np.array_equal(bits, packed.bitmap_of_tallied(rows, keys_of, 2, 10, size))
        assert packed.maybe(bits, np.array(list(known), np.int64).view(np.uint64)).all() and np.bitwise_count(bits).sum() <= len(known)
    plain = packed.bitmap(spark.createDataFrame([(k,) for k in met], "k long"), 20, hashed=False)
    assert np.array_equal(plain, packed.bitmap(got, 20))
    assert not packed.bitmap(got.filter("false"), 16).any() and not packed.bitmap_of_tallied(rows.filter("false"), keys_of, 2, 0, 16).any()
    assert np.array_equal(packed.distinct(np.array([3, 1, 3], np.uint64)), [1, 3]) and not len(packed.distinct(np.zeros(0, np.uint64)))


def test_a_block_asks_for_each_word_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b " * 50), (2, "c d e")], "doc_id long, text string")
    heads = suffix_tree.grow(docs, heads=4)[0].heads
    asked = []
    monkeypatch.setattr(suffix_tree, "_find", lambda table, values, old=suffix_tree._find: asked.append(len(values)) or old(table, values))
    suffix_tree._wanted(heads, *suffix_tree.tokens(pa.array(["a b " * 50])))
    assert asked == [3]


def test_copies_are_signed_once(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text) for i in range(20)] + [(50, other), (None, text), (60, None), (61, other + " more")], "doc_id long, text string")
    seen = {}

    def kept(frame, name, paths=None, old=jaccard_join.stored):
        out = old(frame, name, paths)
        if name in ("shared", "met"):
            seen[name] = out.agg(F.count("*").alias("n"), *([F.max("c").alias("c")] if name == "shared" else [])).first()
        return out

    monkeypatch.setattr(jaccard_join, "stored", kept)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar(docs, width=3).collect()}
    assert got == {None: None, 60: 60, 50: 50, 61: 50} | {i: 0 for i in range(20)}
    assert seen["shared"].c == 2  # the two near copies; the twenty exact ones count as one text
