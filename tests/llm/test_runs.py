import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybrook.llm import periodic_runs
from tallybrook.llm.queries import op13_periodic_runs


def stretches(w, least=6, times=4):
    """Every run by trying all periods at all words."""
    out = []
    for q in range(1, len(w) // times + 1):
        same = [i >= q and w[i] == w[i - q] for i in range(len(w))] + [False]
        i = q
        while i < len(w):
            j = i
            while same[j]:
                j += 1
            s, n = i - q, j - i + q
            if j > i and n >= max(least, times * q) and not any(all(w[t] == w[t - p] for t in range(s + p, s + n)) for p in range(1, q)):
                out.append((s, n, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def made(r):
    kinds = r.choice([1, 2, 2, 3, 5])
    w = [r.randrange(kinds) for _ in range(r.randint(0, 80))]
    for _ in range(r.randint(0, 3)):
        if len(w) > 8:
            base, s = [r.randrange(kinds) for _ in range(r.randint(1, len(w) // 3))], r.randrange(len(w) - 3)
            for i in range(s, min(len(w), s + r.randint(3, len(w)))):
                w[i] = base[(i - s) % len(base)]
    return w


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 4), (9, 5)])
def test_diagonals_equal_all_periods(least, times):
    r = random.Random(7)
    for _ in range(400):
        rows = [made(r) for _ in range(r.randint(1, 4))]
        many = np.array([len(x) for x in rows])
        edges, doc = np.append(0, np.cumsum(many)), np.repeat(np.arange(len(rows)), many)
        got = [[] for _ in rows]
        for s, n, q in zip(*periodic_runs.diagonals(np.array(sum(rows, []), dtype=np.int64), doc, edges[1:][doc], least=least, times=times), strict=True):
            got[doc[s]].append((int(s - edges[doc[s]]), int(n), int(q)))
        assert got == [stretches(x, least, times) for x in rows]


def test_one_word_repeated_stays_cheap():
    w = np.zeros(300_000, dtype=np.int64)
    began = time.time()
    assert [x.tolist() for x in periodic_runs.diagonals(w, w, w + len(w), least=6, times=4)] == [[0], [len(w)], [1]]
    assert time.time() - began < 20


def test_edges_of_texts(spark):
    long = " ".join(f"w{i % 700}" for i in range(3500)) + " end"
    texts = ["a a a a a a", "a a a a a", " a\tb a\nb a  b a b ", "", None, " \n ", "A a A a A a A a", "é é é é é é é ü", "a\x00 " * 6, long, "x" * 100_000, "a a a a a a"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "z z z z z z z"), (0, "a a a a a a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", F.lit("x").alias("runs"), F.lit(1).alias("id"), F.lit(2).alias("n_words"))
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs.find_runs(frame).collect())
    want = Counter()
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        runs = [(0, 3500, 700)] if t == long else stretches(w)
        want[i, len(w), tuple(runs), collapsed(w, runs)] += 1
    assert got == want
    assert periodic_runs.find_runs(frame.filter("doc_id < 0")).count() == 0
    with pytest.raises(ValueError, match="times"):
        periodic_runs.find_runs(frame, times=3)


def test_query_equals_brute_force(spark, docs, cases, tmp_path):
    extra = [(i, " ".join(random.Random(i).choices("abcdefgh", k=1 + i % 37)), None, None, None) for i in range(100, 260)]
    frame = docs.union(spark.createDataFrame(extra, docs.schema))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for i, t, *_ in [*cases, *extra]:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            a = (h // 10) % len(w)
            p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
        runs = stretches(w)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want[i, len(runs), *top, top[0] if top[0] is None else 1000 * top[1] // top[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest()] += 1
    assert Counter(map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect())) == want and max(k[1] for k in want) > 0
