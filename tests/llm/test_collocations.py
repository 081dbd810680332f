import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybrook.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest=4):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", " ".join(w[i : i + k])] += 1
    return n, f


def ranked(rows, support, top, absorbed=80):
    n, f = counted(rows)
    many = {k: v for k, v in f.items() if v >= support}
    out = {}
    for (lang, phrase), a in many.items():
        w = phrase.split(" ")
        if len(w) < 2:
            continue
        if any(g == lang and len(q.split(" ")) > len(w) and f" {phrase} " in f" {q} " and 100 * b >= absorbed * a for (g, q), b in many.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, " ".join(w[:c])] + f[lang, " ".join(w[c:])]), c) for c in range(1, len(w))]
        score, c = min(cuts)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), f[lang, " ".join(w[:c])], f[lang, " ".join(w[c:])]))
    return {(lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    kinds = ["a", "b", "C", "d", "é", "É", "日本", "x" * 300, "e-f", "g\x00", "h"]
    out = []
    for i in range(240):
        parts = [r.choice(["A b c d", "b C a", "a b", "é é é é é"]) if r.random() < 0.4 else r.choice(kinds) for _ in range(r.randint(0, 30))]
        out.append((i if i % 7 else None, "".join(p + r.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "!?", "\r\n", "\x0b"]) for p in parts), r.choice(["en", "fr", None, "und"])))
    return [*out, (1, None, "en"), (1, None, None), (2, "", "xx"), (3, " .,;\n ", "yy"), *[(900, "copy of a text that stands here", "en")] * 40, (901, "lonely", "zz")]


@pytest.mark.parametrize(("support", "share", "slack"), [(5, 0.25, 0.3), (12, 0.0, 0.3), (3, 1.0, 1.0), (5, 0.5, 20.0)])
def test_mining_equals_counting(spark, rows, support, share, slack):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5).withColumns({"phrase": F.lit("x"), "f": F.lit(1), "key": F.lit(2), "id": F.lit(3)})
    got, passes = co.frequent(frame, support=support, share=share, slack=slack)
    got = {(r.lang, r.phrase): (r.words, r.f) for r in got.collect()}
    n, f = counted(rows)
    want = {k: (k[1].count(" ") + 1, v) for k, v in f.items() if v >= support} | {(lang, ""): (0, v) for lang, v in n.items() if v}
    assert got == want
    assert passes == (1 if share == 1.0 else 4) or 0 < share < 1 and 1 <= passes <= 4


@pytest.mark.parametrize(("support", "top", "absorbed"), [(4, 2000, 80), (6, 5, 50)])
def test_ranks_equal_brute_force(spark, rows, support, top, absorbed):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = [tuple(r) for r in co.collocations(frame, support=support, top=top, absorbed=absorbed).collect()]
    assert len(got) == len(set(got)) and set(got) == ranked(rows, support, top, absorbed)


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_filter_holds_its_keys(spark):
    keys = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 5000)
    made = co.Proposed.of(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert made.has(keys.view(np.uint64)).all() and made.size == 17
    other = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 100_000).view(np.uint64)
    assert made.has(other).mean() < 0.03
