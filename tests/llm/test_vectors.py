import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybrook.llm import bit_sliced, components, mixing, multi_index
from tallybrook.llm.components import connected
from tallybrook.llm.queries import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")

KIND = "vec_id long, embedding array<float>"


def made(n=400, d=16, seed=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d)).astype(np.float32)
    x[50:90] = x[50]  # ties
    return [(i, x[i].tolist()) for i in range(n)]


ODD = [(1000, None), (1020, []), (1040, [float("nan")] * 16), (1060, [None] + [1.0] * 15), (1080, [0.0] * 16), (1100, [1.0] * 3), (None, [1.0] * 16), (1120, [float("inf")] * 16)]


def best(rows, query, k, zero_ok, quantise):
    x = {}
    for i, v in rows:
        if i is not None and v and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and (zero_ok or any(v)):
            x[i] = np.array(v, dtype=np.float64)
    f = (lambda v: np.floor(256 * v).astype(np.int64)) if quantise else (lambda v: v)
    scored = sorted(((-(f(x[query]) @ f(v)), i) for i, v in x.items() if i != query))[:k]
    return [(i, -s) for s, i in scored]


def grouped(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_bit_sliced_is_exact(spark):
    rows = made() + ODD
    frame = spark.createDataFrame([*rows, rows[50], rows[100]], KIND).withColumn("id", F.lit(1)).withColumn("v", F.lit("x"))
    for blocks in ({}, {"block_rows": 70, "block_queries": 3}):
        got = grouped(bit_sliced.top_k(frame, k=5, every=50, **blocks))
        assert got == {q: best(rows, q, 5, True, True) for q in [*range(0, 400, 50)]}


def test_bit_sliced_small_tables(spark):
    assert bit_sliced.top_k(spark.createDataFrame([], KIND)).count() == 0
    one = spark.createDataFrame([(0, [0.5]), (1, [-0.25]), (2, [0.25])], KIND)
    assert grouped(bit_sliced.top_k(one, k=5, every=50)) == {0: [(2, 128 * 64), (1, 128 * -64)]}
    assert bit_sliced.top_k(spark.createDataFrame([(0, [1.0])], KIND)).count() == 0


def test_neighbours_recall_and_scores(spark):
    rows = made(1500, 16, 4)
    frame = spark.createDataFrame(rows + ODD, KIND).withColumn("norm", F.lit(1))
    got = grouped(multi_index.neighbours(frame, k=20, every=20, sample_rows=600, block_rows=500, block_queries=40))
    x = dict(rows)
    hits = []
    for q in range(0, 1500, 20):
        want = best(rows, q, 20, False, False)
        hits.append(len({i for i, _ in want} & {i for i, _ in got[q]}) / 20)
        assert len(got[q]) == 20 and all(abs(s - np.dot(np.array(x[q], dtype=float), np.array(x[i], dtype=float))) < 1e-9 for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
    assert np.mean(hits) >= 0.9 and set(got) == set(range(0, 1500, 20))


def test_equal_vectors_tie_in_every_block(spark):
    x = np.random.default_rng(8).standard_normal((600, 33))
    x[100:400] = x[100]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for block_rows in (47, 90, 1000):
        got = grouped(multi_index.neighbours(frame, k=20, every=20, block_rows=block_rows, block_queries=11))
        for q in range(100, 400, 20):
            assert [i for i, _ in got[q]] == [i for i in range(100, 400) if i != q][:20] and len({s for _, s in got[q]}) == 1


def test_lookups_on_structured_codes():
    r = np.random.default_rng(1)
    centres = r.integers(0, 1 << 16, (200, 16)).astype(np.uint16)
    codes = np.repeat(centres, 50, axis=0)
    for _ in range(6):
        codes[np.arange(len(codes)), r.integers(0, 16, len(codes))] ^= (1 << r.integers(0, 16, len(codes))).astype(np.uint16)
    index = multi_index.MultiIndex(codes)
    for q in range(0, 10_000, 500):
        far = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
        assert index.within(codes[q], 16).tolist() == np.flatnonzero(far <= 16).tolist()
    assert index.probed < len(codes)  # twenty scans would be 20 times as many


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_registered_search_against_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = grouped(queries()["op8_nearest"](spark, FOLDER))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = []
    for q, found in got.items():
        scores = (x * x[ids == q][0]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        hits.append(len({int(ids[i]) for i in order} & {i for i, _ in found}) / 20)
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and all(s == scores[ids == i][0] for i, s in found)
    assert np.mean(hits) >= 0.9


def test_neighbours_small_tables(spark):
    assert multi_index.neighbours(spark.createDataFrame([], KIND)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0])], KIND)
    assert grouped(multi_index.neighbours(few)) == {0: [(1, 0.5)]}


def test_probing_finds_every_code_in_the_radius():
    r = np.random.default_rng(3)
    codes = r.integers(0, 1 << 16, (500, 8)).astype(np.uint16)
    codes[:100] = codes[0] ^ (1 << r.integers(0, 16, (100, 8))).astype(np.uint16)
    index = multi_index.MultiIndex(codes)
    for radius in (0, 5, 9, 30, 50, 60):
        far = np.bitwise_count(codes ^ codes[7]).sum(axis=1)
        assert index.within(codes[7], radius).tolist() == np.flatnonzero(far <= radius).tolist()


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    label = {}
    for a, b in pairs:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a is not None and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert {x.id: x.component for x in connected(spark.createDataFrame(pairs, "a long, b long")).collect()} == label


def test_stars_are_components_at_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "stored", lambda frame, name, made=None, old=components.stored: written.append(name) or old(frame, name, made))
    links = spark.createDataFrame([(1, i) for i in range(2, 9)] + [(30, 10), (20, 10)], "a long, b long")
    assert {x.id: x.component for x in connected(links).collect()} == {i: 1 for i in range(1, 9)} | {i: 10 for i in (10, 20, 30)}
    assert len(written) == 1  # no steps that change nothing


# 9


def fill(children, budget):
    """Water filling by repeated redistribution: {name: (cap, weight)} -> {name: share}."""
    share, open_ = dict.fromkeys(children, 0.0), {k for k, (c, w) in children.items() if w > 0 and c > 0}
    left = min(budget, sum(children[k][0] for k in open_))
    while open_ and left > 1e-9:
        total = sum(children[k][1] for k in open_)
        given = {k: left * children[k][1] / total for k in open_}
        left = 0.0
        for k, g in given.items():
            room = children[k][0] - share[k]
            share[k] += min(room, g)
            left += max(0.0, g - room)
        open_ = {k for k in open_ if share[k] < children[k][0] - 1e-9}
    return share


def test_budgets_equal_redistribution(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randrange(0, 40)), r.choice("AAAAB"), r.choice(["x", "y", "z"]), r.choice(["s1", "s2"])) for i in range(400)] + [(400, None, None, None, None), (7, "again", "B", "x", "s1")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, a string, b string, c string")
    weights = {"a": {"A": 1.0, "B": 3.0}, "b": {"x": 2.0, "z": 0.0}}
    levels = {k: frame[k] for k in "abc"}
    got = mixing.mix(frame, levels, weights=weights, budget_share=0.7, max_epochs=2, seed=4).collect()
    leaf = lambda x: tuple(x[i] or "(none)" for i in (2, 3, 4))
    tokens, total = {}, 0
    for x in rows:
        n = len((x[1] or "").split())
        tokens[leaf(x)] = tokens.get(leaf(x), 0) + n
        total += n
    budgets = {(): 0.7 * total}
    for depth, name in enumerate("abc"):
        new = {}
        for parent, budget in budgets.items():
            kids = {p[: depth + 1] for p in tokens if p[:depth] == parent}
            new |= fill({k: (2.0 * sum(t for p, t in tokens.items() if p[: depth + 1] == k), weights.get(name, {}).get(k[-1], 1.0)) for k in kids}, budget)
        budgets = new
    taken = {}
    for g in got:
        taken.setdefault((g.a, g.b, g.c), []).append(g)
    for path, budget in budgets.items():
        used = sum(g.n_tokens * g.n_copies for g in taken[path])
        longest = max(g.n_tokens for g in taken[path])
        assert used <= budget + 1e-3 and (used > budget - longest - 41 or used == 2 * tokens[path])
        assert len({g.n_copies for g in taken[path] if g.n_tokens}) <= 2
    assert len(got) == len(rows) and all(g.n_copies == 0 for g in got if not g.n_tokens)
    again = mixing.mix(frame.repartition(5), levels, weights=weights, budget_share=0.7, max_epochs=2, seed=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(frame.limit(0), {k: frame.limit(0)[k] for k in "abc"}).count() == 0


def test_prefix_is_in_epoch_order(spark):
    import hashlib

    frame = spark.createDataFrame([(i, "a b c d", "x") for i in range(100)], "doc_id long, text string, s string")
    got = {g.doc_id: g.n_copies for g in mixing.mix(frame, {"s": frame["s"]}, budget_share=0.253, max_epochs=1, seed=9).collect()}
    order = sorted(range(100), key=lambda i: hashlib.md5(f"9:0:{i}".encode()).hexdigest())
    assert [i for i in order if got[i]] == order[:25]


def clustered(seed: int, rows: int, clusters: int, d: int = 32, spread: float = 0.12):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((clusters, d))
    x = centres[r.integers(0, clusters, rows)] + spread * r.standard_normal((rows, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_radius_follows_the_table_and_probes_few_rows(spark):
    x = clustered(3, 6000, 150)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    coder = multi_index.fit(x[:500], 1.0, bits=256)
    coder.radius = multi_index.radius_of(frame, coder, np.arange(0, 500, 4), x[:500:4], k=20, target=0.98)
    index = multi_index.MultiIndex(coder.rows(x))
    exact = x @ x.T
    np.fill_diagonal(exact, -np.inf)
    hit = 0
    for q in range(0, 6000, 60):
        near = index.within(coder.queries(x[q : q + 1])[0], coder.radius)
        hit += len(set(near.tolist()) & set(np.argsort(-exact[q])[:20].tolist()))
    assert hit / 2000 > 0.9 and index.probed < 100 * 6000 / 3


def test_clustered_vectors_and_lonely_queries(spark):
    x = np.concatenate([clustered(5, 1500, 40), np.random.default_rng(6).standard_normal((60, 32))])
    x[1500:] /= np.linalg.norm(x[1500:], axis=1, keepdims=True)
    order = np.random.default_rng(7).permutation(len(x))  # lonely ones among the queries
    frame = spark.createDataFrame([(i, x[j].tolist()) for i, j in enumerate(order)], "vec_id long, embedding array<double>")
    got = grouped(multi_index.neighbours(frame, k=20, every=10, sample_rows=400, block_rows=400, block_queries=50))
    y = x[order]
    assert set(got) == set(range(0, len(y), 10)) and all(len(v) == 20 for v in got.values())
    hit = 0
    for q, found in got.items():
        exact = y @ y[q]
        exact[q] = -np.inf
        hit += len({i for i, _ in found} & set(np.argsort(-exact)[:20].tolist()))
    assert hit / 20 / len(got) > 0.9
