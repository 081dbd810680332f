import os
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybrook.llm import neighbour_votes as nv
from tallybrook.llm.queries import op11_quality
from tallybrook.llm.text import in_fold

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(2)
    words = [f"{a}{b}" for a in ("ri", "sto", "clou", "li", "ga", "wi") for b in ("ver", "ne", "d", "ght", "rden", "nter")]
    rows, marks = [], []
    for i in range(300):
        good = i % 3 > 0
        w = r.choices(words, k=40)
        text = " ".join(w).capitalize() + "." if good else " ".join(x + "%%" for x in w) if i % 2 else " ".join(x for x in w[:6] for _ in range(7))
        rows.append((i, text))
        marks.append((i, int(good)))
    marks += [(5, None), (None, 1), (9999, 0), (7, 3), (8, 0), (8, 1)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (None, rows[0][1]), (4, rows[4][1]), (1003, "x" * 200_000), (1004, rows[1][1] + " ")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({"label": F.lit("x"), "key": F.lit("y"), "score": F.lit(1), "id": F.lit(2)}), spark.createDataFrame(marks, "doc_id long, quality int").withColumn("text", F.lit("z")), rows


def test_terms_of_a_text():
    a = nv.term_counts(pa.array(["Ab ab  AB x1.\nx1. x1.", None, "", "  "]))
    s, p, t = nv._BINS[0], nv._BINS[0] + nv._BINS[1], sum(nv._BINS[:3])
    assert a.shape == (4, nv.BINS) and not a[1:].any()
    assert [a[0, :s].sum(), a[0, s:p].sum(), a[0, p], a[0, p + 1], a[0, t:].sum()] == [6, 5, 4, 1, 6]
    b = nv.term_counts(pa.array(["Xyz xyz XYZ q77.\nq7. q7."]))
    assert (a[0, :p] == b[0, :p]).all()  # the same shapes


def test_scores_equal_plain_votes(labelled):
    docs, marks, rows = labelled
    m = nv.learn(docs, marks)
    assert len(m.labels) == 300 and m.vectors.shape == (300, 32)
    plain = {}
    for _, text in rows:
        c = nv.term_counts(pa.array([text]))[0].astype(np.float64)
        x = np.log1p(c) * m.space.idf
        x = x / np.linalg.norm(x) if x.any() else x
        x = x @ m.space.axes.astype(np.float64)
        if np.linalg.norm(x) < 1e-9:
            plain[text] = [m.rate]
            continue
        near = m.vectors.astype(np.float64) @ (x / np.linalg.norm(x))
        order = np.argsort(-near)
        few = {k: [i for i in order if near[i] >= near[order[24]] + k and near[i] > 0] for k in (-2e-5, 2e-5)}
        plain[text] = [(sum(near[i] ** 2 * m.labels[i] for i in few[k]) + 0.5 * m.rate) / (sum(near[i] ** 2 for i in few[k]) + 0.5) for k in few]
    got = nv.score(docs, m).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    text_of = dict(rows)
    exact = 0
    for r in got:
        lo, hi = min(plain[text_of[r.doc_id]]), max(plain[text_of[r.doc_id]])
        exact += lo - 1e-4 <= r.score <= hi + 1e-4
        assert 0 <= r.score <= 1
    assert exact >= 0.97 * len(got)  # the rest ties at the rounding of cosines
    by = {r.doc_id: r.score for r in got}
    assert by[1000] == by[1001] == by[1002] == pytest.approx(m.rate) and by[1004] == pytest.approx(by[1], abs=1e-4)
    assert min(by[i] for i in range(300) if i % 3 > 0) > max(by[i] for i in range(300) if i % 3 == 0)


def test_bounds_and_empty_tables(labelled):
    docs, marks, rows = labelled
    m = nv.learn(docs, marks, memory=40, fit=20)
    assert m.vectors.shape[0] == 40
    none = nv.learn(docs, marks.filter("doc_id < 0"))
    assert {r.score for r in nv.score(docs, none).collect()} == {0.5}
    assert nv.score(docs.filter("doc_id < 0"), m).count() == 0
    assert nv.score(docs.filter("doc_id < 0"), nv.learn(docs.filter("doc_id < 0"), marks)).count() == 0


def test_ties_all_vote():
    x = np.eye(4, dtype=np.float32)
    m = nv.Memory(nv.Space(np.ones(1), np.ones((1, 1))), x[[0, 0, 0, 1]], np.array([1, 0, 1, 0], dtype=np.float32), 0.25)
    assert nv.votes(x[:1], m, k=1, power=2, steady=0)[0] == pytest.approx(2 / 3)
    assert nv.votes(x[2:3], m, k=2, power=2, steady=1)[0] == 0.25


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op11_quality(spark, FOLDER).collect()}
    truth = duckdb.sql(f"SELECT d.doc_id, quality FROM '{FOLDER}/documents.parquet' AS d LEFT JOIN '{FOLDER}/labels.parquet' USING (doc_id)").fetchall()
    assert {i for i, _ in truth} == set(got)
    assert all(r.held_out == in_fold(i, 5, 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[i].predicted, q) for i, q in truth if q is not None and got[i].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95 and np.mean([a for a, b in held if b == 1]) > 0.98
