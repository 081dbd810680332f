"""Tables of questions against one question after the other, on times around hour and bucket bounds."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallybrook.operators import analytics as an

NOW = datetime.datetime(2024, 3, 3, 7, 30)


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(4)
    hour = datetime.timedelta(hours=1)
    rows = []
    for i in range(500):
        back = r.choice([0, 1, 2, 15, 16, 17, 24, 31, 32, 255, 256, 257, 4096, 9000]) * hour + r.choice([0, 0, 1, -1]) * datetime.timedelta(seconds=r.choice([0, 1, 1800]))
        at = None if i % 23 == 0 else NOW - back
        rows.append((i, r.choice(["open", "closed", "on_hold", "filled"]), at, r.choice(["x", "y", None]), r.choice(["Ann", None, an.NOT_STATED]), r.choice([None, 1.0, 2.0]), r.choice([None, 5.0, 7.0, 9.0]), i % 13 == 0))
    entities = spark.createDataFrame(rows, "entity_id long, status string, created_at timestamp, team string, owner_name string, range_min double, range_max double, is_deleted boolean")
    asks = [(q, r.choice(["open", "closed", "any", None, "on_hold", "nothing"]), r.choice([None, 0, 1, 2, 11, 171, 365]), r.choice([None, None, 0, 1, 16, 17, 256, 720]), r.choice(["team", "status", "owner", None, "salary"])) for q in range(80)]
    return entities, spark.createDataFrame(asks, "query_id long, status string, days int, hours int, group_by string"), rows, asks


def fitting(ask, rows, default=None, timed=True):
    _, status, days, hours, _ = ask
    since = NOW - datetime.timedelta(hours=hours) if hours else NOW - datetime.timedelta(days=days or default) if days or default else None
    want = status or "any"
    return [e for e in rows if not e[7] and (want == "any" or e[1] == want or want == "open" and e[1] != "closed") and (not timed or since is None or e[2] is not None and e[2] >= since)]


def test_counts(world):
    entities, queries, rows, asks = world
    got = {r.query_id: r.n for r in an.answer_counts(queries, entities, F.lit(NOW)).collect()}
    assert got == {a[0]: len(fitting(a, rows)) for a in asks} and len(set(got.values())) > 8
    assert {r.n for r in an.answer_counts(queries, entities.limit(0), F.lit(NOW)).collect()} == {0}


def test_newest(world):
    entities, queries, rows, asks = world
    got = sorted((r.query_id, r["rank"], r.entity_id) for r in an.answer_recent(queries, entities, F.lit(NOW)).collect())
    order = lambda e: (e[2] is not None, -e[2].timestamp() if e[2] else 0, e[0])
    assert got == sorted((a[0], i, e[0]) for a in asks for i, e in enumerate(sorted(fitting(a, rows, 7), key=order)[:10], 1))


def test_highest(world):
    entities, queries, rows, asks = world
    got = sorted((r.query_id, r["rank"], r.entity_id) for r in an.answer_ranges(queries, entities, F.lit(NOW), 6).collect())
    order = lambda e: (-(e[6] or -1), -(e[5] or -1), e[0])
    there = [e for e in rows if e[5] is not None or e[6] is not None]
    assert got == sorted((a[0], i, e[0]) for a in asks for i, e in enumerate(sorted(fitting(a, there), key=order)[:6], 1))


def test_groups(world):
    entities, queries, rows, asks = world
    got = {(r.query_id, r.label): r.n for r in an.answer_groups(queries, entities, F.lit(NOW)).collect()}
    want = {}
    for a in asks:
        for e in fitting(a, rows, timed=False):
            label = {"team": e[3], "status": e[1], "owner": e[4], None: e[3]}.get(a[4]) or an.NOT_STATED
            want[a[0], label] = want.get((a[0], label), 0) + 1
    assert got == want


def test_plans_join_no_entities_by_status_alone(world):
    entities, queries, *_ = world
    for answer in (an.answer_counts, an.answer_ranges, an.answer_groups):
        plan = answer(queries, entities, F.lit(NOW))._jdf.queryExecution().optimizedPlan().toString()
        assert "Cartesian" not in plan and all("bucket" in line or "hour" in line or "ask" in line or "key" in line for line in plan.split("\n") if "Join Inner" in line)
