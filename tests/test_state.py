import datetime
import json

import pytest
from pyspark.sql import functions as F

from tallybrook.operators import analytics as an
from tallybrook.operators import context as cx
from tallybrook.operators import dialogs as dl
from tallybrook.operators import models as md
from tallybrook.operators import resolve as rs
from tallybrook.operators import retrieve as rt
from tallybrook.operators import revisions as rv
from tallybrook.operators import vectors as vc
from tallybrook.operators.components import connected
from tallybrook.sources import schemas
from tallybrook.streaming import pipeline as st

ENTITY = "entity_id string, title string, status string, range_min int, range_max int, currency string, owner_name string, team string, is_deleted boolean, created_at string"


def _entities(spark, rows):
    return spark.createDataFrame(rows, ENTITY).withColumn("created_at", F.col("created_at").cast("timestamp"))


ROWS = [
    ("e1", "a", "open", 1, 5, "RUB", "x", "Core", False, "2024-05-01"), ("e2", "b", "on_hold", None, 9, None, None, None, False, "2024-05-02"), ("e3", "c", "closed", None, None, "USD", "x", an.NOT_STATED, False, None),
    ("e4", "d", "open", 2, 7, "RUB", "y", "Core", True, "2024-05-03"),
]


def test_analytics_skip_deleted_and_count_on_hold_as_open(spark):
    e = _entities(spark, ROWS)
    assert an.count_entities(e).first().n == 3
    assert an.count_entities(e, status="open").first().n == 2
    assert [(r.label, r.n) for r in an.group_count(e, "team").collect()] == [(an.NOT_STATED, 2), ("Core", 1)]
    assert [r.entity_id for r in an.list_ranges(e).collect()] == ["e2", "e1"]
    assert [r.currency for r in an.mode_currency(e).collect()] == ["RUB"]
    with pytest.raises(ValueError):
        an.group_count(e, "salary")


def test_hours_win_over_days(spark):
    e = _entities(spark, ROWS)
    now = F.lit("2024-05-02 12:00:00").cast("timestamp")
    assert an.count_entities(e, days=30, hours=13, as_of=now).first().n == 1


def test_empty_table(spark):
    e = _entities(spark, ROWS).limit(0)
    assert an.count_entities(e).first().n == 0 and an.group_count(e, "team").count() == 0 and an.list_recent(e).count() == 0


@pytest.mark.parametrize(
    ("n", "match", "c", "action", "expected"),
    [(0, None, None, "create", ("insert", None)), (0, None, None, "update", ("unmatched", None)), (2, "e", 0.6, "create", ("update", "e")), (2, "e", 0.9, "close", ("close", "e")), (2, None, 0.9, "create", ("insert", None)), (2, "e", 0.59, "create", ("pending", "e")), (2, "", 0.9, "close", ("unmatched", None))],
)
def test_decision_table(spark, n, match, c, action, expected):
    row = spark.createDataFrame([(n, match, c, action)], "n int, m string, c double, a string").select(rs.decide_action(F.col("a"), F.col("n"), F.col("m"), F.col("c")).alias("x")).first().x
    assert tuple(row) == expected


def _updates(spark, rows):
    return spark.createDataFrame(rows, "key string, seq long, action string, fields map<string,string>")


def test_presence_is_not_null(spark):
    u = _updates(spark, [("a", 1, "create", {"team": "x", "amount": "1"}), ("a", 2, "update", {"team": None}), ("a", 3, "update", {})])
    row = rv.fold_entities(u, ["team", "amount"], ["key"]).first()
    assert (row.team, row.amount, row.status, row.n_updates) == (None, "1", "open", 3)
    diffs = {r.seq: (r.changed_field, r.old_value, r.new_value) for r in rv.diff_revisions(u, ["team", "amount"], ["key"]).collect()}
    assert diffs[1][:2] == (None, None) and json.loads(diffs[1][2]) == {"team": "x", "amount": "1"} and diffs[2] == ("team", '{"team":"x"}', '{"team":null}') and diffs[3] == (None, None, None)


def test_diffs_name_columns_and_closes(spark):
    u = _updates(spark, [("a", 1, "create", {"salary_max": "5", "status": "on_hold", "other": "é"}), ("a", 2, "update", {"salary_max": "7", "title": 'say "x"'}), ("a", 3, "close", {"salary_max": "7"}), ("b", 1, "update", {"salary_max": "9"}), ("b", 2, "close", {})])
    state = spark.createDataFrame([("b", 9, "t", "filled")], "key string, range_max int, title string, status string")
    rows = rv.diff_revisions(u, {"title": "title", "salary_max": "range_max"}, ["key"], kinds={"range_max": "int"}, state=state)
    got = {(r.key, r.seq): (r.changed_field, r.old_value, r.new_value) for r in rows.collect()}
    first = got.pop(("a", 1))
    assert first[:2] == (None, None) and json.loads(first[2]) == {"salary_max": "5", "status": "on_hold", "other": "é"} and "é" in first[2]
    assert got == {
        ("a", 2): ("title, range_max", '{"title":null,"range_max":5}', '{"title":"say \\"x\\"","range_max":7}'),
        ("a", 3): ("status", '{"status":"on_hold"}', '{"status":"closed"}'), ("b", 1): (None, None, None), ("b", 2): ("status", '{"status":"filled"}', '{"status":"closed"}'),
    }


def test_entities_after_a_close_take_nothing(spark):
    ddl = "entity_id string, seq long, action string, fields map<string,string>, embedding array<float>, last_message_id string, confidence double, at timestamp, entity_ref string, author_id string, author_name string"
    at = datetime.datetime(2024, 5, 1)
    step = lambda e, i, a, f: (e, i, a, f, [float(i)], f"m{i}", 0.5, at, "ref", "u1", "Ann")
    rows = [step("a", 1, "create", {"salary_max": "5", "owner": ""}), step("a", 2, "close", {"team": "x"}), step("a", 3, "update", {"salary_max": "9", "title": "late"}), step("b", 1, "create", {"title": None, "currency": None}), step("b", 2, "update", {"title": None, "owner": "Bo"})]
    made = rv.write_entities(spark.createDataFrame([], schemas.ENTITIES_DDL), spark.createDataFrame(rows, ddl))
    got = {r.entity_id: (r.title, r.status, r.range_max, r.currency, r.owner_id, r.owner_name, r.team, list(r.embedding), r.last_message_id) for r in made.collect()}
    assert got == {"a": ("ref", "closed", 5, "RUB", "u1", "Ann", "x", [1.0], "m2"), "b": (None, "open", None, "RUB", "u1", "Bo", None, [2.0], "m2")}
    again = rv.write_entities(made, spark.createDataFrame([step("a", 9, "update", {"salary_max": "1"}), step("b", 9, "update", {"owner": None})], ddl))
    got = {r.entity_id: (r.range_max, r.owner_name, r.last_message_id) for r in again.collect()}
    assert got == {"a": (5, "Ann", "m2"), "b": (None, None, "m9")}


def test_status_counts_at_creation_only(spark):
    u = _updates(spark, [("a", 1, "create", {"status": "on_hold"}), ("a", 2, "update", {"status": "filled"}), ("b", 1, "create", {}), ("b", 2, "close", {})])
    assert {r.key: r.status for r in rv.fold_entities(u, [], ["key"]).collect()} == {"a": "on_hold", "b": "closed"}


def test_orphans(spark):
    r = spark.createDataFrame([("e1", "m1"), ("e2", "m1"), ("e2", "m2"), ("e3", None)], "entity_id string, source_message_id string")
    m = spark.createDataFrame([("m1", True), ("m2", False)], "message_id string, is_deleted boolean")
    assert [x.entity_id for x in rv.orphan_entities(r, m).collect()] == ["e1"]
    assert {x.entity_id: x.n_live for x in rv.live_source_count(r, m).collect()} == {"e1": 0, "e2": 1, "e3": 0}


def test_story_of_one_entity(spark):
    texts = ["The canteen has soup today", "Looking for surveyor, from 90k, for team Quarry", "Surveyor: changed to from 95", "Position surveyor is filled"]
    rows = spark.createDataFrame([(f"m{i}", t) for i, t in enumerate(texts)], "message_id string, text string")
    got = {r.message_id: r for r in md.extract_fields(rows).collect()}
    assert [got[f"m{i}"].action for i in range(4)] == ["none", "create", "update", "close"]
    assert got["m1"].fields["salary_min"] == "90000" and got["m2"].fields["salary_min"] == "95000" and got["m1"].fields["team"] == "Quarry"
    assert "salary_max" not in got["m1"].fields
    u = rows.join(md.extract_fields(rows).drop("text"), "message_id").filter("action != 'none'")
    updates = u.select(F.lit("e1").alias("entity_id"), F.substring("message_id", 2, 1).cast("long").alias("seq"), "action", "fields", F.array(F.lit(1.0).cast("float")).alias("embedding"), F.col("message_id").alias("last_message_id"), "confidence", F.current_timestamp().alias("at"))
    state = rv.write_entities(spark.createDataFrame([], schemas.ENTITIES_DDL), updates).collect()
    assert len(state) == 1 and (state[0].status, state[0].range_min, state[0].currency, state[0].last_message_id) == ("closed", 95000, "RUB", "m3")
    log = rv.diff_revisions(updates.withColumnRenamed("entity_id", "key"), {"salary_min": "range_min"}, ["key"], kinds={"range_min": "int"}).orderBy("seq").collect()
    assert [r.changed_field for r in log] == [None, "range_min", "status"]


def test_context_falls_back_to_space(spark):
    rows = [("m1", "t1", "s1", 1), ("m2", None, "s1", 2), ("m3", "t1", "s1", 3), *((f"n{i}", None, "s2", i) for i in range(10))]
    m = spark.createDataFrame(rows, "message_id string, thread_id string, space_id string, created_at int")
    got = {r.message_id: r for r in cx.attach_context(m, item=F.col("message_id")).collect()}
    assert got["m3"].extract_context == ["m1"] and got["m2"].prefilter_context == ["m1"]
    assert got["n9"].prefilter_context == [f"n{i}" for i in range(2, 9)] and got["n9"].extract_context == ["n6", "n7", "n8"]


def test_context_of_a_large_space_over_several_tasks(spark):
    rows = [(f"m{i:03}", f"t{i % 50}" if i % 3 else None, "busy" if i % 5 else None if i % 2 else f"s{i % 4}", i // 2 if i % 7 else None, f"a{i}", f"x{i}") for i in range(400)]
    m = spark.createDataFrame(rows, "message_id string, thread_id string, space_id string, created_at int, author_name string, text string")
    show = lambda d: {r.message_id: ([x.message_id for x in r.space_context], [x.message_id for x in r.extract_context]) for r in d.collect()}
    one, many = cx.attach_context(m), cx.attach_context(m, chunk_rows=30)
    assert many.columns == one.columns and many.count() == 400
    assert show(one) == show(many)
    assert show(cx.attach_context(m, chunk_rows=3)) == show(one)  # ranges shorter than the window
    dealt = m.repartitionByRange(14, "space_id", "created_at", "message_id").filter("space_id = 'busy'").select(F.spark_partition_id().alias("p")).distinct()
    assert dealt.count() > 5


def test_knn_blocks_equal_one_block(spark):
    import random

    random.seed(1)
    v = spark.createDataFrame([(i, [random.gauss(0, 1) for _ in range(6)] if i % 9 else None) for i in range(90)], "id long, vector array<double>")
    q, c = v.filter("id < 30").withColumnRenamed("id", "query_id"), v.withColumnRenamed("id", "item_id")
    one = [(r.query_id, r.item_id, r.rank) for r in vc.knn_join(q, c, 3).collect()]
    many = [(r.query_id, r.item_id, r.rank) for r in vc.knn_join(q, c, 3, block_rows=20, block_queries=7).collect()]
    assert sorted(one) == sorted(many) and all(a == b for a, b, r in one if r == 1)
    assert vc.recall(vc.ann_join(q, c, 3, lists=4, probes=4), vc.knn_join(q, c, 3)).first().recall == 1.0


def test_profile_match_looks_past_near_entities_that_do_not_fit(spark):
    rows = [(i, False, "open", [1.0, i / 1000], 10.0 if i < 40 else None if i == 43 else 100.0) for i in range(50)] + [(50, False, "closed", [1.0, 0.0], 100.0)]
    e = spark.createDataFrame(rows, "entity_id long, is_deleted boolean, status string, embedding array<double>, range_max double")
    p = spark.createDataFrame([(1, [1.0, 0.0], 50.0), (2, [1.0, 0.0], None), (3, [1.0, 0.0], 1000.0)], "query_id long, vector array<double>, wanted double")
    got = sorted((r.query_id, r["rank"], r.item_id) for r in rt.profile_match(p, e).collect())
    assert got == [(1, 1, 40), (1, 2, 41), (1, 3, 42), (2, 1, 0), (2, 2, 1), (2, 3, 2), (3, 1, 43)]


def test_canonical_create_is_the_earliest(spark):
    rows = [("a", 3, [1.0, 0.0]), ("b", 1, [0.99, 0.01]), ("c", 2, [0.0, 1.0])]
    got = rs.canonicalise_creates(spark.createDataFrame(rows, "query_id string, seq long, vector array<double>"))
    assert {r.query_id: r.canonical_id for r in got.collect()} == {"a": "b", "b": "b", "c": "c"}


def test_canonical_creates_of_long_chains_and_large_groups(spark):
    chain = [(f"c{i:02}", i, [1.0 if j in (i, i + 1) else 0.0 for j in range(61)] + [0.0] * 3) for i in range(60)]
    bent = lambda *x: [0.0] * 61 + list(x)
    groups = [(f"g{i:02}", 100 + i, bent(1.0, i % 25 / 1e4, 0.0) if i < 25 else bent(i % 25 / 1e4, 1.0, 0.0)) for i in range(50)]
    rows = [*chain, *groups, ("h", 200, bent(0.6, 0.5, 0.62)), ("i", 201, bent(1.0, 0.0, 0.0)), ("j", 90, bent(1.0, 0.0, 0.0)), ("k", 1, None), ("l", 2, bent(0.0, 0.0, 0.0))]
    d = spark.createDataFrame(rows, "query_id string, seq long, vector array<double>")
    got = {r.query_id: r.canonical_id for r in rs.canonicalise_creates(d, threshold=0.4).collect()}
    assert got == {q: {"c": "c00", "k": "k", "l": "l"}.get(q[0], "j") for q, *_ in rows}
    links = vc.linked(d.withColumnRenamed("query_id", "item_id"), 0.4, block_rows=20).collect()
    label = {q: q for q, *_ in rows}
    for _ in rows:
        for r in links:
            label[r.query_id] = label[r.item_id] = min(label[r.query_id], label[r.item_id])
    assert label == {q: {"c": "c00", "k": "k", "l": "l"}.get(q[0], "g00") for q, *_ in rows}


def _clustered(rows, clusters, size, seed, spread):
    import numpy as np

    r = np.random.default_rng(seed)
    centres = r.standard_normal((clusters, size))
    x = centres[r.integers(0, clusters, rows)] + spread * r.standard_normal((rows, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("clusters", "spread", "threshold"), [(40, 0.15, 0.75), (5, 0.02, 0.9), (30, 0.6, 0.5), (1, 3.0, 0.2)])
def test_links_by_cells_have_the_components_of_all_pairs(spark, clusters, spread, threshold):
    import numpy as np

    x = _clustered(900, clusters, 12, 3, spread)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, vector array<double>").repartition(3)
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(np.round(x @ x.T, 12) > threshold), strict=True):
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    want = {i: root(i) for i in range(len(x)) if any(root(j) == root(i) for j in range(len(x)) if j != i)}
    for rows in (60, 2048):
        links = vc.linked(frame, threshold, block_rows=rows)
        assert {r.node: r.root for r in connected(links, "query_id", "item_id").collect()} == want


def test_few_pairs_of_clustered_vectors_are_compared(spark):
    x = _clustered(6000, 60, 24, 4, 0.05)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, vector array<double>")
    cells = vc.into_cells(frame, 0.75, cell_rows=50)
    few = vc.compared(cells, block_rows=200)
    assert few < 0.2 * 6000**2 / 2
    loose = _clustered(600, 1, 24, 4, 3.0)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(loose)], "item_id long, vector array<double>")
    assert vc.compared(vc.into_cells(frame, 0.75, cell_rows=50), block_rows=200) <= 600**2


def test_query_intent_ranges(spark):
    q = spark.createDataFrame([(1, "Сколько открытых вакансий за 30 дней?"), (2, "Покажи закрытые за 400 дней"), (3, None), (4, "График по командам")], "query_id int, text string")
    got = {r.query_id: r for r in md.classify_queries(q).collect()}
    assert (got[1].kind, got[1].status, got[1].days) == ("count", "open", 30)
    assert (got[2].kind, got[2].days, got[3].kind) == ("search", None, "search") and (got[4].kind, got[4].group_by) == ("chart", "team")


def test_dialog_windows(spark):
    lengths = spark.range(16).select(F.col("id"), dl.window_length(F.col("id")).alias("n")).collect()
    held, expected = 0, [0]
    for _ in range(15):
        held = held + 2
        held = 6 if held >= 12 else held
        expected.append(held)
    assert [r.n for r in lengths] == expected


def test_compaction_keeps_the_last_six(spark):
    turns = [("user" if i % 2 == 0 else "assistant", f"turn {i}. more", None) for i in range(14)]
    d = spark.createDataFrame([("u", "s", "", turns), ("v", "s", "", turns[:6])], f"user_id string, space_id string, running_summary string, recent_turns {schemas.TURNS_DDL}")
    got = {r.user_id: r for r in dl.compact(d).collect()}
    assert [t.text for t in got["u"].recent_turns] == [f"turn {i}. more" for i in range(8, 14)] and got["u"].running_summary.split("\n")[0] == "turn 0."
    assert len(got["v"].recent_turns) == 6 and got["v"].running_summary == ""


def test_hashed_vectors_count_words(spark):
    rows = spark.createDataFrame([("1", "Red red, RED blue"), ("2", "blue red red red"), ("3", ""), ("4", None), ("5", "red")], "message_id string, text string")
    got = {r.message_id: list(r.embedding) for r in md.embed_text(rows).collect()}
    assert got["1"] == got["2"] and not any(got["3"]) and not any(got["4"]) and sum(x * x for x in got["1"]) == pytest.approx(1, abs=1e-6)
    assert sorted(x for x in got["1"] if x)[::-1] == pytest.approx([3 / 10**0.5, 1 / 10**0.5], abs=1e-6) and max(got["5"]) == 1.0


def test_inverted_lists_search_bounded_groups_whatever_the_input(spark):
    import random

    random.seed(4)
    v = spark.createDataFrame([(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(300)], "id long, vector array<float>")
    q, c = v.filter("id < 40").withColumnRenamed("id", "query_id"), v.withColumnRenamed("id", "item_id")
    show = lambda f: sorted((r.query_id, r.item_id, r.rank, r.similarity) for r in f.collect())
    whole = show(vc.ann_join(q, c, 3, lists=4, probes=4, others=True))
    found = vc.ann_join(q, c, 3, lists=4, probes=4, others=True, block_rows=20, block_queries=7)
    assert show(found) == whole == show(vc.knn_join(q, c, 3, others=True))
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()  # no row for each pair


def test_copies_of_a_vector_are_searched_once_and_all_answered(spark):
    import random

    random.seed(6)
    kinds = [[random.gauss(0, 1) for _ in range(5)] for _ in range(7)]
    odd = [(900, None), (901, []), (902, [0.0] * 5), (903, [float("nan")] + [1.0] * 4)]
    v = spark.createDataFrame([(i, kinds[i * 5 % 7]) for i in range(700)] + odd, "id long, vector array<double>")
    q, c = v.filter("id % 3 = 0").withColumnRenamed("id", "query_id"), v.withColumnRenamed("id", "item_id")
    cos = [[sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 for b in kinds] for a in kinds]
    for others in (False, True):
        got = {}
        for r in vc.knn_join(q, c, 4, others=others, block_rows=3, block_queries=2).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.item_id
        want = {}
        for i in range(0, 700, 3):
            items = sorted((j for j in range(700) if not others or j != i), key=lambda j: (-round(cos[i * 5 % 7][j * 5 % 7], 12), j))
            want[i] = dict(enumerate(items[:4], 1))
        assert got == want
    dealt = vc.knn_join(q, c, 4, block_queries=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in dealt


def test_a_search_holds_no_matrix_of_a_whole_group(spark):
    import numpy as np
    import pyarrow as pa

    rng, shapes = np.random.default_rng(2), []
    x, y = rng.normal(size=(500, 4)), rng.normal(size=(90, 4))
    table = lambda name, rows: pa.table([pa.array(range(len(rows))), pa.array(list(rows))], names=[name, "vector"])
    whole = vc._nearest(table("item_id", x), table("query_id", y), 3)
    real, np.partition = np.partition, lambda a, *rest, **more: shapes.append(a.size) or real(a, *rest, **more)
    try:
        assert vc._nearest(table("item_id", x), table("query_id", y), 3, cells=2_000).equals(whole)
    finally:
        np.partition = real
    assert max(shapes) <= 2_000


@pytest.mark.parametrize("many", [1, 2, 5, 9, 63, 64, 65, 200, 700])
def test_nearest_rows_are_those_of_sorting_all(many):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(many)
    x, y = rng.integers(-2, 3, size=(many, 3)) + 0.5, rng.integers(-2, 3, size=(30, 3)) + 0.5  # with ties
    bound, least = rng.integers(0, 4, size=many).astype(float), rng.integers(0, 5, size=30).astype(float)
    items = pa.table([pa.array(range(many)), pa.array(list(x)), pa.array(bound)], names=["item_id", "vector", "bound"])
    asked = pa.table([pa.array(range(30)), pa.array(list(y)), pa.array(least)], names=["query_id", "vector", "least"])
    cos = np.round((y / np.linalg.norm(y, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T, 12)
    for k in (1, 3, 8):
        for limits in (True, False):
            got = vc._nearest(items, asked, k) if limits else vc._nearest(items.drop(["bound"]), asked.drop(["least"]), k)
            want = {(i, j) for i in range(30) for j in sorted((j for j in range(many) if not limits or bound[j] >= least[i]), key=lambda j: (-cos[i][j], j))[:k]}
            assert set(zip(got.column("query_id").to_pylist(), got.column("item_id").to_pylist(), strict=True)) == want and got.num_rows == len(want)


def test_links_deal_few_copies_of_rows_and_compare_them_in_pieces(spark):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(8)
    x = rng.normal(size=(5_000, 8))
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "item_id long, vector array<double>")
    left, right = vc._dealt(vc.into_cells(frame, 0.5), vc._LINK_ROWS)
    assert left.count() + right.count() <= 2 * 5_000
    some = x[:60] / np.linalg.norm(x[:60], axis=1, keepdims=True)
    ids = pa.chunked_array([pa.array(range(60))])

    def parts(piece):
        root = list(range(60))
        for table in vc._pieces(some, ids, some, ids, 0.6, piece):
            for a, b in zip(*(table.column(c).to_pylist() for c in ("query_id", "item_id")), strict=True):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
        return root

    assert parts(7) == parts(1_000) and 1 < len(set(parts(7))) < 60


def test_a_search_of_many_blocks_deals_few_rows_at_once(spark, monkeypatch):
    import random

    random.seed(9)
    v = spark.createDataFrame([(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(240)] + [(999, [0.0] * 6)], "id long, vector array<float>")
    q, c = v.filter("id % 6 != 0").withColumnRenamed("id", "query_id"), v.filter("id < 100").withColumnRenamed("id", "item_id")
    show = lambda f: sorted((r.query_id, r["rank"], r.item_id, r.similarity) for r in f.collect())
    dealt, real = [], vc._meeting
    monkeypatch.setattr(vc, "_meeting", lambda *a: dealt.append([x.count() for x in real(*a)]) or real(*a))
    whole = vc.knn_join(q, c, 3, others=True)
    assert len(dealt) == 1
    dealt.clear()
    assert show(vc.knn_join(q, c, 3, others=True, block_rows=50, block_queries=5)) == show(whole)
    assert len(dealt) == 10 and max(a for a, _ in dealt) <= 4 * 100  # 40 blocks of queries, 4 of them at once
    assert sum(b for _, b in dealt) == 2 * 200
