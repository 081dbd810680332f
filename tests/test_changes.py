import base64
import json
import random

from pyspark.sql import functions as F

from tallybrook.operators import changes as ch
from tallybrook.sources import events as ev
from tallybrook.sources.tables import SnapshotTable
from tallybrook.streaming import pipeline as st


def _event(kind="created", **message):
    base = {"name": "spaces/1/messages/7", "createTime": "2024-05-01T10:00:00Z", "text": "Ищем тимлида", "sender": {"name": "users/5", "displayName": "Ann"}, "thread": {"name": "t1"}, "space": {"name": "s1"}}
    return {"type": f"google.workspace.chat.message.v1.{kind}", "message": {k: v for k, v in (base | message).items() if v is not None}}


def _frame(spark, events):
    rows = [(json.dumps({"message": {"data": base64.b64encode(json.dumps(e).encode()).decode(), "messageId": str(i)}}),) if not isinstance(e, str) else (e,) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, "value string")


def test_parse_created_event(spark):
    good, bad = ev.decode_envelope(_frame(spark, [_event()]))
    row = ev.parse_change_event(good).first()
    assert (row.change, row.message_id, row.space_id, row.thread_id, row.author_id, row.author_name, row.text) == ("created", "spaces/1/messages/7", "s1", "t1", "users/5", "Ann", "Ищем тимлида")
    assert str(row.created_at) == "2024-05-01 10:00:00" and bad.count() == 0


def test_rejects(spark):
    events = [_event("created"), _event("moved"), _event("created", name=None), _event("created", text="  "), _event("deleted", text=None, sender=None, thread=None), _event("updated", text="new")]
    good, bad = ev.reject_events(ev.parse_change_event(ev.decode_envelope(_frame(spark, events))[0]))
    assert sorted(r.change for r in good.collect()) == ["created", "deleted", "updated"]
    assert sorted(r.reason for r in bad.collect()) == ["no id", "no text", "unknown type"]


def test_undecodable_goes_to_quarantine(spark):
    broken = ["no json", json.dumps({"message": {}}), json.dumps({"message": {"data": "%%%"}}), json.dumps({"message": {"data": base64.b64encode(b"[1]").decode()}})]
    good, bad = ev.decode_envelope(_frame(spark, [*broken, _event()]))
    assert good.count() == 1 and bad.count() == 4


def test_missing_time_falls_back(spark):
    good, _ = ev.decode_envelope(_frame(spark, [_event(createTime=None), _event(createTime="soon")]))
    at = F.lit("2024-06-01 00:00:00").cast("timestamp")
    assert {str(r.created_at) for r in ev.parse_change_event(good, received_at=at).collect()} == {"2024-06-01 00:00:00"}


def test_routing(spark):
    rows = ev.reject_events(ev.parse_change_event(ev.decode_envelope(_frame(spark, [_event("created"), _event("updated"), _event("deleted")]))[0]))[0]
    assert {k: v.count() for k, v in ev.route_changes(rows).items()} == {"ingest": 1, "extract": 1, "edit": 1, "delete": 1}


def _changes(spark, rows):
    return spark.createDataFrame(rows, "message_id string, seq long, change string, text string")


def _log(frame):
    return {r.message_id: (r.text, r.is_edited, r.is_deleted) for r in frame.collect()}


def test_fold_rules(spark):
    rows = [
        ("a", 1, "created", "one"), ("a", 2, "created", "again"), ("a", 3, "updated", "two"), ("a", 4, "deleted", ""), ("a", 5, "updated", "three"),
        ("b", 1, "updated", "early"), ("b", 2, "deleted", ""), ("b", 3, "created", "late"), ("c", 1, "deleted", ""), ("d", 1, "created", "x"),
    ]
    assert _log(ch.apply_changes(_changes(spark, rows))) == {"a": ("three", True, True), "b": ("late", False, False), "d": ("x", False, False)}
    assert _log(ch.apply_changes(_changes(spark, rows), hold_early=True))["b"] == ("early", True, True)


def test_redelivery_changes_nothing(spark):
    rows = [("a", 1, "created", "one"), ("a", 2, "updated", "two"), ("b", 3, "created", "x"), ("b", 4, "deleted", "")]
    assert _log(ch.apply_changes(_changes(spark, rows + rows))) == _log(ch.apply_changes(_changes(spark, rows)))


def test_double_ingest_is_one_row(spark):
    log = spark.createDataFrame([("m1",)], "message_id string")
    new = spark.createDataFrame([("m1", 1), ("m2", 2), ("m2", 3)], "message_id string, seq long")
    assert [(r.message_id, r.seq) for r in ch.append_messages(log, new).collect()] == [("m2", 2)]


def test_revision_insert_rules(spark):
    kind = "entity_id string, source_message_id string, action string, seq long, changed_field string, new_value string"
    journal = spark.createDataFrame([("e", "m1", "update", 1, "a", "1")], kind)
    new = spark.createDataFrame([("e", "m1", "update", 2, "a", "2"), ("e", "m1", "close", 3, None, None), ("e", None, "update", 4, None, None), ("e", None, "update", 5, None, None)], kind)
    assert sorted(r.seq for r in ch.append_revisions(journal, new).collect()) == [3, 4, 5]
    assert sorted(r.seq for r in ch.append_revisions(journal, new, strict_journal=True).collect()) == [2, 3, 4, 5]


def test_vectors_only_for_new_and_edited(spark):
    calls = []

    def embed(rows):
        calls.append(rows.count())
        return rows.select("message_id", F.array(F.length("text").cast("float")).alias("embedding"))

    stored = spark.createDataFrame([("m1", [1.0], "x")], "message_id string, embedding array<float>, model string")
    texts = spark.createDataFrame([("m1", "old"), ("m2", "same"), ("m3", "same")], "message_id string, text string")
    assert sorted((r.message_id, r.embedding[0]) for r in ch.write_vectors(stored, texts, embed, "x").collect()) == [("m2", 4.0), ("m3", 4.0)]
    assert calls == [1]
    replaced = ch.replace_vectors(stored, spark.createDataFrame([("m1", "longer")], "message_id string, text string"), embed, "x")
    assert [(r.message_id, r.embedding[0]) for r in replaced.collect()] == [("m1", 6.0)]


def test_batches_equal_one_fold_for_any_split(spark, tmp_path):
    random.seed(5)
    rows = [(f"k{random.randrange(6)}", i, random.choice(["created", "updated", "deleted"]), f"t{i}") for i in range(60)]
    whole = _log(ch.apply_changes(_changes(spark, rows)))
    for n, cuts in enumerate(([0, 13, 40, 60], [0, 30, 31, 60])):
        table = SnapshotTable(spark, str(tmp_path / f"log{n}"), st.LOG_DDL)
        for version, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            st.apply_batch(table, _changes(spark, rows[a:b]), version)
            st.apply_batch(table, _changes(spark, rows[a:b]), version)  # a batch that runs again changes nothing
        assert _log(table.read()) == whole


def test_early_changes_are_held(spark, tmp_path):
    table, early = SnapshotTable(spark, str(tmp_path / "log"), st.LOG_DDL), SnapshotTable(spark, str(tmp_path / "early"), st.HELD_DDL)
    st.apply_batch(table, _changes(spark, [("a", 1, "updated", "new")]), 0, early=early)
    st.apply_batch(table, _changes(spark, [("a", 2, "created", "old")]), 1, early=early)
    assert _log(table.read()) == {"a": ("new", True, False)} and early.read().count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, "created", "one"), ("a", 2, "updated", "two"), ("b", 3, "created", "x"), ("c", 4, "updated", "lost")]
    _changes(spark, rows).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("message_id string, seq long, change string, text string").parquet(str(tmp_path / "in"))
    table = SnapshotTable(spark, str(tmp_path / "log"), st.LOG_DDL)
    st.stream_apply_changes(stream, table, str(tmp_path / "check")).awaitTermination()
    assert _log(table.read()) == _log(ch.apply_changes(_changes(spark, rows)))


def test_stream_dedup_by_delivery(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "2024-01-01 00:00:00"), ("d1", "2024-01-01 01:00:00"), ("d2", "2024-01-01 02:00:00")], "delivery_id string, at string").select("delivery_id", F.col("at").cast("timestamp").alias("arrived_at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = st.stream_dedup(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.delivery_id for r in spark.table("dedup").collect()) == ["d1", "d2"]


def test_messages_are_embedded_by_the_default_embedder_and_null_texts_too(spark, tmp_path):
    from tallybrook.plans import queries as plans

    rows = [(1, 0, "user", "Looking for a welder, a good one"), (1, 1, "user", "Ищем тимлида"), (2, 0, "user", None), (2, 1, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.message_id: r for r in plans.queries()["embed_messages"](spark, str(tmp_path)).collect()}
    assert set(got) == {"1/0", "1/1", "2/0", "2/1"} and {r.size for r in got.values()} == {64}
    assert got["2/0"].vector == got["2/1"].vector == "" and len(got["1/1"].vector.split()) == 2
    bins = [int(p.split(":")[1]) for p in got["1/0"].vector.split()]
    assert 3 <= len(bins) <= 6 and abs(sum(x * x for x in bins) - 1e8) < 1e5
