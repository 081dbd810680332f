"""The strict stream against a fold of one message after the other, written from the rules and without state stores."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tallybrook.operators import models as md
from tallybrook.streaming import strict as sr

COLUMNS = {"title": "title", "salary_min": "range_min", "salary_max": "range_max", "currency": "currency", "owner": "owner_name", "team": "team", "description": "description"}


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return round(sum(x / na * (y / nb) for x, y in zip(a, b, strict=True)), 12) if na and nb else None


def fold(records):
    """(entities by id, revisions) after all records in order; spaces apart."""
    entities, revisions, seen, unmatched = {}, [], set(), []

    def journal(entity, action, changed, old, new, source, confidence):
        if (source, action) not in seen:
            seen.add((source, action))
            revisions.append((entity, action, changed, json.loads(old) if old else None, json.loads(new) if new else None, source, confidence))

    for space, seq, mid, _, author_id, author, action, ref, fields, confidence, vector in sorted(records, key=lambda r: (r[0], r[1])):
        if action == "retract":
            if ref in entities and entities[ref]["space"] == space and entities[ref]["status"] != "closed":
                entities[ref]["is_deleted"] = True
            continue
        fields = json.loads(fields)
        ref = ref or fields.get("title")
        if action == "none" or not ref:
            continue
        usable = [(cosine(vector, e["embedding"]), i) for i, e in entities.items() if e["space"] == space and e["status"] != "closed" and not e["is_deleted"]]
        usable = sorted(((s, i) for s, i in usable if s is not None), key=lambda x: (-x[0], x[1]))
        near = [x for x in usable if x[0] > 0.75][:5]
        if not near and action in ("update", "close"):
            near = usable[:5]
        typed = {COLUMNS[k]: (int(v) if v is not None and k.startswith("salary") else v) for k, v in fields.items() if k in COLUMNS}
        if not near:
            if action == "create":
                new = dict.fromkeys(COLUMNS.values()) | typed
                new |= {"space": space, "title": fields.get("title") or ref, "status": fields.get("status") or "open", "currency": fields.get("currency") or "RUB", "owner_id": author_id, "owner_name": fields.get("owner") or author, "last_message_id": mid, "confidence": confidence, "embedding": vector, "is_deleted": False}
                entities[sr.entity_name(mid)] = new
                journal(sr.entity_name(mid), "create", None, None, json.dumps(fields), mid, confidence)
            else:
                unmatched.append(mid)
            continue
        sure, target = near[0]
        if sure < 0.6:
            journal(target, "pending", None, None, json.dumps(fields), mid, sure)
            continue
        e = entities[target]
        what = "close" if action == "close" else "update"
        changed = {c: v for c, v in typed.items() if e[c] != v}
        changed = {c: changed[c] for c in COLUMNS.values() if c in changed} | ({"status": "closed"} if what == "close" else {})
        old = {c: e[c] for c in changed}
        e |= changed | {"last_message_id": mid, "confidence": confidence}
        if what != "close":
            e["embedding"] = vector
        journal(target, what, ", ".join(changed) or None, json.dumps(old) if old else None, json.dumps(changed) if changed else None, mid, sure)
    return entities, revisions, unmatched


def made(seed, n=160):
    r = random.Random(seed)
    out, last = [], {}
    for seq in range(n):
        space = r.choice(["s1", "s1", "s2", "s3"])
        fields = {}
        for k, values in (("title", ["a", "b", None]), ("salary_min", ["1", "2", None]), ("salary_max", ["7", "8"]), ("team", ["x", "y", None]), ("owner", ["o", None]), ("currency", ["USD", "RUB"]), ("status", ["on_hold", "open"]), ("colour", ["red"])):
            if r.random() < 0.3:
                fields[k] = r.choice(values)
        angle = r.choice([0.0, 0.1, 0.9, 1.0, 1.6, 2.0, 2.4, 3.1, 4.0])
        vector = [round(math.cos(angle), 3), round(math.sin(angle), 3)] if r.random() < 0.95 else [0.0, 0.0]
        action = r.choice(["create", "update", "update", "close", "none"])
        mid = f"{space}m{seq}" if r.random() < 0.9 else last.get(space, "m")  # a message that is processed again
        last[space] = mid
        out.append((space, seq, mid, "text", f"u{seq % 3}", r.choice(["Ann", "Bo"]), action, r.choice(["thing", "thing", "", None]), json.dumps(fields), 0.5 + seq % 4 / 10, vector))
    return out


def state_of(frame):
    return {r.entity_id: {**{c: r[c] for c in (*COLUMNS.values(), "status", "owner_id", "last_message_id", "confidence", "is_deleted")}, "space": r.space_id, "embedding": list(r.embedding)} for r in frame.collect()}


def log_of(frame):
    return sorted(((r.entity_id, r.action, r.changed_field, json.loads(r.old_value) if r.old_value else None, json.loads(r.new_value) if r.new_value else None, r.source_message_id, r.confidence) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def run(spark, records, tmp_path, cuts, **options):
    """Effects of the records as a stream cut into micro-batches at the positions."""
    where = tmp_path / "in"
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(records)], strict=True)):
        spark.createDataFrame(records[a:b], sr.RECORDS_DDL).coalesce(1).write.parquet(f"{where}/part{n:03}")
    stream = spark.readStream.schema(sr.RECORDS_DDL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(where))
    sr.stream_resolve(stream, str(tmp_path / "out"), str(tmp_path / "check"), **options).awaitTermination()
    return spark.read.schema(sr.EFFECTS_DDL).option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))


@pytest.mark.parametrize(("seed", "cuts"), [(1, []), (1, [1, 2, 50]), (3, [80, 159])])
def test_stream_equals_one_by_one(store, tmp_path, seed, cuts):
    records = made(seed)
    effects = run(store, records, tmp_path, cuts)
    entities, revisions, unmatched = fold(records)
    assert state_of(sr.entities_of(effects)) == entities and len(entities) > 8
    assert log_of(sr.revisions_of(effects)) == sorted(revisions, key=str)
    assert sorted(r.message_id for r in effects.filter("effective = 'unmatched'").collect()) == sorted(unmatched)
    assert {"create", "update", "close", "pending"} <= {r[1] for r in revisions}


@pytest.mark.parametrize("cuts", [[], [1], [2], [1, 2]])
def test_create_raise_close_is_one_entity(store, tmp_path, cuts):
    records = [("s", i, f"m{i}", "t", "u", "Ann", a, "surveyor", f, 0.7, [1.0, 0.1 * i]) for i, (a, f) in enumerate([("create", '{"salary_max":"90000"}'), ("update", '{"salary_max":"95000"}'), ("close", "{}")])]
    effects = run(store, records, tmp_path, cuts)
    got = sr.entities_of(effects).collect()
    assert [(r.status, r.range_max, r.title, r.owner_name) for r in got] == [("closed", 95000, "surveyor", "Ann")]
    log = sr.revisions_of(effects).orderBy("seq").collect()
    assert [(r.action, r.changed_field, r.old_value, r.new_value) for r in log] == [("create", None, None, '{"salary_max":"90000"}'), ("update", "range_max", '{"range_max":90000}', '{"range_max":95000}'), ("close", "status", '{"status":"open"}', '{"status":"closed"}')]


def test_after_a_close_a_new_entity_begins(store, tmp_path):
    step = lambda i, a: ("s", i, f"m{i}", "t", "u", "Ann", a, "x", "{}", 0.7, [1.0, 0.0])
    effects = run(store, [step(0, "create"), step(1, "close"), step(2, "update"), step(3, "create"), step(4, "create")], tmp_path, [3])
    assert [(r.seq, r.effective) for r in effects.orderBy("seq").collect()] == [(0, "create"), (1, "close"), (2, "unmatched"), (3, "create"), (4, "update")]
    assert sorted((r.entity_id == sr.entity_name("m0"), r.status) for r in sr.entities_of(effects).collect()) == [(False, "open"), (True, "closed")]


def test_retracted_entities_take_nothing_more(store, tmp_path):
    gone = sr.entity_name("m0")
    rows = [("s", 0, "m0", "t", "u", "Ann", "create", "x", "{}", 0.7, [1.0, 0.0]), ("s", 1, None, None, None, None, "retract", gone, None, None, None), ("s", 2, "m2", "t", "u", "Ann", "create", "x", "{}", 0.7, [1.0, 0.0])]
    effects = run(store, rows, tmp_path, [1])
    assert {r.entity_id: r.is_deleted for r in sr.entities_of(effects).collect()} == {gone: True, sr.entity_name("m2"): False}


def test_starts_from_stored_entities(store, tmp_path):
    records = made(5, 90)
    whole = run(store, records, tmp_path / "a", [])
    first = run(store, records[:45], tmp_path / "b", [])
    held = sr.entities_of(first).filter("status != 'closed' and not is_deleted").select("space_id", "entity_id", *sr._ENTITY, "confidence", "embedding")
    second = run(store, records[45:], tmp_path / "c", [20], entities=held)
    both = first.union(second)
    assert state_of(sr.entities_of(both)) == state_of(sr.entities_of(whole))


def test_a_model_that_names_an_unknown_entity(store, tmp_path):
    rows = [("s", i, f"m{i}", "t", "u", "Ann", "create", "x", "{}", 0.7, [1.0, 0.0]) for i in range(2)]
    effects = run(store, rows, tmp_path, [], choose=lambda ref, candidates, text: ("no such id", 0.9))
    assert [r.effective for r in effects.orderBy("seq").collect()] == ["create", "unmatched"]


def test_messages_to_records_on_a_stream(store, tmp_path):
    texts = ["Nice weather today", "Looking for surveyor, vacancy, from 90k, for team Quarry", "Changed position surveyor to from 95", "Position surveyor is filled"]
    rows = store.createDataFrame([("s", i, f"m{i}", t, "u", "Ann") for i, t in enumerate(texts)], "space_id string, seq long, message_id string, text string, author_id string, author_name string")
    rows.coalesce(1).write.parquet(str(tmp_path / "messages"))
    classify = lambda d: md.keyword_scorer(d).withColumn("relevant", F.col("score") >= 0.5).drop("score")
    embed = lambda d: d.withColumn("vector", F.when(F.col("ref").contains("survey"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    records = sr.records_of(store.readStream.schema(rows.schema).parquet(str(tmp_path / "messages")), classify, md.extract_fields, embed)
    sr.stream_resolve(records, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    effects = store.read.schema(sr.EFFECTS_DDL).option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert [(r.status, r.range_min, r.team) for r in sr.entities_of(effects).collect()] == [("closed", 95000, "Quarry")]
    assert sr.revisions_of(effects).count() == 3
