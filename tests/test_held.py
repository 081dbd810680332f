import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallybrook.operators import changes as ch
from tallybrook.operators import revisions as rv
from tallybrook.sources import schemas
from tallybrook.sources.buckets import BucketedTable
from tallybrook.streaming import held as hd
from tallybrook.streaming import pipeline as st

CHANGES = "message_id string, seq long, change string, text string, arrived_at timestamp"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def run(spark, rows, tmp_path, cuts, **options):
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame([(k, i, c, t, START + datetime.timedelta(hours=h)) for k, i, c, t, h in rows[a:b]], CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in/part{n:03}")
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    hd.stream_apply_in_state(stream, f"{tmp_path}/out", f"{tmp_path}/dead", f"{tmp_path}/check", **options).awaitTermination()
    read = lambda name, ddl: spark.read.schema(ddl).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")
    rows = read("out", hd.IMAGES_DDL.replace(", expired long", ", batch_id int")).orderBy("batch_id").collect()
    return {r.message_id: (r.first_seq, r.last_seq, r.text, r.is_edited, r.is_deleted) for r in rows}, {r.message_id: r.expired for r in read("dead", "message_id string, expired long").collect()}


@pytest.mark.parametrize("cuts", [[], [1, 20, 21, 60], [40]])
def test_state_equals_the_fold(store, tmp_path, cuts):
    r = random.Random(3)
    rows = [(f"k{r.randrange(9)}" if i % 17 else None, i, r.choice(["created", "updated", "updated", "deleted"]), f"t{i}" if i % 11 else None, i / 10) for i in range(80)]
    got, dead = run(store, rows, tmp_path, cuts)
    want = ch.apply_changes(store.createDataFrame([x[:4] for x in rows if x[0]], "message_id string, seq long, change string, text string"), hold_early=True)
    assert got == {x.message_id: (x.first_seq, x.last_seq, x.text, x.is_edited, x.is_deleted) for x in want.collect()} and not dead


def test_early_changes_run_out(store, tmp_path):
    rows = [("a", 1, "updated", "old", 0), ("b", 2, "deleted", None, 0), ("b", 3, "updated", "kept", 6), ("c", 4, "created", "c", 7), ("c", 5, "created", "c", 20), ("d", 6, "created", "d", 21), ("a", 7, "created", "new", 22), ("b", 8, "created", "b", 22)]
    got, dead = run(store, rows, tmp_path, [2, 3, 4, 5, 6], hold_hours=18)
    assert got["a"] == (7, 7, "new", False, False) and got["b"] == (8, 8, "kept", True, False) and got["c"][0] == 4
    assert dead == {"a": 1, "b": 1}


def _log(frame):
    return {r.message_id: (r.text, r.is_edited, r.is_deleted) for r in frame.collect()}


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "log"), st.LOG_DDL, "message_id", buckets=8)
    frame = lambda rows: spark.createDataFrame(rows, "message_id string, seq long, change string, text string")
    rows = [(f"m{i}", i, "created", f"t{i}") for i in range(60)]
    assert len(st.upsert_batch(table, frame(rows), 0)) == 8
    first, _ = table.manifest()
    one = [("m7", 100, "updated", "new")]
    touched = st.upsert_batch(table, frame(one), 1)
    second, _ = table.manifest()
    assert len(touched) == 1 and {b for b in second if second[b] != first[b]} == touched
    assert st.upsert_batch(table, frame([("m7", 101, "updated", "other")]), 1) == set()  # a batch that runs again changes nothing
    assert _log(table.read()) == _log(ch.apply_changes(frame(rows + one)))
    assert _log(table.read(0))["m7"][0] == "t7"
    for v in (2, 3):
        st.upsert_batch(table, frame([("m7", 100 + v, "updated", f"new{v}")]), v)
    assert table.versions() == [2, 3] and _log(table.read())["m7"][0] == "new3" and len(table.read().collect()) == 60
    held = table._names(f"{table.path}/data/v=0", "bucket=")
    assert sorted(held) == sorted(b for b in first if b not in touched)  # still referred to
    table.resize(3, 4)
    assert table.manifest()[1] == 3 and len(table.read().collect()) == 60
    st.upsert_batch(table, frame([("m1", 200, "deleted", None)]), 5)
    assert _log(table.read())["m1"][2] and len(table.read().collect()) == 60 and table.versions() == [4, 5]


def test_any_split_gives_the_same_log(spark, tmp_path):
    r = random.Random(8)
    rows = [(f"k{r.randrange(12)}", i, r.choice(["created", "updated", "deleted"]), f"t{i}") for i in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "message_id string, seq long, change string, text string")
    table = BucketedTable(spark, str(tmp_path / "log"), st.LOG_DDL, "message_id", buckets=4)
    for version, (a, b) in enumerate([(0, 13), (13, 40), (40, 60)]):
        st.upsert_batch(table, frame(rows[a:b]), version)
    assert _log(table.read()) == _log(ch.apply_changes(frame(rows)))


def test_half_a_version_is_not_read(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "k long, x long", "k", buckets=4)
    assert table.read().count() == 0
    table.replace(spark.createDataFrame([(i, i) for i in range(20)], "k long, x long"), 0)
    spark.createDataFrame([(1, 99)], "k long, x long").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{table.path}/data/v=1")  # its manifest is missing
    assert table.versions() == [0] and table.read().agg(F.sum("x")).first()[0] == 190
    table.update(spark.createDataFrame([(1, 5), (None, 7)], "k long, x long"), 1, lambda held, new: held.join(new.filter("k is not null").select("k"), "k", "left_anti").unionByName(new))
    assert table.read().agg(F.sum("x")).first()[0] == 190 - 1 + 12
    table.update(spark.createDataFrame([(i, None) for i in range(20)] + [(None, None)], "k long, x long"), 2, lambda held, new: held.limit(0))
    assert table.read().count() == 0 and table.versions() == [1, 2]


def test_entities_and_messages_by_buckets(spark, tmp_path):
    ddl = "entity_id string, seq long, action string, fields map<string,string>, embedding array<float>, last_message_id string, confidence double, at timestamp, entity_ref string, author_id string, author_name string"
    step = lambda e, i, a, f: (e, i, a, f, [float(i)], f"m{i}", 0.5, START, "ref", "u", "Ann")
    rows = [step(f"e{i % 7}", i, "create" if i < 7 else "close" if i % 9 == 0 else "update", {"salary_max": str(i)}) for i in range(40)]
    table = BucketedTable(spark, str(tmp_path / "e"), schemas.ENTITIES_DDL, "entity_id", buckets=4)
    for version, (a, b) in enumerate([(0, 7), (7, 8), (8, 40)]):
        touched = st.upsert_entities(table, spark.createDataFrame(rows[a:b], ddl), version)
        assert version != 1 or len(touched) == 1
    whole = rv.write_entities(spark.createDataFrame([], schemas.ENTITIES_DDL), spark.createDataFrame(rows, ddl))
    show = lambda d: sorted((r.entity_id, r.status, r.range_max, r.last_message_id, r.title) for r in d.collect())
    assert show(table.read()) == show(whole)
    m = BucketedTable(spark, str(tmp_path / "m"), "message_id string, seq long, text string", "message_id", buckets=4)
    st.insert_messages(m, spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "message_id string, seq long, text string"), 0)
    st.insert_messages(m, spark.createDataFrame([("a", 4, "w"), ("c", 5, "v")], "message_id string, seq long, text string"), 1)
    assert sorted((r.message_id, r.text) for r in m.read().collect()) == [("a", "x"), ("b", "z"), ("c", "v")]
