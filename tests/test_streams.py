"""Streams against the batch forms, for several splits into micro-batches."""

import pytest
from pyspark.sql import functions as F

from tallybrook.operators import changes as ch
from tallybrook.operators import models as md
from tallybrook.operators import revisions as rv
from tallybrook.sources import schemas
from tallybrook.sources.buckets import BucketedTable
from tallybrook.streaming import pipeline as st

CHANGES = "message_id string, seq long, change string, text string"


def fed(spark, rows, ddl, where, cuts):
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], ddl).coalesce(1).write.parquet(f"{where}/part{n:03}")
    schema = spark.createDataFrame([], ddl).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(where))


@pytest.mark.parametrize("cuts", [[], [4, 6], [5, 7, 8]])
def test_deletes_retract_entities(spark, tmp_path, cuts):
    rows = [(f"m{i}", i, "created", f"t{i}") for i in range(5)] + [("m0", 5, "deleted", None), ("m1", 6, "deleted", None), ("m9", 7, "deleted", None), ("m2", 8, "updated", "new")]
    revisions = spark.createDataFrame([("e0", "m0"), ("e0", "m1"), ("e1", "m1"), ("e1", "m2"), ("e2", "m9"), ("e3", None), ("e4", "m1")], "entity_id string, source_message_id string")
    entities = BucketedTable(spark, str(tmp_path / "entities"), schemas.ENTITIES_DDL, "entity_id", buckets=4)
    log = BucketedTable(spark, str(tmp_path / "log"), st.LOG_DDL, "message_id", buckets=4)
    start = spark.createDataFrame([(f"e{i}",) for i in range(5)], "entity_id string")
    kinds = [c.split(" ") for c in schemas.ENTITIES_DDL.split(", ")][1:]
    entities.replace(start.select("entity_id", *(F.lit(False if c == "is_deleted" else None).cast(t).alias(c) for c, t in kinds)), 0)
    st.stream_changes(fed(spark, rows, CHANGES, tmp_path / "in", cuts), log, entities, lambda: revisions, str(tmp_path / "check")).awaitTermination()
    final = ch.apply_changes(spark.createDataFrame(rows, CHANGES))
    assert {r.entity_id for r in entities.read().filter("is_deleted").collect()} == {r.entity_id for r in rv.orphan_entities(revisions, final).collect()} == {"e0", "e4"}
    assert sorted(map(tuple, log.read().select("message_id", "text", "is_deleted").collect())) == sorted(map(tuple, final.select("message_id", "text", "is_deleted").collect()))


@pytest.mark.parametrize("cuts", [[], [1, 3]])
def test_extraction_with_dead_letters(spark, tmp_path, cuts):
    ddl = "message_id string, text string"
    rows = [("a", "Looking for surveyor, position, from 90k"), ("b", "Nice weather"), ("c", "About the salary"), ("d", "Position surveyor is filled"), ("e", None)]
    classify = lambda d: md.keyword_scorer(d).withColumn("relevant", F.col("score") >= 0.5).drop("score")
    st.stream_extract(fed(spark, rows, ddl, tmp_path / "in", cuts), classify, md.extract_fields, str(tmp_path / "out"), str(tmp_path / "dead"), str(tmp_path / "check")).awaitTermination()
    read = lambda name: sorted((r.message_id, r.action) for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / name)).collect())
    assert read("out") == [("a", "create"), ("d", "close")] and read("dead") == [("c", "none")]


@pytest.mark.parametrize("cuts", [[], [3, 5]])
def test_lags_of_two_streams_equal_the_batch(spark, tmp_path, cuts):
    at = lambda d, c: d.withColumn(c, F.timestamp_seconds(F.col(c) + 86_400))
    said = [(f"m{i}", i * 600) for i in range(8)]
    made = [("m0", 30), ("m1", 700), ("m2", 1200), ("m3", 3000), ("m5", 3001), ("m6", 3700)]
    late = [("z", 10**6)]  # moves the watermarks past all waiting rows
    m = at(fed(spark, [*said, *late], "message_id string, received_at long", tmp_path / "m", cuts), "received_at")
    v = at(fed(spark, [*made, *late], "message_id string, embedded_at long", tmp_path / "v", cuts), "embedded_at")
    st.stream_lags(m, v).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).filter("message_id != 'z'")
    batch = md.stage_lag(at(spark.createDataFrame(said, "message_id string, received_at long"), "received_at"), at(spark.createDataFrame(made, "message_id string, embedded_at long"), "embedded_at"))
    assert md.lag_summary(got).collect() == batch.collect() and batch.first().waiting == 2
