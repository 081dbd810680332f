"""Dialogs by batches, by streams and by a plain loop: one rule."""

import re

import pytest
from pyspark.sql import functions as F

from tallybrook.functions import values as fv
from tallybrook.operators import dialogs as dl
from tallybrook.operators import retrieve as rt
from tallybrook.sources import schemas
from tallybrook.sources.buckets import BucketedTable
from tallybrook.streaming import pipeline as st

EXCHANGES = "user_id string, space_id string, seq long, question string, answer string, at timestamp"


@pytest.fixture(scope="module")
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def told(spark, n=15):
    rows = [("u", s, i, f"Is it 1.{i}? Yes", None if i % 6 == 5 else f"It rose! By {i % 4}.5 now\nmore", i * 3600) for i in range(n) for s in (("s", "t") if i % 2 else ("s",))]
    return spark.createDataFrame(rows, EXCHANGES.replace("at timestamp", "at long")).withColumn("at", F.timestamp_seconds("at")).select(*[c.split()[0] for c in EXCHANGES.split(", ")])


def looped(rows, max_turns=12, keep=6, lines=40):
    held = {}
    for r in sorted(rows, key=lambda r: r.seq):
        d = held.setdefault((r.user_id, r.space_id), {"turns": [], "summary": [], "n": 0})
        d["turns"] += [("user", r.question), ("assistant", r.answer)]
        d["n"], d["at"] = d["n"] + 1, r.at
        if len(d["turns"]) >= max_turns:
            for _, text in d["turns"][:-keep]:
                first = re.split(r"(?<=[.!?])|\n", text or "", maxsplit=1)[0].strip(" ")
                if first and first not in d["summary"]:
                    d["summary"].append(first)
            d["summary"], d["turns"] = d["summary"][-lines:], d["turns"][-keep:]
    return {k: ("\n".join(d["summary"]), d["turns"], d["n"], d["at"]) for k, d in held.items()}


def shown(frame):
    return {(r.user_id, r.space_id): (r.running_summary, [(t.role, t.text) for t in r.recent_turns], r.turns_count, r.updated_at) for r in frame.collect()}


def empty(spark):
    return spark.createDataFrame([], st.DIALOG_DDL)


@pytest.mark.parametrize("cuts", [[15], [1, 15], [5, 6, 14, 15]])
def test_batches_equal_the_loop(spark, cuts):
    rows = told(spark)
    held = empty(spark)
    for a, b in zip([0, *cuts], cuts, strict=False):
        held = dl.write_dialogs(held, rows.filter(f"seq >= {a} and seq < {b}")).cache()
    assert shown(held) == looped(rows.collect()) and all(len(v[1]) < 12 for v in shown(held).values())
    assert shown(held)["u", "s"][0].split("\n")[:2] == ["Is it 1.", "It rose!"]


def test_stream_equals_the_loop_and_goes_on_from_stored_dialogs(store, tmp_path):
    rows = told(store)
    table = BucketedTable(store, str(tmp_path / "dialogs"), f"dialog_id string, {st.DIALOG_DDL}", "dialog_id", buckets=4)
    for n, part in enumerate(("seq < 4", "seq >= 4 and seq < 9", "seq >= 9")):
        rows.filter(part).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        stream = store.readStream.schema(rows.schema).parquet(str(tmp_path / f"in{n}"))
        st.stream_dialogs(stream, table, str(tmp_path / f"check{n}")).awaitTermination()  # each time a new stream, with no state but the table
    assert shown(table.read()) == looped(rows.collect())


def test_summaries_are_bounded(spark):
    rows = spark.createDataFrame([("u", "s", i, f"Question {i}. " + "x" * 500, "y" * 500) for i in range(90)], "user_id string, space_id string, seq long, question string, answer string").withColumn("at", F.timestamp_seconds("seq"))
    made = dl.write_dialogs(empty(spark), rows).first()
    lines = made.running_summary.split("\n")
    assert len(lines) == dl.SUMMARY_LINES and max(map(len, lines)) <= dl.LINE_CHARS and lines[-1] == f"Question {89 - 3}." and made.turns_count == 90
    assert made.running_summary == looped(rows.withColumn("answer", F.substring("answer", 1, 300)).collect())["u", "s"][0]


def test_context_has_memory_turns_and_placeholders(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    d = spark.createDataFrame([(1, "sum", [("user", "hi", None), ("model", None, None)]), (2, "", [])], f"query_id int, running_summary string, recent_turns {schemas.TURNS_DDL}")
    lines = spark.createDataFrame([(1, "- a [open]")], "query_id int, text string")
    got = {r.query_id: r.context for r in rt.build_context(q, d, lines, lines.limit(0)).collect()}
    assert got[1] == f"{rt.MEMORY}\nsum\n\n{rt.TURNS}\n{fv.USER_LABEL}: hi\n{fv.OTHER_LABEL}: \n\n{rt.ENTITIES}\n- a [open]\n\n{rt.MESSAGES}\n{rt.NO_DATA}"
    assert got[2] == got[3] == f"{rt.MEMORY}\n{rt.FIRST_DIALOG}\n\n{rt.TURNS}\n{rt.NO_TURNS}\n\n{rt.ENTITIES}\n{rt.NO_DATA}\n\n{rt.MESSAGES}\n{rt.NO_DATA}"


def test_lines_of_entities_and_messages(spark):
    rows = spark.createDataFrame([(1, "t", "open", 0.0, 7.0, "", "x", "Ann"), (2, "t", None, None, None, "USD", "", ""), (3, "t", "closed", 5.0, None, "USD", None, None)], "i int, title string, status string, low double, high double, cur string, team string, owner string")
    c = [F.col(x) for x in ("title", "status", "low", "high", "cur", "team")]
    day = F.lit("2024-05-06 10:00:00").cast("timestamp")
    got = {r.i: (r.p, r.c) for r in rows.select("i", fv.format_entity_line(*c, variant="prompt").alias("p"), fv.format_entity_line(*c, owner=F.col("owner"), updated_at=F.when(F.col("i") == 1, day), variant="context").alias("c")).collect()}
    assert got[1] == ("- t [open], ?–7 RUB, команда: x", "- t [open], зарплата ?–7 RUB, овнер: Ann, команда: x, обновлено: 2024-05-06")
    assert got[2][0] == "- t [open]" and got[3] == ("- t [closed], 5–? USD", "- t [closed], зарплата 5–? USD")
    said = spark.range(1).select(fv.format_message_line(F.lit(None).cast("string"), day, F.lit("x")).alias("a"), fv.format_message_line(F.lit(""), None, F.lit("x")).alias("b"), fv.format_message_line(F.lit(""), None, F.lit("x"), variant="prompt").alias("c")).first()
    assert tuple(said) == (f"[{fv.NAMELESS_AUTHOR} (2024-05-06 10:00)]: x", f"[{fv.NAMELESS_AUTHOR}]: x", "- unknown: x")


def test_a_summary_made_once_has_whole_lines(spark):
    texts = [f"{i} " + "word " * 80 + "end. More." for i in range(50)]
    turns = [("user", t, None) for t in texts]
    frame = spark.createDataFrame([("", turns)], "running_summary string, recent_turns array<struct<role:string,text:string,ts:string>>")
    got = dl.compact(frame, max_turns=4, keep=2, summarise=dl.whole_turns).first()
    assert got.running_summary.split("\n") == [t.removesuffix(" More.") for t in texts[:48]] and len(got.recent_turns) == 2
