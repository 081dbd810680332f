"""Structured Streaming forms: deduplication by arrival, changes applied by micro-batch, stateful dialogs.

Watermarks are on arrival time, never on a message's own time: an edit of an old message carries that time and would
be dropped as late.  Micro-batch sinks write snapshot versions named by batch id, so a batch that is run again
writes the same version again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallybrook.operators import changes as ch
from tallybrook.operators import revisions as rv
from tallybrook.operators.dialogs import KEEP_TURNS, MAX_TURNS, summarise_lines
from tallybrook.sources.buckets import BucketedTable
from tallybrook.sources.events import decode_envelope, parse_change_event, reject_events
from tallybrook.sources.tables import SnapshotTable

LOG_DDL = "message_id string, first_seq long, last_seq long, text string, is_edited boolean, is_deleted boolean"
HELD_DDL = "message_id string, seq long, change string, text string"


def stream_dedup(events: DataFrame, *, key: str = "delivery_id", arrived: str = "arrived_at", bound: str = "24 hours") -> DataFrame:
    """Redeliveries of a delivery id within the bound are dropped; ``anti_insert`` catches those beyond it."""
    return events.withWatermark(arrived, bound).dropDuplicatesWithinWatermark([key])


def read_changes(raw: DataFrame, column: str = "value", received_at=None) -> DataFrame:
    """Envelopes to accepted flat changes, for a batch or a stream."""
    rows, _ = decode_envelope(raw, column)
    return reject_events(parse_change_event(rows, received_at=received_at))[0]


def merge_log(log: DataFrame, changes: DataFrame, *, hold_early: bool = False) -> DataFrame:
    """The log after a micro-batch: each known row stands for its create and, if edited or deleted, for those too."""
    seed = log.select("message_id", F.col("first_seq").alias("seq"), F.lit("created").alias("change"), "text")
    edits = log.filter("is_edited").select("message_id", F.col("last_seq").alias("seq"), F.lit("updated").alias("change"), "text")
    gone = log.filter("is_deleted").select("message_id", F.col("last_seq").alias("seq"), F.lit("deleted").alias("change"), "text")
    touched = changes.select("message_id").distinct()
    known = seed.union(edits).union(gone).join(touched, "message_id", "left_semi")
    new = ch.apply_changes(known.union(changes.select("message_id", "seq", "change", "text")), hold_early=hold_early)
    return log.join(touched, "message_id", "left_anti").select(*new.columns).union(new)


def apply_batch(table: SnapshotTable, batch: DataFrame, version: int, *, early: SnapshotTable | None = None) -> None:
    """``foreachBatch`` body: fold a micro-batch (message_id, seq, change, text) into the log's next version.

    With ``early``, edits and deletes that came before their create are kept there and tried again with each batch.
    """
    log = table.read(below=version)
    rows = batch.select("message_id", "seq", "change", "text")
    if early is not None:
        rows = rows.unionByName(early.read(below=version))
    new = merge_log(log, rows, hold_early=early is not None)
    table.write(new, version)
    if early is not None:
        early.write(rows.filter("change != 'created'").join(table.read().select("message_id"), "message_id", "left_anti"), version)


def upsert_batch(table: BucketedTable, batch: DataFrame, version: int) -> set[int]:
    """``foreachBatch`` body over a bucketed log: only buckets that the batch's messages fall into are read and written."""
    rows = batch.select("message_id", "seq", "change", "text").filter(F.col("message_id").isNotNull())
    return table.update(rows, version, merge_log)


def upsert_entities(table: BucketedTable, updates: DataFrame, version: int) -> set[int]:
    """Updates of a micro-batch folded onto the entities of their buckets (see ``write_entities``)."""
    return table.update(updates, version, rv.write_entities)


def insert_messages(table: BucketedTable, messages: DataFrame, version: int, order: str = "seq") -> set[int]:
    """Messages of a micro-batch that the table doesn't hold yet, by their buckets (see ``append_messages``)."""
    return table.update(messages, version, lambda held, new: held.unionByName(ch.append_messages(held, new, order).select(*held.columns)))


def stream_apply_changes(changes: DataFrame, table: SnapshotTable, checkpoint: str, *, early: SnapshotTable | None = None):
    """Start the stream that keeps the message log; batch ids number its versions."""
    return changes.writeStream.foreachBatch(lambda batch, number: apply_batch(table, batch, number, early=early)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retract_batch(entities: SnapshotTable, revisions: DataFrame, log: DataFrame, deleted: DataFrame, version: int) -> None:
    """Deletes of a micro-batch (message_id): entities that have lost their last live source are flagged."""
    current = entities.read(below=version)
    entities.write(rv.retract(current, rv.orphan_entities(revisions, log, deleted)), version)


def stream_retract(deleted: DataFrame, entities: SnapshotTable, revisions, log, checkpoint: str):
    """Start the retraction stream; ``revisions`` and ``log`` are functions that read the current tables."""
    return deleted.writeStream.foreachBatch(lambda batch, number: retract_batch(entities, revisions(), log(), batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_batch(log: BucketedTable, entities: BucketedTable, revisions: DataFrame, batch: DataFrame, version: int) -> None:
    """Changes of a micro-batch applied to the log, then the entities flagged that its deletes have cost their last live
    source. Only revisions of the entities that these deletes touch are read further."""
    upsert_batch(log, batch, version)
    gone = batch.filter("change = 'deleted'").select("message_id").distinct()
    gone = log.read().filter("is_deleted").join(gone, "message_id", "left_semi").select("message_id")
    theirs = revisions.join(rv.touched_entities(revisions, gone), "entity_id", "left_semi")
    entities.update(rv.orphan_entities(theirs, log.read(), gone).select("entity_id"), version, rv.retract)


def stream_changes(changes: DataFrame, log: BucketedTable, entities: BucketedTable, revisions, checkpoint: str):
    """Start the stream that keeps the log and retracts entities; ``revisions`` is a function that reads the current log of
    revisions. Both tables are versioned by batch id, so a batch that runs again changes nothing."""
    first = max([*log.versions(), *entities.versions()], default=-1) + 1
    body = lambda batch, number: change_batch(log, entities, revisions(), batch, first + number)
    return changes.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_lags(messages: DataFrame, vectors: DataFrame, *, wait: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(message_id, lag) of two streams: messages (message_id, received_at) meet their vectors (message_id, embedded_at) within
    ``wait``; a message that gets none is emitted with a null once the watermarks have passed its time. State holds what is
    younger than that, on both sides. ``models.lag_summary`` sums the rows up."""
    m = messages.select("message_id", "received_at").withWatermark("received_at", lateness).alias("m")
    v = vectors.select("message_id", "embedded_at").withWatermark("embedded_at", lateness).alias("v")
    near = F.expr(f"m.message_id = v.message_id AND v.embedded_at >= m.received_at AND v.embedded_at <= m.received_at + INTERVAL {wait}")
    return m.join(v, near, "leftOuter").select(F.col("m.message_id").alias("message_id"), (F.unix_timestamp("v.embedded_at") - F.unix_timestamp("m.received_at")).alias("lag"))


def extract_batch(batch: DataFrame, classify, extract) -> tuple[DataFrame, DataFrame]:
    """(records, dead letters) of a micro-batch of messages: classified, then only the relevant extracted; a record
    without an action is a dead letter with its reason."""
    records = extract(classify(batch).filter("relevant"))
    useful = F.coalesce(F.col("action") != "none", F.lit(False))
    return records.filter(useful), records.filter(~useful).withColumn("reason", F.lit("no action"))


def stream_extract(messages: DataFrame, classify, extract, out: str, dead: str, checkpoint: str):
    """Start the extraction stream; both outputs are written under their batch id."""

    def body(batch: DataFrame, number: int) -> None:
        good, bad = extract_batch(batch, classify, extract)
        good.write.mode("overwrite").parquet(f"{out}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return messages.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


DIALOG_DDL = "user_id string, space_id string, running_summary string, recent_turns array<struct<role:string,text:string,ts:string>>, turns_count int, updated_at timestamp"


class DialogProcessor(StatefulProcessor):
    """Keyed state of one dialog: its last turns, its summary, how many exchanges it had and when the last one was."""

    def __init__(self, max_turns: int = MAX_TURNS, keep: int = KEEP_TURNS):
        self.max_turns, self.keep = max_turns, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "role string, text string, ts string")
        self.memory = handle.getValueState("memory", "summary string, turns_count int")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for r in initialState.to_dict("records"):
            self.turns.put([tuple(t[c] for c in ("role", "text", "ts")) for t in r["recent_turns"]])
            self.memory.update((r["running_summary"] or "", int(r["turns_count"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        turns = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        summary, count = self.memory.get() if self.memory.exists() else ("", 0)
        lines = summary.split("\n") if summary else []
        batch = pd.concat(list(rows)).sort_values("seq")
        for question, answer, ts in zip(batch["question"], batch["answer"], batch["ts"], strict=True):
            turns += [("user", question, ts), ("assistant", answer, ts)]
            count += 1
            if len(turns) >= self.max_turns and len(turns) > self.keep:
                lines = summarise_lines(lines, [t[1] for t in turns[: -self.keep]])
                turns = turns[-self.keep :]
        self.turns.put(turns)
        self.memory.update(("\n".join(lines), count))
        shown = [[{"role": r, "text": t, "ts": s} for r, t, s in turns]]
        yield pd.DataFrame({"user_id": [key[0]], "space_id": [key[1]], "running_summary": ["\n".join(lines)], "recent_turns": shown, "turns_count": [count], "updated_at": [batch["at"].iloc[-1]]})

    def close(self) -> None:
        pass


def compact_dialogs(exchanges: DataFrame, *, max_turns: int = MAX_TURNS, keep: int = KEEP_TURNS, dialogs: DataFrame | None = None) -> DataFrame:
    """Exchanges (user_id, space_id, seq, question, answer, at), a stream or a batch -> the dialog after each micro-batch.

    ``dialogs`` are stored dialogs to go on from, taken over when the stream first starts. State of a key is bounded by ``max_turns`` turns and
    the summary's lines. Streams need the RocksDB state store.
    """
    rows = exchanges.withColumn("ts", F.col("at").cast("string"))
    start = dialogs.select("user_id", "space_id", "running_summary", "recent_turns", "turns_count").groupBy("user_id", "space_id") if dialogs is not None else None
    return rows.groupBy("user_id", "space_id").transformWithStateInPandas(DialogProcessor(max_turns, keep), DIALOG_DDL, "update", "none", start)


def stream_dialogs(exchanges: DataFrame, table: BucketedTable, checkpoint: str, *, max_turns: int = MAX_TURNS, keep: int = KEEP_TURNS):
    """Start the stream that keeps the table of dialogs: it goes on from the rows that are there, and each micro-batch's dialogs
    replace theirs in the buckets that they fall into. The table is keyed by ``dialog_id`` (user and space)."""
    held = table.read()
    states = compact_dialogs(exchanges, max_turns=max_turns, keep=keep, dialogs=held.drop("dialog_id")).withColumn("dialog_id", dialog_id())
    first = max(table.versions(), default=-1) + 1
    replace = lambda rows, new: rows.join(new.select("dialog_id"), "dialog_id", "left_anti").unionByName(new.select(*rows.columns))
    return states.writeStream.outputMode("update").foreachBatch(lambda batch, number: table.update(batch, first + number, replace)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dialog_id():
    return F.sha2(F.to_json(F.array("user_id", "space_id")), 256)
