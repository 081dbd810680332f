"""Change and question events: envelopes decoded, rows parsed, rejects kept apart, changes routed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.values import strip
from tallybrook.sources import schemas


def decode_envelope(frame: DataFrame, column: str = "value", schema: str = schemas.CHANGE_EVENT_DDL) -> tuple[DataFrame, DataFrame]:
    """Push envelopes (JSON with base64 ``message.data``) -> (rows with ``delivery_id`` and ``event``, quarantine).

    Works on a batch or a stream. An envelope without data, or whose data is no base64 or no JSON object, goes to the
    quarantine with the text it came with.
    """
    outer = F.col("__outer.message")
    rows = _once(frame, F.from_json(F.col(column), schemas.ENVELOPE_DDL), "__outer")
    rows = _once(rows, F.try_to_binary(outer["data"], F.lit("base64")).cast("string"), "__body")
    rows = _once(rows, F.from_json("__body", schema), "event").withColumn("delivery_id", outer["messageId"])
    fine = F.col("event").isNotNull() & F.coalesce(F.get_json_object("__body", "$").startswith("{"), F.lit(False))
    return rows.filter(fine).drop("__outer", "__body"), rows.filter(~fine).select(*frame.columns, "delivery_id")


def _once(frame: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column that is computed once a row: filters and projections can't be merged past a generator, so they
    don't repeat the expression for each field they use."""
    return frame.select("*", F.explode(F.array(value)).alias(name))


def parse_change_event(frame: DataFrame, event: str = "event", received_at: Column | None = None) -> DataFrame:
    """Nested change events -> flat rows: change, message_id, space_id, thread_id, author_id, author_name, text, created_at.

    Texts are stripped of white space. ``change`` is null for an unknown type; created_at falls back to ``received_at`` (now by default).
    """
    e = F.col(event)
    kinds = F.create_map(*[F.lit(x) for kv in schemas.EVENT_TYPES.items() for x in kv])
    m = e["message"]
    at = F.coalesce(F.try_to_timestamp(m["createTime"]), received_at if received_at is not None else F.current_timestamp())
    rest = [c for c in frame.columns if c != event]
    return frame.select(*rest, kinds[e["type"]].alias("change"), m["name"].alias("message_id"), m["space"]["name"].alias("space_id"), m["thread"]["name"].alias("thread_id"), m["sender"]["name"].alias("author_id"), m["sender"]["displayName"].alias("author_name"), strip(F.coalesce(m["text"], F.lit(""))).alias("text"), at.alias("created_at"))


def accepted(change: Column, message_id: Column, text: Column) -> Column:
    """Known type, an id, and a text unless the change is a delete."""
    return F.coalesce(change.isNotNull() & (message_id != "") & ((strip(text) != "") | (change == "deleted")), F.lit(False))


def reject_events(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with a reason)."""
    ok = accepted(F.col("change"), F.col("message_id"), F.col("text"))
    reason = F.when(F.col("change").isNull(), "unknown type").when(F.coalesce(F.col("message_id"), F.lit("")) == "", "no id").otherwise("no text")
    return parsed.filter(ok), parsed.filter(~ok).withColumn("reason", reason)


def parse_question_events(frame: DataFrame, event: str = "event") -> DataFrame:
    """Question events -> (user_id, space_id, text); only messages with a text that isn't blank."""
    e = F.col(event)
    rest = [c for c in frame.columns if c != event]
    rows = frame.select(*rest, e["type"].alias("__type"), e["user"]["name"].alias("user_id"), e["space"]["name"].alias("space_id"), strip(e["message"]["text"]).alias("text"))
    return rows.filter((F.col("__type") == "MESSAGE") & (F.col("text") != "")).drop("__type")


def route_changes(changes: DataFrame) -> dict[str, DataFrame]:
    """What each consumer gets: ingest and extract the created, edit the updated, delete the deleted."""
    by = {kind: changes.filter(F.col("change") == kind) for kind in ("created", "updated", "deleted")}
    return {"ingest": by["created"], "extract": by["created"], "edit": by["updated"], "delete": by["deleted"]}
