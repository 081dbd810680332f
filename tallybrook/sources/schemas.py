"""Row types of the five tables and of the events, and checks that Spark doesn't make by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the constrained columns may hold.
STATUSES = ("open", "closed", "on_hold", "filled")
ACTIONS = ("create", "update", "close", "pending")
EXTRACTED_ACTIONS = ("create", "update", "close", "none")
MESSAGE_SOURCES = ("chat_a", "chat_b")
INTENTS = ("count", "list_recent", "chart", "salary_chart", "search")
EVENT_TYPES = {
    "google.workspace.chat.message.v1.created": "created",
    "google.workspace.chat.message.v1.updated": "updated",
    "google.workspace.chat.message.v1.deleted": "deleted",
}

CHANGE_EVENT_DDL = "type string, message struct<name string, createTime string, text string, sender struct<name string, displayName string>, thread struct<name string>, space struct<name string>>"
ENVELOPE_DDL = "message struct<data string, messageId string>"
QUESTION_DDL = "type string, user struct<name string, displayName string>, space struct<name string>, message struct<name string, text string, argumentText string, createTime string>"
TURNS_DDL = "array<struct<role:string,text:string,ts:string>>"

MESSAGES_DDL = "message_id string, space_id string, thread_id string, author_id string, author_name string, text string, created_at timestamp, received_at timestamp, source string, is_deleted boolean, is_edited boolean"
ENTITIES_DDL = "entity_id string, title string, status string, range_min int, range_max int, currency string, owner_id string, owner_name string, team string, description string, last_message_id string, embedding array<float>, confidence double, is_deleted boolean, created_at timestamp, updated_at timestamp"
REVISIONS_DDL = "entity_id string, action string, changed_field string, old_value string, new_value string, source_message_id string, confidence double, created_at timestamp"
INTENT_DDL = "kind string, topic string, status string, days int, hours int, group_by string"


def split_valid(frame: DataFrame, column: str, allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows whose column is one of the allowed values, the others with a reason): parquet has no CHECK."""
    good = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return frame.filter(good), frame.filter(~good).withColumn("reason", F.lit(f"bad {column}"))
