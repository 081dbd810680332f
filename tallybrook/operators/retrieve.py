"""Retrieval for a table of questions: nearest messages and entities, and the context text made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.functions.values import falsy_coalesce, format_turns
from tallybrook.operators.vectors import ENTITY_K, MESSAGE_K, knn_join

# Headings and placeholders of the context text.
MEMORY, TURNS, ENTITIES, MESSAGES = "=== Память диалога ===", "Последние реплики:", "=== Актуальное состояние вакансий ===", "=== Релевантные сообщения из пространства ==="
FIRST_DIALOG, NO_TURNS, NO_DATA = "Первый диалог", "—", "Нет данных"


def join_vectors_messages(vectors: DataFrame, messages: DataFrame) -> DataFrame:
    """Vectors of live messages."""
    return vectors.join(messages.filter(~F.col("is_deleted")), "message_id")


def retrieve_messages(queries: DataFrame, vectors: DataFrame, messages: DataFrame, k: int = MESSAGE_K) -> DataFrame:
    """The k nearest live messages of each query (query_id, vector)."""
    live = join_vectors_messages(vectors, messages.select("message_id", "is_deleted"))
    return knn_join(queries, live.select(F.col("message_id").alias("item_id"), F.col("embedding").alias("vector")), k)


def retrieve_entities(queries: DataFrame, entities: DataFrame, k: int = ENTITY_K) -> DataFrame:
    """The k nearest live entities of each query, of any status."""
    return knn_join(queries, entities.filter(~F.col("is_deleted")).select(F.col("entity_id").alias("item_id"), F.col("embedding").alias("vector")), k)


def assemble_lists(rows: DataFrame, key: str, order: list[Column | str], line: Column) -> DataFrame:
    """(key, text): the lines of each key in order, one below the other; for lists of bounded length."""
    packed = F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line"))))
    return rows.groupBy(key).agg(packed.alias("p")).select(key, F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("text"))


def build_context(queries: DataFrame, dialogs: DataFrame, entity_lines: DataFrame, message_lines: DataFrame) -> DataFrame:
    """(query_id, context): the dialog's summary and last turns, entities and messages of each query.

    ``dialogs`` has query_id, running_summary and recent_turns, the lines query_id and text; what a query lacks has its
    placeholder, an empty summary or list too.
    """
    rows = queries.select("query_id").join(dialogs.select("query_id", "running_summary", format_turns(F.col("recent_turns")).alias("turns")), "query_id", "left")
    for name, part in (("entities", entity_lines), ("messages", message_lines)):
        rows = rows.join(part.select("query_id", F.col("text").alias(name)), "query_id", "left")
    shown = lambda name, none: falsy_coalesce(F.col(name), F.lit(none))
    memory = F.concat(F.lit(f"{MEMORY}\n"), shown("running_summary", FIRST_DIALOG), F.lit(f"\n\n{TURNS}\n"), shown("turns", NO_TURNS))
    found = [F.concat(F.lit(f"{title}\n"), shown(name, NO_DATA)) for title, name in ((ENTITIES, "entities"), (MESSAGES, "messages"))]
    return rows.select("query_id", F.concat_ws("\n\n", memory, *found).alias("context"))


def profile_match(profiles: DataFrame, entities: DataFrame, k: int = ENTITY_K) -> DataFrame:
    """The k nearest open entities of each profile (query_id, vector, wanted) among those whose upper bound, if any,
    reaches what is wanted."""
    open_ = entities.filter(~F.col("is_deleted") & (F.col("status") != "closed")).select(F.col("entity_id").alias("item_id"), F.col("embedding").alias("vector"), "range_max")
    return knn_join(profiles, open_, k, least="wanted", bound="range_max")
