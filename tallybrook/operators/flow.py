"""The whole way from messages to entity rows and revisions as one batch job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.operators import changes as ch
from tallybrook.operators import resolve as rs
from tallybrook.operators import revisions as rv
from tallybrook.operators.components import kept, release
from tallybrook.operators.vectors import CANDIDATE_K, CANDIDATE_THRESHOLD

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Resolved:
    """What a batch of messages does: the entities after it, the revisions to append, what found no entity and why."""

    entities: DataFrame
    revisions: DataFrame
    unmatched: DataFrame


def entity_name(message_id: Column) -> Column:
    """The id of the entity that a message creates: the same whenever it is processed."""
    return F.sha2(F.coalesce(message_id.cast("string"), F.lit("")), 256)


def resolve_batch(messages: DataFrame, entities: DataFrame, journal: DataFrame, *, classify: Step, extract: Step, embed: Step, threshold: float = CANDIDATE_THRESHOLD, k: int = CANDIDATE_K, least: float = rs.LEAST_CONFIDENCE, score: Column | None = None) -> Resolved:
    """Messages (seq, message_id, text, author_id, author_name, at and what the roles read) resolved against ``entities``.

    Roles: ``classify`` adds ``relevant``, ``extract`` action, entity_ref, fields and confidence, ``embed`` adds ``vector`` to rows with
    ``ref``. All records are matched against the entities as they were before the batch, in one search; new ones of the same thing
    among the batch's creates become one, the later creates being updates of it. Then each entity's updates are folded in the
    order of ``seq`` up to its first close; what comes after a close is in ``unmatched``, with records that found nothing
    or an unknown entity. Revisions that the journal has for the same (message, action) aren't made again. A null message id has no
    effect. Every step is a join or a fold on a key of its own, so no space is one task. The search is made once, its decisions are kept,
    and the shuffle files of a step go when its rows are kept; only entities that the batch updates are met with their updates.
    """
    spark = messages.sparkSession
    relevant = classify(messages.filter(F.col("message_id").isNotNull())).filter("relevant")
    records = embed(rs.reference_key(extract(relevant))).withColumn("query_id", F.col("message_id"))
    records = kept(records.select("query_id", "seq", "message_id", "action", "entity_ref", "ref", "fields", "confidence", "at", "author_id", "author_name", "vector"))
    release(spark)
    asked = records.select("query_id", "vector", "action")
    match = rs.resolve_match(rs.find_candidates(asked, entities, threshold, k), score)
    parts = rs.parts_of(kept(rs.known_targets(_decided(records, match, least), entities)))
    release(spark)
    made = parts["insert"]
    same = rs.canonicalise_creates(made.select("query_id", "seq", "vector"), threshold=threshold)
    made = made.join(same, "query_id").withColumn("entity_id", entity_name(F.col("canonical_id"))).withColumn("action", F.when(F.col("canonical_id") == F.col("query_id"), "create").otherwise("update"))
    changed = parts["update"].withColumn("action", F.lit("update")).unionByName(parts["close"].withColumn("action", F.lit("close"))).withColumn("entity_id", F.col("target_id"))
    columns = ["entity_id", "seq", "action", "fields", F.col("vector").alias("embedding"), F.col("message_id").alias("last_message_id"), "confidence", "at", "entity_ref", "author_id", "author_name", "match_confidence"]
    updates = kept(made.withColumn("entity_ref", F.col("ref")).select(*columns).unionByName(changed.select(*columns)))
    release(spark)
    applied, late = rv.first_generation(updates, ["entity_id"])
    kinds = {c: t for c, t in entities.dtypes if t != "string"}
    state = entities.select("entity_id", *rv.FIELD_MAP.values(), "status").join(updates.select("entity_id").distinct(), "entity_id", "left_semi")
    diffs = rv.diff_revisions(applied, rv.FIELD_MAP, ["entity_id"], kinds=kinds, state=state)
    log = diffs.select("entity_id", "action", "changed_field", "old_value", "new_value", F.col("last_message_id").alias("source_message_id"), F.coalesce("match_confidence", "confidence").alias("confidence"), F.col("at").alias("created_at"), "seq")
    waiting = rs.pending_review(parts["pending"].withColumn("source_message_id", F.col("message_id")).withColumn("confidence", F.col("match_confidence")), also=["at", "seq"]).withColumnRenamed("at", "created_at")
    new = ch.append_revisions(journal.select("source_message_id", "action"), log.unionByName(waiting.select(*log.columns)), order="seq")
    lost = parts["unmatched"].select("seq", "message_id", "action", "ref", "reason").unionByName(late.select("seq", F.col("last_message_id").alias("message_id"), "action", F.col("entity_ref").alias("ref"), F.lit("entity closed").alias("reason")))
    return Resolved(rv.write_entities(entities, applied.drop("match_confidence")), new.drop("seq"), lost)


def _decided(records: DataFrame, match: DataFrame, least: float) -> DataFrame:
    rows = records.join(match.withColumnRenamed("confidence", "match_confidence"), "query_id", "left")
    what = rs.decide_action(F.col("action"), F.col("n_candidates"), F.col("match_id"), F.col("match_confidence"), least)
    return rows.withColumn("__d", what).select(*rows.columns, F.col("__d.effective").alias("effective"), F.col("__d.target_id").alias("target_id"))
