"""Entity resolution: which entity an extracted record is about, and what to do with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybrook.functions.values import falsy_coalesce
from tallybrook.operators.components import connected, kept
from tallybrook.operators.vectors import CANDIDATE_K, CANDIDATE_THRESHOLD, OPEN_K, knn_join, knn_with_fallback, linked, vector_present, vectors_present

# Fixed value: the least confidence of a match that is acted on.
LEAST_CONFIDENCE = 0.6


def reference_key(records: DataFrame) -> DataFrame:
    """Records (action, entity_ref, fields map) with ``ref``: the reference or else the title; those without, and those
    of action none, are left out."""
    rows = records.withColumn("ref", falsy_coalesce(F.col("entity_ref"), F.col("fields")["title"]))
    return rows.filter((F.col("action") != "none") & (F.coalesce("ref", F.lit("")) != ""))


def open_entities(entities: DataFrame) -> DataFrame:
    """Candidates: live, not closed, with a vector; as (item_id, vector)."""
    return entities.filter(~F.col("is_deleted") & (F.col("status") != "closed") & vector_present()).select(F.col("entity_id").alias("item_id"), F.col("embedding").alias("vector"))


def open_context(messages: DataFrame, entities: DataFrame, k: int = OPEN_K) -> DataFrame:
    """The k nearest open entities of each message (query_id, vector), without a threshold."""
    return knn_join(messages, open_entities(entities), k)


def find_candidates(records: DataFrame, entities: DataFrame, threshold: float = CANDIDATE_THRESHOLD, k: int = CANDIDATE_K) -> DataFrame:
    """Candidates of each record (query_id, vector, action)."""
    return knn_with_fallback(records, open_entities(entities), threshold, k)


def resolve_match(candidates: DataFrame, score: Column | None = None) -> DataFrame:
    """(query_id, match_id, confidence, n_candidates): the best candidate; its similarity is the confidence unless
    ``score`` says otherwise."""
    value = (score if score is not None else F.col("similarity")).alias("c")
    best = F.max(F.struct(value, (-F.col("rank")).alias("r"), F.col("item_id").alias("id"))).alias("b")
    return candidates.groupBy("query_id").agg(best, F.count("*").alias("n_candidates")).select("query_id", F.col("b.id").alias("match_id"), F.col("b.c").alias("confidence"), "n_candidates")


def match_score(similarity: Column, same_thread: Column, same_author: Column, hours_apart: Column, weights: tuple[float, float, float, float] = (0.7, 0.15, 0.1, 0.05)) -> Column:
    """Similarity with thread, author and time proximity added, in 0..1 for a similarity in 0..1."""
    s, t, a, h = weights
    return similarity * s + F.when(same_thread, t).otherwise(0.0) + F.when(same_author, a).otherwise(0.0) + h * F.exp(-F.abs(hours_apart) / 24.0)


def decide_action(action: Column, n_candidates: Column, match_id: Column, confidence: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """Struct (effective, target_id): insert, update, close, pending or unmatched.

    No candidates: a create inserts, anything else is unmatched. A match of enough confidence is updated or closed, a
    create of it being an update; one of less is pending. No match: a create inserts, anything else is unmatched.
    An empty id is no match.
    """
    matched = (F.coalesce(n_candidates, F.lit(0)) > 0) & (F.coalesce(match_id.cast("string"), F.lit("")) != "")
    sure = F.coalesce(confidence >= least, F.lit(False))
    what = (
        F.when(matched & sure & (action == "create"), "update")
        .when(matched & sure, action)
        .when(matched, "pending")
        .when(action == "create", "insert")
        .otherwise("unmatched")
    )
    return F.struct(what.alias("effective"), F.when(matched, match_id).alias("target_id"))


def known_targets(decided: DataFrame, entities: DataFrame) -> DataFrame:
    """Decided records with ``reason``: a target that no entity has makes them unmatched."""
    known = entities.select(F.col("entity_id").alias("target_id")).distinct().withColumn("__known", F.lit(True))
    rows = decided.join(known, "target_id", "left")
    lost = F.col("target_id").isNotNull() & F.col("__known").isNull()
    kind = F.when(lost, "unmatched").otherwise(F.col("effective"))
    reason = F.when(lost, "unknown entity").when(F.col("effective") == "unmatched", "no match")
    return rows.withColumn("effective", kind).withColumn("reason", reason).drop("__known")


def parts_of(rows: DataFrame) -> dict[str, DataFrame]:
    """Records by what happens to them."""
    return {k: rows.filter(F.col("effective") == k) for k in ("insert", "update", "close", "pending", "unmatched")}


def split_decisions(decided: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """Decided records by what happens to them. A target that no entity has goes to ``unmatched`` with its reason."""
    return parts_of(known_targets(decided, entities))


def pending_review(decided: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Revisions of action pending: matches to look at, the entity untouched. ``also`` names columns to carry."""
    return decided.filter("effective = 'pending'").select(F.col("target_id").alias("entity_id"), F.lit("pending").alias("action"), F.lit(None).cast("string").alias("changed_field"), F.lit(None).cast("string").alias("old_value"), F.to_json("fields", {"ignoreNullFields": "false"}).alias("new_value"), "source_message_id", "confidence", *(also or []))


def unmatched_log(decided: DataFrame) -> DataFrame:
    """Updates and closes that found nothing, with the reason."""
    return decided.filter("effective = 'unmatched'").withColumn("reason", F.lit("no match"))


def canonicalise_creates(creates: DataFrame, *, threshold: float = CANDIDATE_THRESHOLD) -> DataFrame:
    """(query_id, canonical_id) of a batch's creates (query_id, seq, vector): creates of the same thing are one entity,
    its id that of the earliest.

    Equal vectors are one, each of their creates linked to the earliest; links of the others are found by cells of pivots
    (``vectors.linked``), and components are contracted, the smallest (seq, id) winning.
    """
    first = kept(vectors_present(creates).groupBy("vector").agg(F.min(F.struct("seq", F.col("query_id").alias("id"))).alias("first")).select("vector", F.col("first.id").alias("item_id")))
    near = linked(first, threshold).union(vectors_present(creates).join(first, "vector").filter("query_id != item_id").select("query_id", "item_id"))
    label = creates.select("query_id", F.struct("seq", F.col("query_id").alias("id")).alias("label"))
    ends = near.join(label.withColumnRenamed("label", "a"), "query_id").join(label.select(F.col("query_id").alias("item_id"), F.col("label").alias("b")), "item_id")
    roots = connected(ends.select("a", "b")).select(F.col("node.id").alias("query_id"), F.col("root.id").alias("root"))
    return creates.select("query_id").join(roots, "query_id", "left").select("query_id", F.coalesce("root", "query_id").alias("canonical_id"))
