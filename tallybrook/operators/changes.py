"""Message log: changes folded to the latest image, and idempotent inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def apply_changes(changes: DataFrame, key: str = "message_id", *, hold_early: bool = False) -> DataFrame:
    """Fold changes (key, seq, change, text, ...) to one row a key: text, is_edited, is_deleted, first_seq, last_seq.

    The first created wins; edits and deletes before it are lost unless ``hold_early``; the last edit after it gives
    the text and sets is_edited, even after a delete; any delete after it sets is_deleted for good.
    One shuffle on the key; all aggregates combine before it.
    """
    first = F.min(F.when(F.col("change") == "created", F.col("seq")))
    after = (lambda c: c) if hold_early else (lambda c: c & (F.col("seq") > F.col("first_seq")))
    created = changes.groupBy(key).agg(first.alias("first_seq")).filter("first_seq is not null")
    rows = changes.join(created, key)
    edit = F.when(after(F.col("change") == "updated"), F.struct("seq", "text"))
    gone = F.when(after(F.col("change") == "deleted"), True)
    start = F.when((F.col("change") == "created") & (F.col("seq") == F.col("first_seq")), F.struct("seq", "text"))
    folded = rows.groupBy(key).agg(F.min("first_seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max(start).alias("start"), F.max(edit).alias("edit"), F.count(gone).alias("gone"))
    text = F.when(F.col("edit").isNotNull(), F.col("edit.text")).otherwise(F.col("start.text"))
    return folded.select(key, "first_seq", "last_seq", text.alias("text"), F.col("edit").isNotNull().alias("is_edited"), (F.col("gone") > 0).alias("is_deleted"))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the order."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


def anti_insert(target: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The new rows to append: the first of each key that the target doesn't hold. A null key is never a conflict."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    keyed = first_of(new.filter(whole), keys, order).join(target.select(*keys).distinct(), keys, "left_anti")
    return keyed.select(*new.columns).union(new.filter(~whole))


def lookup_message(rows: DataFrame, messages: DataFrame, *, key: str = "message_id", known_only: bool = False) -> DataFrame:
    """Rows with the message of their key; a miss has nulls, or is left out if ``known_only``. Messages are unique by id."""
    return rows.join(messages.withColumnRenamed("message_id", key) if key != "message_id" else messages, key, "inner" if known_only else "left")


def append_messages(log: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Messages of a batch that the log doesn't hold yet."""
    return anti_insert(log, new, ["message_id"], [order])


def append_revisions(journal: DataFrame, new: DataFrame, order: str = "seq", *, strict_journal: bool = False) -> DataFrame:
    """Revisions to append: one for each (source, action), all of those without a source. ``strict_journal`` also tells
    apart different payloads of the same source and action."""
    keys = ["source_message_id", "action"]
    if not strict_journal:
        return anti_insert(journal, new, keys, [order])
    mark = F.sha2(F.concat_ws("\x1f", F.coalesce("changed_field", F.lit("\x00")), F.coalesce("new_value", F.lit("\x00"))), 256)
    got = anti_insert(journal.withColumn("__mark", mark), new.withColumn("__mark", mark), [*keys, "__mark"], [order])
    return got.drop("__mark")


def dedup_existing(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the earliest row of each complete key; rows with a null first key stay."""
    return first_of(rows.filter(F.col(keys[0]).isNotNull()), keys, order).select(*rows.columns).union(rows.filter(F.col(keys[0]).isNull()))


def write_vectors(stored: DataFrame, messages: DataFrame, embed, model: str) -> DataFrame:
    """Vectors to append: those of messages without one. ``embed`` maps (message_id, text) to (message_id, embedding);
    equal texts are embedded once."""
    missing = messages.select("message_id", "text").join(stored.filter(F.col("model") == model).select("message_id"), "message_id", "left_anti")
    digest = F.coalesce(F.sha2("text", 256), F.lit(""))  # a null text has a vector too
    texts = missing.groupBy(digest.alias("digest")).agg(F.min("text").alias("text"))
    vectors = embed(texts.select(F.col("digest").alias("message_id"), "text")).select(F.col("message_id").alias("digest"), "embedding")
    return missing.select("message_id", digest.alias("digest")).join(vectors, "digest").select("message_id", "embedding", F.lit(model).alias("model"))


def replace_vectors(stored: DataFrame, edited: DataFrame, embed, model: str) -> DataFrame:
    """All vectors after edits: those of edited messages (message_id, text) made anew, the others as they were."""
    kept = stored.join(edited.select("message_id").distinct(), "message_id", "left_anti")
    return kept.unionByName(write_vectors(stored.limit(0), edited, embed, model))


def embed_incremental(seen: DataFrame, texts: DataFrame, embed, model: str) -> DataFrame:
    """Embeddings of texts whose (digest, model) isn't in ``seen`` (digest, model): (digest, embedding, model)."""
    new = texts.select(F.sha2("text", 256).alias("digest"), "text").groupBy("digest").agg(F.min("text").alias("text"))
    new = new.join(seen.filter(F.col("model") == model).select("digest"), "digest", "left_anti")
    got = embed(new.select(F.col("digest").alias("message_id"), "text"))
    return got.select(F.col("message_id").alias("digest"), "embedding", F.lit(model).alias("model"))
