"""Entity state as a fold of revisions: generations, folds, diffs, and retraction when sources go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybrook.functions.values import DEFAULT_CURRENCY, falsy_coalesce, json_diff, json_value

# The fields an update may set (source name to column). A status counts at creation only.
FIELD_MAP = {"title": "title", "salary_min": "range_min", "salary_max": "range_max", "currency": "currency", "owner": "owner_name", "team": "team", "description": "description"}


def entity_generation(updates: DataFrame, key: str = "key", order: str = "seq", closing: Column | None = None) -> DataFrame:
    """Adds ``generation``: how many closes of the key came before. A closed entity is no candidate any more, so what
    comes after a close belongs to a new one."""
    close = closing if closing is not None else F.col("action") == "close"
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return updates.withColumn("generation", F.coalesce(F.sum(close.cast("int")).over(before), F.lit(0)).cast("int"))


def fold_entities(updates: DataFrame, fields: list[str], keys: list[str], *, order: str = "seq") -> DataFrame:
    """Fold updates (keys, seq, action, fields map) to one row: the last present value of each field, status, n_updates,
    last_seq.

    A field that a map doesn't hold keeps its value; one it holds as null becomes null. A close forces the status; a
    status among the fields counts with the create only.
    """
    last = [F.max(F.when(F.map_contains_key("fields", f), F.struct(order, F.col("fields")[f].alias("v")))).alias(f) for f in fields]
    closed = F.count(F.when(F.col("action") == "close", 1)).alias("closes")
    given = F.min(F.when(F.col("action") == "create", F.struct(order, F.col("fields")["status"].alias("v")))).alias("given")
    rows = updates.groupBy(*keys).agg(*last, closed, given, F.count("*").alias("n_updates"), F.max(order).alias("last_seq"))
    status = F.when(F.col("closes") > 0, "closed").otherwise(F.coalesce("given.v", F.lit("open")))
    return rows.select(*keys, *(F.col(f"{f}.v").alias(f) for f in fields), status.alias("status"), "n_updates", "last_seq")


def first_generation(updates: DataFrame, keys: list[str], *, order: str = "seq", closed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(updates up to and with the first close of their key, the later ones): a closed entity takes nothing more.
    Keys in ``closed`` take nothing at all."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = updates.withColumn("__late", F.coalesce(F.max(F.col("action") == "close").over(before), F.lit(False)))
    if closed is not None:
        marks = closed.select(*keys).distinct().withColumn("__shut", F.lit(True))
        rows = rows.join(marks, keys, "left").withColumn("__late", F.col("__late") | F.coalesce("__shut", F.lit(False))).drop("__shut")
    return rows.filter("not __late").select(*updates.columns), rows.filter("__late").select(*updates.columns)


def diff_revisions(updates: DataFrame, fields: list[str] | dict[str, str], keys: list[str], *, order: str = "seq", kinds: dict[str, str] | None = None, state: DataFrame | None = None) -> DataFrame:
    """Adds changed_field, old_value and new_value to updates (keys, seq, action, fields map).

    ``fields`` maps names in the map to columns of the entity (a list: the same names), ``kinds`` gives the types of columns
    that aren't strings. A create has its whole map as new_value and no other part. Any other update names the columns whose
    values it changes, joined by ', ', with their values before and after as JSON; a close adds the status. All three are null
    where nothing changes. ``state`` (keys, columns, status) holds the entities as they were before these updates;
    without a row there the values are null and the status 'open'. Updates after a close are to be left out before.
    """
    columns = fields if isinstance(fields, dict) else {f: f for f in fields}
    kinds = kinds or {}
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = updates
    if state is not None:
        rows = rows.join(state.select(*keys, *(F.col(c).alias(f"__was_{c}") for c in columns.values()), F.col("status").alias("__was_status")), keys, "left")
    first = F.col("__start")
    rows = rows.withColumn("__start", F.max(F.when(F.col("action") == "create", F.struct(F.col("fields")["status"].alias("v")))).over(before))
    for f, c in columns.items():
        there = F.when(F.map_contains_key("fields", f), F.struct(_cast(F.col("fields")[f], kinds.get(c)).alias("v")))
        was = F.last(there, ignorenulls=True).over(before)
        rows = rows.withColumn(f"__{c}", F.when(was.isNotNull(), was["v"]).otherwise(F.col(f"__was_{c}") if state is not None else F.lit(None)))
    status = F.coalesce(first["v"], *([F.col("__was_status")] if state is not None else []), F.lit("open"))
    created, closed = F.col("action") == "create", F.col("action") == "close"
    changed = {f: ~created & F.map_contains_key("fields", f) & ~_cast(F.col("fields")[f], kinds.get(c)).eqNullSafe(F.col(f"__{c}")) for f, c in columns.items()}
    names = F.filter(F.array(*(F.when(changed[f], F.lit(c)) for f, c in columns.items()), F.when(closed, F.lit("status"))), lambda x: x.isNotNull())
    number = {c: kinds.get(c, "string") != "string" for c in columns.values()}
    old = [(c, changed[f], json_value(F.col(f"__{c}"), number[c])) for f, c in columns.items()] + [("status", closed, json_value(status, False))]
    new = [(c, changed[f], json_value(_cast(F.col("fields")[f], kinds.get(c)), number[c])) for f, c in columns.items()] + [("status", closed, F.lit('"closed"'))]
    given = F.to_json("fields", {"ignoreNullFields": "false"})
    rows = rows.withColumn("changed_field", F.when(F.size(names) > 0, F.array_join(names, ", ")))
    rows = rows.withColumn("old_value", json_diff(old)).withColumn("new_value", F.when(created, given).otherwise(json_diff(new)))
    return rows.select(*updates.columns, "changed_field", "old_value", "new_value")


def _cast(value: Column, kind: str | None) -> Column:
    return value if kind in (None, "string") else value.try_cast(kind)


def write_entities(entities: DataFrame, updates: DataFrame) -> DataFrame:
    """The next snapshot of entity state: updates (entity_id, seq, action, fields map, embedding, last_message_id,
    confidence, at, and, if they are there, entity_ref, author_id, author_name) folded onto the current rows. The map's values are
    strings; numbers are cast, a value that isn't one becomes null.

    The first update of an entity without a row makes it: its title is the field or else the reference, its owner the field or
    else the author, its status the field or 'open', its currency the field or the default. Later fields overwrite in order,
    an explicit null too; the vector is replaced unless the update closes; last_message_id, confidence and
    updated_at are always overwritten. What follows a close, or is for an entity that is closed already, changes nothing.
    """
    updates, _ = first_generation(updates, ["entity_id"], closed=entities.filter("status = 'closed'"))
    there = updates.columns
    given = lambda c: F.col(c) if c in there else F.lit(None).cast("string")
    at = [F.max(F.when(F.map_contains_key("fields", f), F.struct("seq", F.col("fields")[f].alias("v")))).alias(f"new_{f}") for f in FIELD_MAP]
    new = updates.groupBy("entity_id").agg(
        *at, F.max(F.struct("seq", "last_message_id", "confidence", "at")).alias("latest"), F.max(F.when(F.col("action") != "close", F.struct("seq", "embedding"))).alias("moved"), F.max(F.col("action") == "close").alias("closes"),
        F.min(F.struct("seq", "at", given("entity_ref").alias("ref"), given("author_id").alias("author_id"), given("author_name").alias("author"), F.col("fields")["status"].alias("status"))).alias("started"),
    )
    rows = entities.withColumn("__old", F.lit(True)).join(new, "entity_id", "full_outer")
    kinds = dict(entities.dtypes)
    known, fresh = F.col("__old").isNotNull(), F.col("latest").isNotNull()

    def value(source: str, column: str) -> Column:
        got = F.col(f"new_{source}")
        value = F.when(got.isNotNull(), _cast(got["v"], kinds[column])).otherwise(F.col(column))
        fallback = {"title": F.col("started.ref"), "owner_name": F.col("started.author")}.get(column)
        if fallback is not None:  # of the create's own field only
            value = F.when(~known & (got.isNull() | (got["seq"] == F.col("started.seq"))), falsy_coalesce(got["v"], fallback)).otherwise(value)
        return F.when(known, value).otherwise(F.coalesce(value, F.lit(DEFAULT_CURRENCY))) if column == "currency" else value

    made = {column: value(source, column) for source, column in FIELD_MAP.items()}
    special = {
        "status": F.when(F.coalesce("closes", F.lit(False)), "closed").when(known, F.col("status")).otherwise(F.coalesce("started.status", F.lit("open"))),
        "embedding": F.coalesce("moved.embedding", "embedding"), "last_message_id": F.when(fresh, F.col("latest.last_message_id")).otherwise(F.col("last_message_id")),
        "confidence": F.when(fresh, F.col("latest.confidence")).otherwise(F.col("confidence")), "is_deleted": F.coalesce("is_deleted", F.lit(False)),
        "created_at": F.when(known, F.col("created_at")).otherwise(F.col("started.at")), "updated_at": F.when(fresh, F.col("latest.at")).otherwise(F.col("updated_at")),
        "owner_id": F.when(known, F.col("owner_id")).otherwise(F.col("started.author_id")) if "owner_id" in kinds else None,
    }
    return rows.select(*((made | special).get(c, F.col(c)).alias(c) for c in entities.columns))


def join_revisions_messages(revisions: DataFrame, messages: DataFrame) -> DataFrame:
    """Revisions with their source message, live ones only; a null source has none."""
    live = messages.filter(~F.col("is_deleted")).withColumnRenamed("message_id", "source_message_id")
    return revisions.join(live, "source_message_id")


def live_source_count(revisions: DataFrame, messages: DataFrame) -> DataFrame:
    """(entity_id, n_live): revisions whose source is a live message; any action counts, a null source never."""
    live = messages.filter(~F.col("is_deleted")).select(F.col("message_id").alias("source_message_id"))
    hit = revisions.join(live.withColumn("live", F.lit(1)), "source_message_id", "left")
    return hit.groupBy("entity_id").agg(F.count("live").alias("n_live"))


def touched_entities(revisions: DataFrame, gone: DataFrame) -> DataFrame:
    """Distinct entities whose revisions cite one of the deleted messages (message_id)."""
    return revisions.join(gone.select(F.col("message_id").alias("source_message_id")), "source_message_id", "left_semi").select("entity_id").distinct()


def orphan_entities(revisions: DataFrame, messages: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Touched entities without a live source: one anti join, no loop over entities."""
    gone = gone if gone is not None else messages.filter("is_deleted")
    held = join_revisions_messages(revisions.select("entity_id", "source_message_id"), messages.select("message_id", "is_deleted")).select("entity_id")
    return touched_entities(revisions, gone).join(held, "entity_id", "left_anti")


def retract(entities: DataFrame, orphans: DataFrame) -> DataFrame:
    """Entities with the orphans flagged; nothing ever clears the flag."""
    marks = orphans.select("entity_id").distinct().withColumn("__orphan", F.lit(True))
    return entities.join(marks, "entity_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("__orphan", F.lit(False))).drop("__orphan").select(*entities.columns)
