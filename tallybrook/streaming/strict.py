"""Resolution in strict arrival order: one message after the other against state that the message before it has changed.

State is keyed by space. A batch that matches against the state before it (``operators.flow``) runs spaces' messages side by side and makes its own
creates canonical; here a create is a candidate for the very next message, whatever the micro-batches. The price is one task a
space and micro-batch, its work growing with the space's open entities: use it where the order matters more than one
space's throughput.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from tallybrook.functions.values import DEFAULT_CURRENCY
from tallybrook.operators.resolve import LEAST_CONFIDENCE
from tallybrook.operators.revisions import FIELD_MAP
from tallybrook.operators.vectors import CANDIDATE_K, CANDIDATE_THRESHOLD

RECORDS_DDL = "space_id string, seq long, message_id string, text string, author_id string, author_name string, action string, entity_ref string, fields string, confidence double, vector array<double>"
_ENTITY = ("title", "status", "range_min", "range_max", "currency", "owner_id", "owner_name", "team", "description", "last_message_id")
_ENTITY_DDL = "title string, status string, range_min int, range_max int, currency string, owner_id string, owner_name string, team string, description string, last_message_id string"
STATE_DDL = f"{_ENTITY_DDL}, confidence double, embedding array<double>"
EFFECTS_DDL = f"space_id string, seq long, message_id string, effective string, entity_id string, changed_field string, old_value string, new_value string, match_confidence double, recorded boolean, {_ENTITY_DDL}, confidence double, embedding array<double>"
_NUMBERS = ("range_min", "range_max")

Chooser = Callable[[str, list[tuple[str, float]], str], tuple[str | None, float]]


def nearest_is_the_match(ref: str, candidates: list[tuple[str, float]], text: str) -> tuple[str | None, float]:
    """The default choice: the nearest candidate, its similarity being the confidence."""
    return candidates[0]


def _typed(column: str, value: Any) -> Any:
    if column not in _NUMBERS or value is None:
        return value if value is None or isinstance(value, str) else str(value)
    try:
        number = int(value)
    except (TypeError, ValueError):
        return None
    return number if -(2**31) <= number < 2**31 else None


def _json(values: dict) -> str | None:
    return json.dumps(values, ensure_ascii=False, separators=(",", ":")) if values else None


class SpaceResolver(StatefulProcessor):
    """Keyed state of a space: its open entities with their vectors, and which (message, action) have a revision."""

    def __init__(self, threshold: float = CANDIDATE_THRESHOLD, k: int = CANDIDATE_K, least: float = LEAST_CONFIDENCE, choose: Chooser = nearest_is_the_match, seen_ms: int | None = None):
        self.threshold, self.k, self.least, self.choose, self.seen_ms = threshold, k, least, choose, seen_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entities = handle.getMapState("entities", "entity_id string", STATE_DDL)
        self.seen = handle.getMapState("seen", "message_id string, action string", "seq long", self.seen_ms) if self.seen_ms else handle.getMapState("seen", "message_id string, action string", "seq long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for r in initialState.to_dict("records"):
            if r["status"] != "closed":
                self.entities.updateValue((r["entity_id"],), tuple(_plain(r[c]) for c in (*_ENTITY, "confidence", "embedding")))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        open_now = {k[0]: dict(zip((*_ENTITY, "confidence", "embedding"), v, strict=True)) for k, v in self.entities.iterator()} if self.entities.exists() else {}
        ids, units = list(open_now), [_unit(e["embedding"]) for e in open_now.values()]
        effects: list[dict] = []
        touched: set[str] = set()
        for r in pd.concat(list(rows)).sort_values(["seq", "message_id"]).to_dict("records"):
            r = {c: _plain(v) for c, v in r.items()}
            effect = self._one(r, open_now, ids, units)
            if effect is None:
                continue
            entity = effect["entity_id"]
            effect["recorded"] = False
            if effect["effective"] in ("create", "update", "close", "pending"):
                mark = (r["message_id"], effect["effective"])
                effect["recorded"] = r["message_id"] is None or not self.seen.containsKey(mark)
                if effect["recorded"] and r["message_id"] is not None:
                    self.seen.updateValue(mark, (r["seq"],))
            if entity is not None and effect["effective"] != "pending":
                touched.add(entity)
            effects.append({"space_id": key[0], "seq": r["seq"], "message_id": r["message_id"], **effect})
        for entity in touched:
            if entity in open_now:
                e = open_now[entity]
                self.entities.updateValue((entity,), tuple(e[c] for c in (*_ENTITY, "confidence", "embedding")))
            elif self.entities.exists() and self.entities.containsKey((entity,)):
                self.entities.removeKey((entity,))
        columns = [c.split()[0] for c in EFFECTS_DDL.split(", ")]
        out = pd.DataFrame({c: pd.Series([e.get(c) for e in effects], dtype="object") for c in columns})
        yield out.astype({"seq": "int64", "recorded": "bool"} if len(out) else {})

    def _one(self, r: dict, open_now: dict[str, dict], ids: list[str], units: list[np.ndarray]) -> dict | None:
        """What one record does; the open entities are changed in place."""
        if r["action"] == "retract":
            gone = open_now.pop(r["entity_ref"], None)
            _forget(r["entity_ref"], ids, units)
            return {"effective": "retract", "entity_id": r["entity_ref"]} if gone is not None else None
        fields = json.loads(r["fields"]) if r["fields"] else {}
        ref = r["entity_ref"] or fields.get("title")
        if r["action"] not in ("create", "update", "close") or not ref:
            return None
        vector = _unit(r["vector"])
        candidates = [(ids[i], x) for i, x in _nearest(vector, ids, units, self.k)]
        near = [c for c in candidates if c[1] > self.threshold]
        candidates = near if near or r["action"] == "create" else candidates
        match, sure = self.choose(ref, candidates, r["text"] or "") if candidates else (None, 0.0)
        if not match and r["action"] == "create":
            return self._create(r, ref, fields, open_now, ids, units)
        if not match:
            return {"effective": "unmatched", "entity_id": None}
        if match not in open_now:
            return {"effective": "unmatched", "entity_id": None, "match_confidence": sure}
        if sure < self.least:
            return {"effective": "pending", "entity_id": match, "new_value": _json(fields) or "{}", "match_confidence": sure} | open_now[match]
        return self._update(r, match, "close" if r["action"] == "close" else "update", fields, sure, open_now, ids, units)

    def _create(self, r: dict, ref: str, fields: dict, open_now: dict[str, dict], ids: list[str], units: list[np.ndarray]) -> dict:
        name = entity_name(r["message_id"])
        entity = {column: _typed(column, fields.get(source)) for source, column in FIELD_MAP.items()}
        entity |= {"title": fields.get("title") or ref, "status": fields.get("status") or "open", "currency": fields.get("currency") or DEFAULT_CURRENCY, "owner_id": r["author_id"], "owner_name": fields.get("owner") or r["author_name"]}
        entity |= {"last_message_id": r["message_id"], "confidence": r["confidence"], "embedding": r["vector"]}
        _forget(name, ids, units)
        if entity["status"] != "closed":
            open_now[name] = entity
            ids.append(name)
            units.append(_unit(r["vector"]))
        return {"effective": "create", "entity_id": name, "new_value": _json(fields) or "{}"} | entity

    def _update(self, r: dict, name: str, effective: str, fields: dict, sure: float, open_now: dict[str, dict], ids: list[str], units: list[np.ndarray]) -> dict:
        entity = open_now[name]
        old, new = {}, {}
        for source, column in FIELD_MAP.items():
            if source in fields and (value := _typed(column, fields[source])) != entity[column]:
                old[column], new[column] = entity[column], value
        if effective == "close":
            old["status"], new["status"] = entity["status"], "closed"
        entity = entity | new | {"last_message_id": r["message_id"], "confidence": r["confidence"]}
        if effective == "close":
            del open_now[name]
            _forget(name, ids, units)
        else:
            entity["embedding"] = r["vector"]
            open_now[name] = entity
            units[ids.index(name)] = _unit(r["vector"])
        return {"effective": effective, "entity_id": name, "changed_field": ", ".join(new) or None, "old_value": _json(old), "new_value": _json(new), "match_confidence": sure} | entity

    def close(self) -> None:
        pass


def entity_name(message_id: str | None) -> str:
    """The id of the entity that a message creates: the same whenever it is processed."""
    return hashlib.sha256((message_id or "").encode()).hexdigest()


def _plain(value: Any) -> Any:
    """Values as Python's own: no NaN for null, no arrays."""
    if isinstance(value, (list, tuple, np.ndarray)):
        return [float(x) for x in value]
    if value is None or value != value:
        return None
    return value.item() if isinstance(value, np.generic) else value


def _unit(vector: list[float] | None) -> np.ndarray:
    x = np.array(vector or [], dtype=np.float64)
    norm = np.sqrt((x * x).sum())
    return x / norm if norm > 0 else np.zeros(len(x))


def _nearest(vector: np.ndarray, ids: list[str], units: list[np.ndarray], k: int) -> list[tuple[int, float]]:
    """The k nearest as (place, cosine), ties to the smaller id; null, zero and unlike vectors take no part."""
    usable = np.array([i for i, u in enumerate(units) if len(u) == len(vector) and u.any()], dtype=np.int64)
    if not len(usable) or not vector.any():
        return []
    near = np.round(np.stack([units[i] for i in usable]) @ vector, 12)
    least = np.partition(near, -k)[-k] if k < len(near) else near.min()
    best = np.flatnonzero(near >= least)
    return [(int(usable[i]), float(near[i])) for i in sorted(best, key=lambda i: (-near[i], ids[usable[i]]))[:k]]


def _forget(name: str, ids: list[str], units: list[np.ndarray]) -> None:
    if name in ids:
        at = ids.index(name)
        del ids[at], units[at]


def resolve_strictly(records: DataFrame, *, threshold: float = CANDIDATE_THRESHOLD, k: int = CANDIDATE_K, least: float = LEAST_CONFIDENCE, choose: Chooser = nearest_is_the_match, entities: DataFrame | None = None, seen_hours: float | None = None) -> DataFrame:
    """Records (``RECORDS_DDL``; fields as JSON), a stream or a batch, to effects (``EFFECTS_DDL``) in arrival order.

    An effect is a create, update, close, pending, unmatched or retract, with the entity as it is after it; ``recorded`` tells
    whether it makes a revision: one for each (message, action). A closed entity takes nothing more. A record of action retract
    names an entity by id that has lost its sources. Records of action none or without a reference have no effect. ``entities``
    (space_id and the state's columns) are the open entities to start from. ``seen_hours`` bounds how long a
    (message, action) is remembered (null: for ever). Rows of one space in a micro-batch are held in one task.
    """
    mode = "processingTime" if seen_hours else "none"
    processor = SpaceResolver(threshold, k, least, choose, int(seen_hours * 3_600_000) if seen_hours else None)
    start = entities.groupBy("space_id") if entities is not None else None
    return records.groupBy("space_id").transformWithStateInPandas(processor, EFFECTS_DDL, "append", mode, start)


def records_of(messages: DataFrame, classify, extract, embed) -> DataFrame:
    """Messages (space_id, seq, message_id, text, author_id, author_name) through the model roles to records: only
    relevant ones, each with the vector of its reference. Works on a stream, as no role needs other rows.

    ``embed`` adds a column ``vector`` to rows with a column ``ref``.
    """
    rows = extract(classify(messages).filter("relevant")).filter("action != 'none'")
    rows = rows.withColumn("ref", F.coalesce(F.nullif("entity_ref", F.lit("")), F.col("fields")["title"])).filter(F.coalesce("ref", F.lit("")) != "")
    return embed(rows).select("space_id", "seq", "message_id", "text", "author_id", "author_name", "action", "entity_ref", F.to_json("fields", {"ignoreNullFields": "false"}).alias("fields"), "confidence", F.col("vector").cast("array<double>").alias("vector"))


def stream_resolve(records: DataFrame, out: str, checkpoint: str, **options):
    """Start the strict stream: effects are written under their batch id, so a batch that is run again writes the same again.
    The session needs the RocksDB state store."""
    effects = resolve_strictly(records, **options)
    body = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    return effects.writeStream.outputMode("append").foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def revisions_of(effects: DataFrame) -> DataFrame:
    """The revision log that effects make."""
    return effects.filter("recorded").select("entity_id", F.col("effective").alias("action"), "changed_field", "old_value", "new_value", F.col("message_id").alias("source_message_id"), F.coalesce("match_confidence", "confidence").alias("confidence"), "seq")


def entities_of(effects: DataFrame) -> DataFrame:
    """The last state of every entity that effects touch; retracted ones are flagged."""
    changed = effects.filter("effective in ('create', 'update', 'close')")
    last = changed.withColumn("__rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("seq")))).filter("__rank = 1")
    gone = effects.filter("effective = 'retract'").select("entity_id").distinct().withColumn("is_deleted", F.lit(True))
    return last.join(gone, "entity_id", "left").select("entity_id", "space_id", *_ENTITY, "confidence", "embedding", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), F.col("seq").alias("last_seq"))
