"""Changes applied in keyed state: the latest image of each message, and early changes held until their create or a timeout."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

IMAGES_DDL = "message_id string, first_seq long, last_seq long, text string, is_edited boolean, is_deleted boolean, expired long"
_IMAGE = "first_seq long, last_seq long, text string, edit_seq long, is_deleted boolean"
_EARLY = "edit_seq long, edit_text string, edit_ms long, delete_seq long, delete_ms long, last_seq long"


class ChangeProcessor(StatefulProcessor):
    """State of one message: its image once it is created; before that its last early edit and an early delete.

    Both parts have a fixed size, however many changes come. An early change is forgotten ``hold_ms`` after it arrived,
    by a timer on arrival time.
    """

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.image = handle.getValueState("image", _IMAGE)
        self.early = handle.getValueState("early", _EARLY)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        image = self.image.get() if self.image.exists() else None
        early = self.early.get() if self.early.exists() else None
        edit = (early[0], early[1], early[2]) if early is not None and early[0] is not None else None
        gone = (early[3], early[4]) if early is not None and early[3] is not None else None
        last = early[5] if early is not None else None
        created = None if image is None else (image[0], image[2])
        if image is not None:
            last, edit, gone = image[1], (image[3], image[2], 0) if image[3] is not None else None, (image[1], 0) if image[4] else None
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            text = None if r.text is None or r.text != r.text else r.text
            seq = int(r.seq)
            last = seq if last is None else max(last, seq)
            if r.change == "created" and (created is None or seq < created[0]):
                created = (seq, text)
            elif r.change == "updated" and (edit is None or seq >= edit[0]):
                edit = (seq, text, int(r.arrived_ms))
            elif r.change == "deleted" and (gone is None or seq >= gone[0]):
                gone = (seq, int(r.arrived_ms))
        if created is None:
            if edit is None and gone is None:
                return iter(())
            self.early.update((*(edit or (None, None, None)), *(gone or (None, None)), last))
            self._set_timer(edit, gone)
            return iter(())
        self.early.clear()
        shown = edit[1] if edit is not None else created[1]
        self.image.update((created[0], last, shown, edit[0] if edit is not None else None, gone is not None))
        return iter([pd.DataFrame({"message_id": [key[0]], "first_seq": [created[0]], "last_seq": [last], "text": pd.Series([shown], dtype="object"), "is_edited": [edit is not None], "is_deleted": [gone is not None], "expired": [0]})])

    def _set_timer(self, edit, gone) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        self.handle.registerTimer(min(x for x in (edit and edit[2], gone and gone[1]) if x is not None) + self.hold_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        if not self.early.exists():
            return iter(())
        now = expiredTimerInfo.getExpiryTimeInMs()
        e = self.early.get()
        edit = (e[0], e[1], e[2]) if e[0] is not None and e[2] + self.hold_ms > now else None
        gone = (e[3], e[4]) if e[3] is not None and e[4] + self.hold_ms > now else None
        dropped = (e[0] is not None and edit is None) + (e[3] is not None and gone is None)
        if edit is None and gone is None:
            self.early.clear()
        else:
            self.early.update((*(edit or (None, None, None)), *(gone or (None, None)), max(x[0] for x in (edit, gone) if x is not None)))
            self._set_timer(edit, gone)
        return iter([pd.DataFrame({"message_id": [key[0]], "first_seq": pd.Series([None], dtype="Int64"), "last_seq": pd.Series([None], dtype="Int64"), "text": pd.Series([None], dtype="object"), "is_edited": pd.Series([None], dtype="boolean"), "is_deleted": pd.Series([None], dtype="boolean"), "expired": [int(dropped)]})])

    def close(self) -> None:
        pass


def apply_in_state(changes: DataFrame, *, arrived: str = "arrived_at", hold_hours: float = 24.0, lateness: str = "0 seconds") -> DataFrame:
    """Changes (message_id, seq, change, text, arrival time) to the image of each touched message after each micro-batch
    (``IMAGES_DDL``): the fold of ``apply_changes(hold_early=True)``, early changes counting for ``hold_hours`` of arrival time.

    Where early changes have run out, a row with nulls says how many (``expired``), for a dead-letter table. Changes of a null id
    are left out. The session needs the RocksDB state store; state is one row a message.
    """
    rows = changes.filter(F.col("message_id").isNotNull()).withWatermark(arrived, lateness)
    rows = rows.select("message_id", "seq", "change", "text", F.unix_millis(F.col(arrived).cast("timestamp")).alias("arrived_ms"), arrived)
    return rows.groupBy("message_id").transformWithStateInPandas(ChangeProcessor(int(hold_hours * 3_600_000)), IMAGES_DDL, "update", "eventTime")


def stream_apply_in_state(changes: DataFrame, out: str, dead: str, checkpoint: str, **options):
    """Start the stream: images and run-out changes are written under their batch id. The last image of a message counts."""

    def body(batch: DataFrame, number: int) -> None:
        batch.filter("expired = 0").drop("expired").withColumn("batch_id", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.filter("expired > 0").select("message_id", "expired").write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return apply_in_state(changes, **options).writeStream.outputMode("update").foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
