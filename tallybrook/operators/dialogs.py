"""Dialog memory: the last turns of each (user, space), older ones folded into a summary."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybrook.functions.values import append_turns
from tallybrook.sources.schemas import TURNS_DDL

# At this many turns a dialog is compacted to so many.
MAX_TURNS, KEEP_TURNS = 12, 6
#: A summary has at most so many lines, the oldest going first, and a line so many characters; what the first sentence of a text is.
SUMMARY_LINES, LINE_CHARS = 40, 300
SENTENCE = r"^([^.!?\n]*[.!?]?)"


def keep_last_n(turns: Column, n: int = KEEP_TURNS) -> Column:
    return F.when(F.size(turns) > n, F.slice(turns, -n, n)).otherwise(turns)


def evicted(turns: Column, n: int = KEEP_TURNS) -> Column:
    """The turns before the last n."""
    return F.when(F.size(turns) > n, F.slice(turns, F.lit(1), F.size(turns) - n)).otherwise(F.slice(turns, 1, 0))


def window_length(exchanges: Column, max_turns: int = MAX_TURNS, keep: int = KEEP_TURNS) -> Column:
    """Turns held after so many exchanges of two turns: they grow to ``max_turns``, are cut to ``keep``, and so on."""
    first = max_turns // 2
    step = (max_turns - keep) // 2
    return F.when(exchanges < first, 2 * exchanges).otherwise(keep + 2 * ((exchanges - first) % step)).cast("int")


def fold_dialogs(exchanges: DataFrame, keys: list[str], order: str, *, max_turns: int = MAX_TURNS, keep: int = KEEP_TURNS) -> DataFrame:
    """Batch form of compaction: per dialog turns_count (exchanges), kept (turns held) and evicted (turns folded away)."""
    rows = exchanges.groupBy(*keys).agg(F.count("*").alias("turns_count"))
    kept = window_length(F.col("turns_count"), max_turns, keep)
    return rows.withColumn("kept", kept).withColumn("evicted", (2 * F.col("turns_count") - F.col("kept")).cast("int"))


def last_turns(turns: DataFrame, keys: list[str], order: list[str], n: int = KEEP_TURNS) -> DataFrame:
    """Rows of the last n turns of each dialog."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))
    return turns.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def get_or_create_dialog(dialogs: DataFrame, asked: DataFrame) -> DataFrame:
    """The dialog of each asked (user_id, space_id), an empty one where there is none."""
    keys = asked.select("user_id", "space_id").distinct()
    rows = keys.join(dialogs, ["user_id", "space_id"], "left")
    return rows.select("user_id", "space_id", F.coalesce("running_summary", F.lit("")).alias("running_summary"), F.coalesce("recent_turns", F.array().cast("array<struct<role:string,text:string,ts:string>>")).alias("recent_turns"), F.coalesce("turns_count", F.lit(0)).alias("turns_count"))


def summarise_turns(summary: Column, turns: Column, *, most_lines: int | None = SUMMARY_LINES, most_chars: int | None = LINE_CHARS) -> Column:
    """Extractive default: the old summary and the first sentence of each evicted turn, repeats left out. ``most_lines`` keeps the
    newest lines only and ``most_chars`` cuts them, as a dialog's memory over many batches needs it; None is no limit."""
    whole = lambda t: F.trim(F.regexp_extract(F.coalesce(t["text"], F.lit("")), SENTENCE, 1))
    first = F.transform(turns, whole if most_chars is None else lambda t: F.substring(whole(t), 1, most_chars))
    lines = F.filter(F.array_distinct(F.concat(F.split(F.coalesce(summary, F.lit("")), "\n"), first)), lambda x: x != "")
    if most_lines is not None:
        lines = F.when(F.size(lines) > most_lines, F.slice(lines, -most_lines, most_lines)).otherwise(lines)
    return F.array_join(lines, "\n")


def whole_turns(summary: Column, turns: Column) -> Column:
    """``summarise_turns`` with every line whole, for dialogs that are compacted once."""
    return summarise_turns(summary, turns, most_lines=None, most_chars=None)


def summarise_lines(lines: list[str], texts: list[str | None]) -> list[str]:
    """The rule of ``summarise_turns`` for one dialog in a task."""
    out = list(lines)
    for text in texts:
        line = re.match(SENTENCE, text or "").group(1).strip(" ")[:LINE_CHARS]
        if line and line not in out:
            out.append(line)
    return out[-SUMMARY_LINES:]


def write_dialogs(dialogs: DataFrame, exchanges: DataFrame, *, max_turns: int = MAX_TURNS, keep: int = KEEP_TURNS) -> DataFrame:
    """Dialogs (user_id, space_id, running_summary, recent_turns, turns_count, updated_at) after a batch of exchanges (user_id, space_id,
    seq, question, answer, at), applied in the order of ``seq``.

    Each exchange adds a turn of the user and one of the assistant, raises the counter by one and sets updated_at; at
    ``max_turns`` turns all but the last ``keep`` go into the summary. A dialog that isn't there begins empty. One shuffle on
    the dialog's key; a batch's exchanges of one dialog meet in one row, as they follow from each other.
    """
    keys = ["user_id", "space_id"]
    new = exchanges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "question", "answer", F.col("at").cast("string").alias("ts")))).alias("__new"), F.count("*").cast("int").alias("__n"), F.max_by("at", "seq").alias("__at"))
    rows = dialogs.join(new, keys, "full_outer")
    turns = F.coalesce("recent_turns", F.array().cast(TURNS_DDL))
    start = F.struct(F.coalesce("running_summary", F.lit("")).alias("summary"), turns.alias("turns"))

    def step(held: Column, x: Column) -> Column:
        grown = append_turns(append_turns(held["turns"], F.lit("user"), x["question"], x["ts"]), F.lit("assistant"), x["answer"], x["ts"])
        due = (F.size(grown) >= max_turns) & (F.size(grown) > keep)
        summary = F.when(due, summarise_turns(held["summary"], evicted(grown, keep))).otherwise(held["summary"])
        return F.struct(summary.alias("summary"), F.when(due, keep_last_n(grown, keep)).otherwise(grown).alias("turns"))

    after = F.when(F.col("__n").isNotNull(), F.aggregate("__new", start, step)).otherwise(start)
    made = {"running_summary": F.col("__s.summary"), "recent_turns": F.col("__s.turns"), "turns_count": F.coalesce("turns_count", F.lit(0)) + F.coalesce("__n", F.lit(0)), "updated_at": F.coalesce("__at", "updated_at")}
    return rows.withColumn("__s", after).select(*keys, *(v.alias(k) for k, v in made.items()))


def compact(dialogs: DataFrame, *, max_turns: int = MAX_TURNS, keep: int = KEEP_TURNS, summarise: Callable[[Column, Column], Column] = summarise_turns) -> DataFrame:
    """Dialogs of ``max_turns`` or more cut to the last ``keep``, the rest summarised; others as they are."""
    due = (F.size("recent_turns") >= max_turns) & (F.size("recent_turns") > keep)
    summary = F.when(due, summarise(F.col("running_summary"), evicted(F.col("recent_turns"), keep))).otherwise(F.col("running_summary"))
    turns = F.when(due, keep_last_n(F.col("recent_turns"), keep)).otherwise(F.col("recent_turns"))
    return dialogs.withColumn("running_summary", summary).withColumn("recent_turns", turns)
