"""What was said before a message, in its thread or its space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybrook.operators.components import kept

# Sizes of the windows.
CONTEXT_MESSAGES, SPACE_TAIL = 7, 3


def context_window(messages: DataFrame, scope: str, *, size: int = CONTEXT_MESSAGES, item: Column | None = None) -> Column:
    """The previous ``size`` messages of the same scope in order, the message itself not among them.

    Deleted messages stay in. A null scope has no context. ``item`` is what is kept of each message.
    """
    what = item if item is not None else F.struct("message_id", "author_name", "text", "created_at")
    frame = Window.partitionBy(scope).orderBy("created_at", "message_id").rowsBetween(-size, -1)
    return F.when(F.col(scope).isNotNull(), F.collect_list(what).over(frame)).otherwise(F.array().cast(_array_type(messages, what)))


def _array_type(messages: DataFrame, what: Column) -> str:
    return f"array<{messages.select(what.alias('x')).schema['x'].dataType.simpleString()}>"


def wide_window(messages: DataFrame, scope: str, name: str, *, size: int = CONTEXT_MESSAGES, item: Column | None = None, chunk_rows: int = 100_000) -> DataFrame:
    """Adds ``name``: what ``context_window`` gives, with a scope of any size spread over several tasks.

    Messages are dealt by ranges of (scope, time, id), ``chunk_rows`` to a range. The last ``size`` messages of a scope in each range
    are enough to know what stands before the scope's next range; they are added to it, windows are taken within (scope,
    range), and the added rows dropped. Those tails, ``size`` rows a scope and range, are all that a scope's one task gets.
    """
    what = item if item is not None else F.struct("message_id", "author_name", "text", "created_at")
    ranges = max(1, -(-messages.count() // chunk_rows))
    if ranges == 1:
        return messages.withColumn(name, context_window(messages, scope, size=size, item=item))
    order = ["created_at", "message_id"]
    dealt = kept(messages.repartitionByRange(ranges, scope, *order).withColumn("__chunk", F.spark_partition_id()))
    rows = dealt.filter(F.col(scope).isNotNull()).select(F.col(scope).alias("__scope"), "__chunk", F.col("created_at").alias("__at"), F.col("message_id").alias("__id"), what.alias("__item"), F.struct(*messages.columns).alias("__row"))
    by = lambda *keys: Window.partitionBy(*keys).orderBy("__at", "__id")
    last = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__scope", "__chunk").orderBy(F.desc("__at"), F.desc("__id")))).filter(F.col("__rank") <= size)
    before = F.collect_list(F.struct("__at", "__id", "__item")).over(by("__scope").rowsBetween(-size, -1))
    starts = last.withColumn("__before", before).withColumn("__first", F.row_number().over(by("__scope", "__chunk"))).filter("__first = 1")
    halo = starts.select("__scope", "__chunk", F.explode("__before").alias("b")).select("__scope", "__chunk", "b.__at", "b.__id", "b.__item", F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.lit(True).alias("__halo"))
    both = rows.withColumn("__halo", F.lit(False)).unionByName(halo)
    found = both.withColumn(name, F.collect_list("__item").over(by("__scope", "__chunk").rowsBetween(-size, -1))).filter("not __halo").select("__row.*", name)
    alone = dealt.filter(F.col(scope).isNull()).select(*messages.columns, F.array().cast(_array_type(messages, what)).alias(name))
    return found.unionByName(alone)


def attach_context(messages: DataFrame, *, size: int = CONTEXT_MESSAGES, tail: int = SPACE_TAIL, item: Column | None = None, chunk_rows: int = 100_000) -> DataFrame:
    """Adds thread_context, space_context, prefilter_context and extract_context.

    Both uses take the thread if it has any message; else the prefilter takes the whole space window, the extractor
    its last ``tail``. A thread or space of more than ``chunk_rows`` messages is spread over several tasks.
    """
    rows = wide_window(messages, "thread_id", "thread_context", size=size, item=item, chunk_rows=chunk_rows)
    rows = wide_window(rows, "space_id", "space_context", size=size, item=item, chunk_rows=chunk_rows)
    threaded = F.size("thread_context") > 0
    short = F.when(F.size("space_context") > tail, F.slice("space_context", -tail, tail)).otherwise(F.col("space_context"))
    return rows.withColumn("prefilter_context", F.when(threaded, F.col("thread_context")).otherwise(F.col("space_context"))).withColumn("extract_context", F.when(threaded, F.col("thread_context")).otherwise(short))


def context_as_of(asked: DataFrame, messages: DataFrame, scope: str, *, size: int = CONTEXT_MESSAGES) -> DataFrame:
    """Context at processing time: of each asked message (message_id, scope), the newest ``size`` of its scope with no
    upper bound on time, itself left out; what an edited message is extracted with. Adds ``context``.

    Only the scope's newest ``size`` + 1 are joined, so a busy scope costs no more than a quiet one.
    """
    newest = messages.filter(F.col(scope).isNotNull()).withColumn("__rank", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("created_at"), F.desc("message_id")))).filter(F.col("__rank") <= size + 1)
    other = newest.select(scope, F.struct("created_at", F.col("message_id").alias("id"), "author_name", "text").alias("item"))
    pairs = asked.select("message_id", scope).join(other, scope).filter("message_id != item.id")
    lists = pairs.groupBy("message_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    lists = lists.select("message_id", F.when(F.size("items") > size, F.slice("items", -size, size)).otherwise(F.col("items")).alias("context"))
    return asked.join(lists, "message_id", "left")


def thread_expand(hits: DataFrame, messages: DataFrame) -> DataFrame:
    """All messages of the threads that hits (message_id) are in; a message without a thread stands for itself."""
    threads = messages.join(hits.select("message_id").distinct(), "message_id", "left_semi").select(F.coalesce("thread_id", "message_id").alias("__thread")).distinct()
    return messages.withColumn("__thread", F.coalesce("thread_id", "message_id")).join(threads, "__thread", "left_semi").drop("__thread")
