"""Questions about entity state: counts, recent lists, ranges, groups; one at a time or a table of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybrook.functions.values import DEFAULT_CURRENCY, NOT_STATED, cosine_similarity

# Defaults of the questions.
TOPIC_THRESHOLD = 0.5
RECENT_LIMIT, RECENT_DAYS, RANGES_LIMIT, TOP_GROUPS, TOP_RANGES = 10, 7, 15, 5, 3
GROUP_KEYS = {"team": "team", "status": "status", "owner": "owner_name"}


def live_only() -> Column:
    return ~F.col("is_deleted")


def status_filter(status: str) -> Column:
    """'open' is everything but closed, 'any' everything, another value itself."""
    if status == "any":
        return F.lit(True)
    return F.col("status") != "closed" if status == "open" else F.col("status") == status


def period_filter(days: int | None, hours: int | None, as_of: Column | None = None) -> Column:
    """Created within the period before ``as_of`` (now by default); hours win over days; neither is no filter."""
    now = as_of if as_of is not None else F.current_timestamp()
    if hours is not None:
        return F.col("created_at") >= now - F.make_interval(hours=F.lit(hours))
    if days is not None:
        return F.col("created_at") >= now - F.make_interval(days=F.lit(days))
    return F.lit(True)


def topic_filter(topic: Sequence[float] | None, threshold: float = TOPIC_THRESHOLD) -> Column:
    """Has a vector and is nearer to the topic than the threshold, strictly."""
    if topic is None:
        return F.lit(True)
    vector = F.lit([float(x) for x in topic])
    return F.coalesce(cosine_similarity(F.col("embedding"), vector) > threshold, F.lit(False))


def range_present() -> Column:
    return F.col("range_min").isNotNull() | F.col("range_max").isNotNull()


def entity_filters(*, topic: Sequence[float] | None = None, status: str = "any", days: int | None = None, hours: int | None = None, as_of: Column | None = None, threshold: float = TOPIC_THRESHOLD) -> Column:
    """The one predicate that all questions share."""
    return live_only() & status_filter(status) & period_filter(days, hours, as_of) & topic_filter(topic, threshold)


def count_entities(entities: DataFrame, **filters) -> DataFrame:
    return entities.filter(entity_filters(**filters)).agg(F.count("*").alias("n"))


def list_recent(entities: DataFrame, *, days: int | None = None, hours: int | None = None, status: str = "any", limit: int = RECENT_LIMIT, as_of: Column | None = None) -> DataFrame:
    """Newest first (a null time first, as the largest), then by id."""
    days = RECENT_DAYS if not days and not hours else days
    rows = entities.filter(entity_filters(status=status, days=days, hours=hours, as_of=as_of))
    return rows.orderBy(F.desc_nulls_first("created_at"), "entity_id").limit(limit)


def list_ranges(entities: DataFrame, *, limit: int = RANGES_LIMIT, currency: str | None = None, **filters) -> DataFrame:
    """Entities with a bound, highest first; ``currency`` keeps one currency, as several don't share an axis."""
    rows = entities.filter(entity_filters(**filters) & range_present())
    if currency is not None:
        rows = rows.filter(F.coalesce("currency", F.lit(DEFAULT_CURRENCY)) == currency)
    return rows.orderBy(F.desc_nulls_last("range_max"), F.desc_nulls_last("range_min"), "entity_id").limit(limit)


def group_column(group_by: str) -> str:
    if group_by not in GROUP_KEYS:
        raise ValueError(f"can't group by {group_by!r}; one of {', '.join(GROUP_KEYS)}")
    return GROUP_KEYS[group_by]


def group_count(entities: DataFrame, group_by: str, *, status: str = "any") -> DataFrame:
    """(label, n), most first; null is the label 'не указано', together with any real value that reads so."""
    label = F.coalesce(F.col(group_column(group_by)), F.lit(NOT_STATED)).alias("label")
    return entities.filter(entity_filters(status=status)).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def mode_currency(rows: DataFrame) -> DataFrame:
    """The most frequent currency, null counting as the default one; the first by name of equally frequent ones."""
    counts = rows.groupBy(F.coalesce("currency", F.lit(DEFAULT_CURRENCY)).alias("currency")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "currency").limit(1)


def chart_series(groups: DataFrame, label: str, values: list[str], order: list[Column]) -> DataFrame:
    """One row: labels and one array a value column, in order; for charts of bounded lists."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    rows = groups.withColumn("__rank", rank)
    packed = F.array_sort(F.collect_list(F.struct("__rank", F.col(label).alias("label"), *values)))
    return rows.agg(packed.alias("p")).select(F.col("p.label").alias("labels"), *(F.col(f"p.{v}").alias(v) for v in values))


def group_by_two(entities: DataFrame, rows: str = "team", columns: str = "status", values: Sequence[str] = ("open", "closed", "on_hold", "filled")) -> DataFrame:
    """Counts of two keys, one column a value of the second."""
    return entities.filter(live_only()).groupBy(F.coalesce(rows, F.lit(NOT_STATED)).alias("label")).pivot(columns, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def range_vs_age(entities: DataFrame, as_of: Column) -> DataFrame:
    """Days open and middle of the range, for a scatter of open entities."""
    middle = (F.coalesce("range_min", "range_max") + F.coalesce("range_max", "range_min")) / 2
    return entities.filter(live_only() & status_filter("open") & range_present()).select("entity_id", F.datediff(as_of, "created_at").alias("age_days"), middle.alias("middle"))


# Tables of questions: query_id, kind, status, days, hours, group_by.


#: Hours are grouped 16 to a bucket, those buckets again, and so on: what is newer than an hour is at most 15 buckets of each level.
_LEVELS = 6


def _asks(queries: DataFrame, as_of: Column, default_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, ask) and the distinct asks (ask, want, since): many questions come down to few statuses and bounds."""
    days = F.when((F.coalesce("days", F.lit(0)) == 0) & (F.coalesce("hours", F.lit(0)) == 0), F.lit(default_days)).otherwise(F.nullif("days", F.lit(0)))
    hours = F.nullif("hours", F.lit(0))
    since = F.when(hours.isNotNull(), as_of - F.make_interval(hours=hours)).when(days.isNotNull(), as_of - F.make_interval(days=days))
    q = queries.select("query_id", F.coalesce("status", F.lit("any")).alias("want"), since.alias("since"))
    q = q.withColumn("ask", F.concat_ws("@", "want", F.unix_micros("since").cast("string")))
    return q.select("query_id", "ask"), q.select("ask", "want", "since").distinct()


def _wanted(rows: DataFrame) -> DataFrame:
    """Each row once for every status that counts it: 'any', its own, and 'open' unless it is closed."""
    wants = F.array_distinct(F.array(F.lit("any"), F.when(F.col("status") != "closed", F.lit("open")).otherwise(F.col("status")), F.col("status")))
    return rows.withColumn("want", F.explode(wants))


def _hour(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / 3600).cast("long")


def _in_buckets(rows: DataFrame) -> DataFrame:
    """Rows with an hour, once for each (level, bucket) that holds it; level -1 has them all, those without an hour too."""
    spots = [F.when(F.col("hour").isNotNull(), F.struct(F.lit(n).alias("level"), F.shiftright("hour", 4 * n).alias("bucket"))) for n in range(_LEVELS)]
    spots = F.filter(F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("bucket")), *spots), lambda x: x.isNotNull())
    return rows.withColumn("__s", F.explode(spots)).withColumns({"level": F.col("__s.level"), "bucket": F.col("__s.bucket")}).drop("__s", "hour")


def _covers(asks: DataFrame) -> DataFrame:
    """(ask, want, level, bucket): the buckets that are wholly newer than the hour of an ask's bound."""
    h = _hour(F.col("since"))
    at = lambda n: lambda x: F.struct(F.lit(n).alias("level"), x.alias("bucket"))
    parts = []
    for n in range(_LEVELS):
        low = F.shiftright(h, 4 * n)
        high = low.bitwiseOR(F.lit(15)) if n < _LEVELS - 1 else low + 15
        parts.append(F.when(h.isNotNull() & (low < high), F.transform(F.sequence(low + 1, high), at(n))).otherwise(F.array().cast("array<struct<level:int,bucket:bigint>>")))
    whole = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("bucket")))
    return asks.withColumn("__s", F.explode(F.when(h.isNull(), whole).otherwise(F.concat(*parts)))).select("ask", "want", F.col("__s.level").alias("level"), F.col("__s.bucket").alias("bucket"))


def _on_the_edge(asks: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the very hour of an ask's bound that aren't before it, by status and hour."""
    edges = asks.filter(F.col("since").isNotNull()).withColumn("hour", _hour(F.col("since")))
    return _wanted(rows).join(edges, ["want", "hour"]).filter(F.col("created_at") >= F.col("since"))


def answer_counts(queries: DataFrame, entities: DataFrame, as_of: Column) -> DataFrame:
    """(query_id, n) of every question; 0 where nothing fits.

    Entities are counted once by status and hour; an ask adds up the buckets that are newer than its bound, some 90 at
    most, and the entities of the bound's own hour. Questions with the same status and bound are answered once.
    """
    named, asks = _asks(queries, as_of)
    rows = entities.filter(live_only()).select("status", "created_at", _hour(F.col("created_at")).alias("hour"))
    counts = _in_buckets(_wanted(rows.groupBy("status", "hour").agg(F.count("*").alias("n")))).groupBy("want", "level", "bucket").agg(F.sum("n").alias("n"))
    whole = _covers(asks).join(counts, ["want", "level", "bucket"]).select("ask", "n")
    edge = _on_the_edge(asks, rows).groupBy("ask").agg(F.count("*").alias("n"))
    total = whole.unionAll(edge).groupBy("ask").agg(F.sum("n").alias("n"))
    return named.join(total, "ask", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def answer_recent(queries: DataFrame, entities: DataFrame, as_of: Column, limit: int = RECENT_LIMIT) -> DataFrame:
    """(query_id, rank, entity_id): each question's newest, those without a time first where there is no bound.

    A bound cuts the order of time at its end, so the newest of each status serve all bounds; at most ``limit`` rows a
    status leave a task.
    """
    named, asks = _asks(queries, as_of, RECENT_DAYS)
    rows = _wanted(entities.filter(live_only()).select("status", "created_at", "entity_id"))
    order = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc_nulls_first("created_at"), "entity_id")
    newest = rows.withColumn("timed", F.col("created_at").isNotNull()).withColumn("__r", F.row_number().over(order("want", "timed"))).filter(F.col("__r") <= limit).drop("__r")
    found = asks.join(newest, "want").filter(F.col("since").isNull() | (F.col("created_at") >= F.col("since")))
    ranked = found.withColumn("rank", F.row_number().over(order("ask"))).filter(F.col("rank") <= limit)
    return named.join(ranked, "ask").select("query_id", "rank", "entity_id")


def answer_ranges(queries: DataFrame, entities: DataFrame, as_of: Column, limit: int = RANGES_LIMIT) -> DataFrame:
    """(query_id, rank, entity_id): each question's highest ranges.

    Of each status and hour the ``limit`` highest are kept, of those the highest of each wider bucket; an ask ranks the
    highest of its buckets and the entities of the bound's own hour.
    """
    named, asks = _asks(queries, as_of)
    rows = entities.filter(live_only() & range_present()).select("status", "created_at", "entity_id", "range_max", "range_min", _hour(F.col("created_at")).alias("hour"))

    def top(frame: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("range_max"), F.desc_nulls_last("range_min"), "entity_id")
        return frame.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)

    held = top(_in_buckets(_wanted(top(rows, "status", "hour").drop("rank"))), "want", "level", "bucket").drop("rank")
    columns = ["ask", "entity_id", "range_max", "range_min"]
    near = _covers(asks).join(held, ["want", "level", "bucket"]).select(*columns).unionAll(top(_on_the_edge(asks, rows), "ask").select(*columns))
    return named.join(top(near, "ask"), "ask").select("query_id", "rank", "entity_id")


def answer_groups(queries: DataFrame, entities: DataFrame, as_of: Column) -> DataFrame:
    """(query_id, label, n): each question's counts by its own key, team by default; the period is not looked at.

    Entities are counted once by status and label of each key that is asked for; questions meet sums only.
    """
    q = queries.select("query_id", F.coalesce("status", F.lit("any")).alias("want"), F.coalesce("group_by", F.lit("team")).alias("key"))
    labels = F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(F.col(c), F.lit(NOT_STATED)).alias("label")) for k, c in GROUP_KEYS.items()))
    rows = entities.filter(live_only()).select("status", F.explode(labels).alias("__l")).groupBy("status", "__l").agg(F.count("*").alias("n"))
    sums = _wanted(rows).groupBy("want", F.col("__l.key").alias("key"), F.col("__l.label").alias("label")).agg(F.sum("n").alias("n"))
    other = ~F.col("key").isin(*GROUP_KEYS)
    return q.withColumn("asked", F.when(other, F.lit("team")).otherwise(F.col("key"))).join(sums.withColumnRenamed("key", "asked"), ["want", "asked"]).withColumn("label", F.when(other, F.lit(NOT_STATED)).otherwise(F.col("label"))).groupBy("query_id", "label").agg(F.sum("n").alias("n"))


def top_groups(groups: DataFrame, limit: int = TOP_GROUPS) -> DataFrame:
    return groups.orderBy(F.desc("n"), "label").limit(limit)


def route_queries(queries: DataFrame, entities: DataFrame, as_of: Column, search=None) -> DataFrame:
    """Dispatch a table of questions by kind; an unknown kind is a search. ``search(queries)`` answers those; without
    it they come back with kind alone."""
    kind = F.coalesce("kind", F.lit("search"))
    q = queries.withColumn("kind", F.when(kind.isin("count", "list_recent", "chart", "salary_chart"), kind).otherwise(F.lit("search")))
    parts = [
        answer_counts(q.filter("kind = 'count'"), entities, as_of).withColumn("kind", F.lit("count")),
        answer_recent(q.filter("kind = 'list_recent'"), entities, as_of).withColumn("kind", F.lit("list_recent")),
        answer_groups(q.filter("kind = 'chart'"), entities, as_of).withColumn("kind", F.lit("chart")),
        answer_ranges(q.filter("kind = 'salary_chart'"), entities, as_of).withColumn("kind", F.lit("salary_chart")),
        search(q.filter("kind = 'search'")) if search else q.filter("kind = 'search'").select("query_id", "kind"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
