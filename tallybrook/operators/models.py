"""Model roles as batched, pluggable columns, with deterministic defaults that need no network.

A role is any function DataFrame -> DataFrame (for instance ``frame.mapInPandas`` with one client a partition).  On
failure each falls back as stated, so one bad row never fails a job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybrook.sources import schemas

Scorer = Callable[[DataFrame], DataFrame]

@dataclass(frozen=True)
class Words:
    """The words of the default rules, as regular expressions over lower-case text: what is about a position at all, what opens,
    closes and changes one, and what stands before its name, its team and its bounds. The defaults are English and Russian."""

    about: str = r"vacanc|position|salary|hiring|candidate|senior|junior|ваканси|позици|зарплат|кандидат"
    create: str = r"looking for|opened|we need|ищем|открыли|нужен"
    close: str = r"closed|filled|found someone|закрыли|нашли"
    update: str = r"raised|lowered|changed|подняли|опустили|изменили"
    name: str = r"vacancy|position|for|вакансию|позицию|ищем|по"
    team: str = r"team|команду"
    high: str = r"up to|до"
    low: str = r"from|от"
    kilo: str = r"k|к|тыс"


WORDS = Words()


def embed_text(rows: DataFrame, *, id_col: str = "message_id", text_col: str = "text", size: int = 64) -> DataFrame:
    """(id, embedding): hashed word counts of unit norm; a text without words gives zeros."""
    stages = [RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="__words", outputCol="__counts", numFeatures=size), Normalizer(inputCol="__counts", outputCol="__unit")]
    ready = rows.select(id_col, F.coalesce(text_col, F.lit("")).alias("__text"))
    out = Pipeline(stages=stages).fit(ready).transform(ready)
    return out.select(id_col, vector_to_array("__unit", "float32").alias("embedding"))


def train_classifier(labelled: DataFrame, *, text_col: str = "text", label_col: str = "label", features: int = 1 << 14, max_iter: int = 20) -> PipelineModel:
    """Relevance classifier: hashed words and logistic regression."""
    stages = [RegexTokenizer(inputCol=text_col, outputCol="words", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="words", outputCol="features", numFeatures=features), LogisticRegression(featuresCol="features", labelCol=label_col, maxIter=max_iter, regParam=0.01)]
    return Pipeline(stages=stages).fit(labelled.select(text_col, F.col(label_col).cast("double").alias(label_col)).filter(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()))


def model_scorer(model: PipelineModel, text_col: str = "text") -> Scorer:
    """Rows with ``score``: the chance of the positive class."""

    def score(rows: DataFrame) -> DataFrame:
        out = model.transform(rows.withColumn(text_col, F.coalesce(text_col, F.lit(""))))
        return out.withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")

    return score


def keyword_scorer(rows: DataFrame, words: Words = WORDS) -> DataFrame:
    """Rows with ``score``: 1 where one of the words that are about positions occurs."""
    return rows.withColumn("score", F.when(F.coalesce(F.lower("text").rlike(words.about), F.lit(False)), 1.0).otherwise(0.0))


def classify_messages(messages: DataFrame, scorer: Scorer = keyword_scorer, *, threshold: float = 0.5, context: str = "prefilter_context") -> DataFrame:
    """Adds ``relevant`` and ``by`` ('text' or 'context'): the text alone first; only what that rejects, and has context,
    is scored again with the context before it. ``context`` is an array of structs with text."""
    alone = scorer(messages).withColumn("relevant", F.col("score") >= threshold).drop("score")
    sure = alone.filter("relevant").withColumn("by", F.lit("text"))
    other = alone.filter("not relevant")
    before = F.array_join(F.transform(context, lambda m: m["text"]), "\n")
    again = scorer(other.filter(F.size(context) > 0).withColumnRenamed("text", "__own").withColumn("text", F.concat_ws("\n", before, "__own")))
    again = again.withColumn("relevant", F.col("score") >= threshold).withColumn("by", F.lit("context")).drop("score", "text").withColumnRenamed("__own", "text")
    rest = other.filter(F.coalesce(F.size(context), F.lit(0)) <= 0).withColumn("by", F.lit("text"))
    return sure.unionByName(again).unionByName(rest)


def _amount(text: Column, before: str, kilo: str) -> Column:
    pattern = rf"(?:{before})\s*(\d{{1,7}})\s*({kilo})?"
    number = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")
    return F.when((F.regexp_extract(text, pattern, 2) != "") | (number < 1000), number * 1000).otherwise(number)


def extract_fields(messages: DataFrame, model: Scorer | None = None, *, words: Words = WORDS) -> DataFrame:
    """Adds action, entity_ref, fields (map) and confidence, by rules unless ``model`` is given (it must return those
    columns). A field that isn't mentioned isn't in the map."""
    if model is not None:
        out = model(messages)
        action = F.when(F.col("action").isin(*schemas.EXTRACTED_ACTIONS), F.col("action")).otherwise("none")
        return out.withColumn("action", action).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    own = F.coalesce("text", F.lit(""))
    low = F.lower(own)
    high, least = _amount(low, words.high, words.kilo), _amount(low, words.low, words.kilo)
    action = F.when(low.rlike(words.close), "close").when(low.rlike(words.update), "update").when(low.rlike(words.create), "create").when(high.isNotNull() | least.isNotNull(), "update").otherwise("none")
    title = F.regexp_extract(low, rf"(?:{words.name})\s+([\p{{L}}\p{{N}}+#-]+)", 1)
    team = F.regexp_extract(own, rf"(?:{words.team})\s+([\p{{L}}\p{{N}}-]+)", 1)
    pairs = F.array(*(F.when(there, F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, there, v in (("title", title != "", title), ("salary_min", least.isNotNull(), least.cast("string")), ("salary_max", high.isNotNull(), high.cast("string")), ("team", team != "", team))))
    fields = F.map_from_entries(F.filter(pairs, lambda x: x.isNotNull()))
    return messages.withColumn("action", action).withColumn("entity_ref", title).withColumn("fields", fields).withColumn("confidence", F.when(action == "none", 0.0).otherwise(0.7))


def classify_queries(queries: DataFrame, model: Scorer | None = None) -> DataFrame:
    """Queries (query_id, text) with kind, status, days, hours, group_by, checked: days in 1..365, hours in 1..720;
    what is out of range or can't be read makes the kind 'search' with nothing else."""
    if model is not None:
        rows = model(queries)
    else:
        low = F.lower(F.coalesce("text", F.lit("")))
        number = lambda words: F.nullif(F.regexp_extract(low, rf"(\d{{1,4}})\s*(?:{words})", 1), F.lit("")).try_cast("int")
        kind = F.when(low.rlike("график|диаграмм|chart") & low.rlike("зарплат|вилк|salary"), "salary_chart").when(low.rlike("график|диаграмм|chart|по командам|per team"), "chart").when(low.rlike("сколько|how many|count"), "count").when(low.rlike("покажи|список|последни|list|recent"), "list_recent").otherwise("search")
        status = F.when(low.rlike("закрыт|closed"), "closed").when(low.rlike("открыт|open"), "open").otherwise("any")
        group = F.when(low.rlike("статус|status"), "status").when(low.rlike("владел|owner"), "owner").when(low.rlike("команд|team"), "team")
        rows = queries.withColumn("kind", kind).withColumn("status", status).withColumn("days", number("дн|день|day")).withColumn("hours", number("час|hour")).withColumn("group_by", group)
    fine = F.coalesce(F.col("kind").isin(*schemas.INTENTS), F.lit(False)) & F.coalesce(F.col("days").between(1, 365), F.lit(True)) & F.coalesce(F.col("hours").between(1, 720), F.lit(True))
    rows = rows.withColumn("__fine", fine)
    for c in ("status", "days", "hours", "group_by"):
        rows = rows.withColumn(c, F.when(F.col("__fine"), F.col(c)))
    return rows.withColumn("kind", F.when(F.col("__fine"), F.col("kind")).otherwise("search")).drop("__fine")


def thread_summary(messages: DataFrame, changed: DataFrame, cached: DataFrame, *, lines: int = 5) -> DataFrame:
    """(thread_id, n_messages, summary): made anew for changed threads (thread_id), kept for the others. The default
    summary is the first sentence of each of the last messages."""
    live = messages.filter(~F.col("is_deleted") & F.col("thread_id").isNotNull()).join(changed.select("thread_id").distinct(), "thread_id", "left_semi")
    first = F.trim(F.regexp_extract("text", r"^([^.!?\n]*[.!?]?)", 1))
    rank = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("created_at"), F.desc("message_id")))
    rows = live.withColumn("rank", rank)
    new = rows.groupBy("thread_id").agg(F.count("*").alias("n_messages"), F.array_sort(F.collect_list(F.when(F.col("rank") <= lines, F.struct((-F.col("rank")).alias("o"), first.alias("line"))))).alias("p"))
    new = new.select("thread_id", "n_messages", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("summary"))
    return cached.join(changed.select("thread_id").distinct(), "thread_id", "left_anti").unionByName(new)


def lags(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """(message_id, lag): seconds from message to vector, null for a message that has none."""
    rows = messages.select("message_id", "received_at").join(vectors.select("message_id", "embedded_at"), "message_id", "left")
    return rows.select("message_id", (F.unix_timestamp("embedded_at") - F.unix_timestamp("received_at")).alias("lag"))


def lag_summary(rows: DataFrame) -> DataFrame:
    """How many messages there are, how many wait for their vector, and median and 95th percentile of the seconds."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("lag").isNull()).alias("waiting"), F.percentile_approx("lag", 0.5).alias("p50"), F.percentile_approx("lag", 0.95).alias("p95"))


def stage_lag(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Messages without a vector yet, and median and 95th percentile of the seconds from message to vector."""
    return lag_summary(lags(messages, vectors))
