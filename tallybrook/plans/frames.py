"""Frames of entities, messages, changes, revisions, vectors and questions derived from the star-schema tables.

Each has a DataFrame form and, in ``SQL``, the same derivation as a common table expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def entities(spark: SparkSession, folder: str, *, vectors: bool = False) -> DataFrame:
    orders, customer, lines = (read(spark, folder, t) for t in ("orders", "customer", "lineitem"))
    bounds = lines.groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("range_min"), F.max("l_extendedprice").alias("range_max"))
    rows = orders.join(customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left").join(bounds, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("on_hold")
    out = rows.select(
        F.col("o_orderkey").alias("entity_id"), F.concat(F.lit("Entity "), F.col("o_orderkey").cast("string")).alias("title"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(F.col("o_custkey") % 11 != 0, F.col("o_orderpriority")).alias("team"), F.col("c_name").alias("owner_name"), "range_min", "range_max",
        F.when(F.col("o_custkey") % 3 == 0, "RUB").when(F.col("o_custkey") % 3 == 1, "USD").alias("currency"), (F.col("o_orderkey") % 17 == 0).alias("is_deleted"),
    )
    if vectors:
        v = read(spark, folder, "embeddings")
        many = v.agg(F.count("*").alias("n"))
        out = out.join(many).withColumn("vec_id", F.col("entity_id") % F.col("n")).join(v.select("vec_id", "embedding"), "vec_id").drop("vec_id", "n")
    return out


def messages(spark: SparkSession, folder: str) -> DataFrame:
    c = read(spark, folder, "conversations")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("conv_id").cast("int"), mins=F.col("turn").cast("int"))
    return c.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"), F.col("conv_id").alias("thread_id"), (F.col("conv_id") % 10).alias("space_id"), "turn",
        F.col("role").alias("author_name"), "text", at.alias("created_at"), (F.col("turn") % 5 == 4).alias("is_deleted"),
    )


def _key():
    return F.concat_ws("/", F.col("user_id").cast("string"), (F.col("event_id") % 20).cast("string"))


def changes(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    kind = F.when(F.col("event_type").isin("signup", "view"), "created").when(F.col("event_type") == "error", "deleted").otherwise("updated")
    return e.select(_key().alias("message_id"), F.col("event_id").alias("seq"), kind.alias("change"), F.col("props").alias("text"))


def revisions(spark: SparkSession, folder: str) -> DataFrame:
    r = read(spark, folder, "lineitem")
    return r.select(F.col("l_orderkey").alias("entity_id"), F.col("l_partkey").alias("source_message_id"), F.col("l_returnflag").alias("action"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("timestamp").alias("created_at"))


def sources(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select(F.col("p_partkey").alias("message_id"), (F.col("p_size") <= 25).alias("is_deleted"))


def updates(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "events")
    g = F.floor(F.col("event_id") / 20)
    amount = F.when(g % 6 != 0, F.col("value").cast("string"))
    fields = F.when(g % 2 == 1, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.create_map(F.lit("amount"), amount))
    action = F.when(F.col("event_type") == "error", "close").otherwise("update")
    return e.select(_key().alias("key"), F.col("event_id").alias("seq"), action.alias("action"), fields.alias("fields"))


def questions(spark: SparkSession) -> DataFrame:
    """Thirty stated questions."""
    return spark.createDataFrame(QUESTIONS, "query_id int, kind string, status string, days int, hours int, group_by string")


KINDS = ("count", "list_recent", "chart", "salary_chart", "search")
QUESTIONS = [
    (i, KINDS[i % 5], ("open", "closed", "any", None)[i % 4], (None, 30, 365, 0, 7)[i % 5 if i % 2 else (i // 5) % 5], (None, None, 240, None, 0, 48)[(i // 3) % 6], ("team", "status", "owner", None)[(i // 2) % 4]) for i in range(30)
]


def _sql_questions() -> str:
    show = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(show, q)) + ")" for q in QUESTIONS)


SQL = {
    "E": """E AS (SELECT o_orderkey AS entity_id, 'Entity ' || o_orderkey AS title, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'on_hold' END AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at,
        CASE WHEN o_custkey % 11 <> 0 THEN o_orderpriority END AS team, c_name AS owner_name, lo AS range_min, hi AS range_max, CASE o_custkey % 3 WHEN 0 THEN 'RUB' WHEN 1 THEN 'USD' END AS currency, o_orderkey % 17 = 0 AS is_deleted
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1) AS b ON l_orderkey = o_orderkey)""",
    "EV": "EV AS (SELECT E.*, CAST(embedding AS DOUBLE[]) AS embedding FROM E JOIN embeddings ON entity_id % (SELECT count(*) FROM embeddings) = vec_id)",
    "M": """M AS (SELECT conv_id || '/' || turn AS message_id, conv_id AS thread_id, conv_id % 10 AS space_id, turn, role AS author_name, text,
        TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS BIGINT)) + to_minutes(CAST(turn AS BIGINT)) AS created_at, turn % 5 = 4 AS is_deleted FROM conversations)""",
    "C": """C AS (SELECT user_id || '/' || (event_id % 20) AS message_id, event_id AS seq, CASE WHEN event_type IN ('signup', 'view') THEN 'created' WHEN event_type = 'error' THEN 'deleted' ELSE 'updated' END AS change, props AS text FROM events)""",
    "R": "R AS (SELECT l_orderkey AS entity_id, l_partkey AS source_message_id, l_returnflag AS action, l_linenumber AS line, l_shipdate AS created_at FROM lineitem)",
    "S": "S AS (SELECT p_partkey AS message_id, p_size <= 25 AS is_deleted FROM part)",
    "U": """U AS (SELECT user_id || '/' || (event_id % 20) AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'close' ELSE 'update' END AS action, (event_id // 20) % 2 = 0 AS has,
        CASE WHEN (event_id // 20) % 6 <> 0 THEN CAST(value AS VARCHAR) END AS amount FROM events),
        G AS (SELECT *, CAST(coalesce(sum(CASE WHEN action = 'close' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS generation FROM U)""",
    "V": "V AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
    "Q": f"Q(query_id, kind, status, days, hours, group_by) AS (VALUES {_sql_questions()})",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
