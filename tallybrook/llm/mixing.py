"""Mix sources to target weights: hierarchical budgeting over a tree, then a token prefix of seeded epochs per leaf.

A token budget goes down a tree of levels (domain, language, source).  Below each node the
budget is split by weight; a child can take no more than its whole subtree can supply
(tokens times ``max_epochs``), and what it can't take goes to its siblings in proportion to
their weights.  As a node is never given more than its subtree holds, a shortage is always
made good among siblings first and reaches an ancestor's other children only when the
whole subtree is short.  The split is the closed form of that redistribution (water
filling), with windows over the children of each node.

A leaf's budget is a number of whole epochs and a rest.  The rest is the longest prefix of
the next epoch's order, by md5 of (seed, epoch, id), that fits.  The prefix is found in two
steps, so no leaf is sorted in one place: token sums of 4,096 ranges of the order, then the
documents of the one range where it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybrook.llm.text import stored

_NONE = "(none)"
_DIGITS = 3
#: A plan of at most this many leaves (some 200 bytes each) is broadcast; a larger one is joined by a shuffle.
_BROADCAST_LEAVES = 50_000


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _split(children: DataFrame, parents: DataFrame | None, budget: Column | None, over: list[str], key: str) -> DataFrame:
    """Give each child (columns over + key, cap, weight) its share of its parent's budget."""
    rows = children.withColumn("given", budget) if parents is None else children.join(parents.select(*over, F.col("share").alias("given")), over)
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    rows = rows.withColumn("ratio", ratio).withColumn("can", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0.0))
    order = Window.partitionBy(*over, F.lit(0)).orderBy("ratio", key)
    before = F.coalesce(F.sum("can").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("full", (F.col("weight") > 0) & (F.col("ratio") * onward + before <= F.col("given")))
    node = Window.partitionBy(*over, F.lit(0))
    held = F.sum(F.when(F.col("full"), F.col("can")).otherwise(0.0)).over(node)
    wanting = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(node)
    share = F.when(F.col("full"), F.col("can")).when(wanting > 0, F.least("can", F.greatest(F.lit(0.0), F.col("given") - held) * F.col("weight") / wanting)).otherwise(0.0)
    return rows.withColumn("share", share)


def _weights(level: str, weights: dict[str, dict[str, float]]) -> Column:
    """A value's weight at its level; 1 where none is stated."""
    stated = weights.get(level) or {}
    if not stated:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in stated.items() for x in (kv[0], float(kv[1]))])[F.col(level)], F.lit(1.0))


def _key(seed: int, epoch: Column, id_col: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col(id_col).cast("string")))


def plan(slim: DataFrame, levels: list[str], *, id_col: str, weights: dict[str, dict[str, float]], budget_share: float, max_epochs: int, seed: int) -> DataFrame:
    """Per leaf: tokens, share (budget), epochs (whole ones), cut and last: of the next epoch, keys of ranges below
    ``cut`` and, in range ``cut``, keys up to ``last`` are in."""
    leaves = slim.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    given = None
    for depth, level in enumerate(levels):
        nodes = leaves.groupBy(*levels[: depth + 1]).agg((F.sum("tokens") * max_epochs).cast("double").alias("cap")).withColumn("weight", _weights(level, weights))
        # the root's budget is a share of all tokens, and no more than all leaves can supply
        root = (F.sum("cap").over(Window.partitionBy(F.lit(0))) / max_epochs * min(budget_share, max_epochs)) if depth == 0 else None
        given = _split(nodes, given, root, levels[:depth], level)
    whole = leaves.join(given.select(*levels, "share"), levels).withColumn("share", F.floor(F.col("share") + 1e-6).cast("long"))
    whole = whole.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(0)).withColumn("rest", F.col("share") - F.col("epochs") * F.col("tokens"))
    whole = stored(whole, "leaves")
    keyed = slim.filter("n_tokens > 0").join(whole.select(*levels, "epochs", "rest"), levels).withColumn("key", _key(seed, F.col("epochs"), id_col)).withColumn("range", F.substring("key", 1, _DIGITS))
    sums = keyed.groupBy(*levels, "range").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = sums.withColumn("upto", F.sum("tokens").over(Window.partitionBy(*levels).orderBy("range")))
    cut = upto.filter("upto > rest").groupBy(*levels).agg(F.min("range").alias("cut"), F.min(F.col("upto") - F.col("tokens")).alias("before"))
    edge = keyed.join(cut, levels).filter("range = cut")
    edge = edge.withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*levels).orderBy("key"))).filter("upto <= rest")
    last = edge.groupBy(*levels).agg(F.max("key").alias("last"))
    return stored(whole.join(cut.drop("before"), levels, "left").join(last, levels, "left").select(*levels, "tokens", "share", "epochs", "cut", F.coalesce("last", F.lit("")).alias("last")), "plan")


def mix(docs: DataFrame, levels: dict[str, Column], *, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, dict[str, float]] | None = None, budget_share: float = 0.5, max_epochs: int = 4, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """Per row: id, the level columns, ``keep``, n_tokens (words), n_copies: how often the mixture takes the row.

    ``levels`` names the tree's levels from the root, each with its expression over docs; a null is the value
    '(none)'. ``weights`` states weights by level and value (1 by default, 0 takes nothing). A null or blank text has
    no tokens and 0 copies. Rows that share an id are taken together; a null id is a key like any other. An empty
    table gives no rows.
    """
    names = list(levels)
    base = docs.select(docs[id_col], *(F.coalesce(c.cast("string"), F.lit(_NONE)).alias(f"__{n}") for n, c in levels.items()), *(docs[c].alias(f"__keep_{c}") for c in keep or [] if c != id_col), word_count(docs[text_col]).alias("n_tokens"))
    flat = [f"__{n}" for n in names]
    slim = stored(base.select(id_col, *flat, "n_tokens"), "slim")
    leaves = plan(slim, flat, id_col=id_col, weights={f"__{k}": v for k, v in (weights or {}).items()}, budget_share=budget_share, max_epochs=max_epochs, seed=seed)
    small = leaves.drop("tokens", "share")
    if leaves.count() <= _BROADCAST_LEAVES:
        small = F.broadcast(small)
    rows = (base if keep else slim).join(small, flat)
    key = _key(seed, F.col("epochs"), id_col)
    head = F.substring(key, 1, _DIGITS)
    part = F.when(F.col("cut").isNull() | (head < F.col("cut")) | ((head == F.col("cut")) & (key <= F.col("last"))), 1).otherwise(0)
    # without a cut the whole rest fits, which only a leaf without tokens has
    copies = F.when(F.col("n_tokens") > 0, F.col("epochs") + part).otherwise(0).cast("long")
    return rows.select(id_col, *(F.col(f).alias(n) for f, n in zip(flat, names, strict=True)), *(F.col(f"__keep_{c}").alias(c) for c in keep or [] if c != id_col), "n_tokens", copies.alias("n_copies"))


def mix_sql(levels: dict[str, str], *, weights: dict[str, dict[str, float]], budget_share: float, max_epochs: int, seed: int) -> str:
    """DuckDB SQL of ``mix`` over ``documents``; ``levels`` gives each level's expression in SQL."""
    names = list(levels)
    parts = [
        f"t AS (SELECT doc_id, {', '.join(f'coalesce(CAST({e} AS VARCHAR), {chr(39)}{_NONE}{chr(39)}) AS {n}' for n, e in levels.items())}, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM documents)",
        f"leaves AS (SELECT {', '.join(names)}, sum(n_tokens) AS tokens FROM t GROUP BY ALL)",
    ]
    for depth, name in enumerate(names):
        path, over = ", ".join(names[: depth + 1]), ", ".join(names[:depth]) or "1"
        stated = weights.get(name) or {}
        weight = f"coalesce(CASE {name} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {float(v)}' for k, v in stated.items())} END, 1.0)" if stated else "1.0"
        given = f"sum(cap) OVER () / {max_epochs} * {min(budget_share, max_epochs)}" if depth == 0 else "share"
        source = f"c{depth}" if depth == 0 else f"c{depth} JOIN (SELECT {', '.join(names[:depth])}, share FROM s{depth - 1}) USING ({', '.join(names[:depth])})"
        rest, held = f"sum(CASE WHEN whole THEN 0 ELSE weight END) OVER (PARTITION BY {over})", f"sum(CASE WHEN whole THEN can ELSE 0 END) OVER (PARTITION BY {over})"
        order = f"PARTITION BY {over} ORDER BY ratio, {name}"
        parts += [
            f"c{depth} AS (SELECT {path}, CAST(sum(tokens) * {max_epochs} AS DOUBLE) AS cap, CAST({weight} AS DOUBLE) AS weight FROM leaves GROUP BY {path})",
            f"g{depth} AS (SELECT {path}, cap, weight, {given} AS given, CASE WHEN weight > 0 THEN cap / weight ELSE CAST('infinity' AS DOUBLE) END AS ratio, CASE WHEN weight > 0 THEN cap ELSE 0.0 END AS can FROM {source})",
            f"f{depth} AS (SELECT *, weight > 0 AND ratio * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + coalesce(sum(can) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= given AS whole FROM g{depth})",
            f"s{depth} AS (SELECT {path}, CASE WHEN whole THEN can WHEN {rest} > 0 THEN least(can, greatest(0.0, given - {held}) * weight / {rest}) ELSE 0.0 END AS share FROM f{depth})",
        ]
    path = ", ".join(names)
    parts += [
        f"b AS (SELECT {path}, tokens, CAST(floor(share + 1e-6) AS BIGINT) AS share FROM leaves JOIN s{len(names) - 1} USING ({path}))",
        f"e AS (SELECT {path}, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN share % tokens ELSE share END AS rest FROM b)",
        f"k AS (SELECT t.*, epochs, rest, md5(concat_ws(':', '{seed}', CAST(epochs AS VARCHAR), CAST(doc_id AS VARCHAR))) AS key FROM t JOIN e USING ({path}))",
    ]
    taken = f"sum(n_tokens) OVER (PARTITION BY {path} ORDER BY key) <= rest"
    return f"WITH {', '.join(parts)} SELECT doc_id, {path}, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(CASE WHEN n_tokens > 0 THEN epochs + CASE WHEN {taken} THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS n_copies FROM k"
