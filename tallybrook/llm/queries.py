"""The registered query of each operator; each applies it to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm import bit_sliced, collocations, jaccard_join, language_id, licences, mixing, multi_index, neighbour_votes, periodic_runs, piece_sampling, pii, suffix_tree, token_counts
from tallybrook.llm.text import fold


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_documents(spark, sf_dir).select("doc_id", "text"), licences.known_digests(spark))


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every text, decoded again: counts, digests and whether the round trip lost nothing."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return piece_sampling.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), seed=17)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email to n_phone and base_sha256 are of the base spans; spans holds the CRF's too; n_added counts those."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = pii.find_pii(docs, pii.learn(docs))
    kinds = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    order = F.create_map(*[x for i, k in enumerate(pii.KINDS) for x in (F.lit(k), F.lit(i))])
    both = F.filter(F.concat(F.split("base", ","), F.split("added", ",")), lambda x: x != "")
    keyed = F.transform(both, lambda x: F.struct(order[F.split(x, ":")[0]].alias("k"), F.split(x, ":")[1].cast("long").alias("a"), F.split(x, ":")[2].cast("long").alias("b"), x.alias("s")))
    spans = F.when(F.col("added") == "", F.col("base")).otherwise(F.array_join(F.transform(F.array_sort(keyed), lambda x: x["s"]), ","))
    return found.select("doc_id", *kinds, F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), F.size(F.filter(F.split("added", ","), lambda x: x != "")).cast("long").alias("n_added"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    profiles = language_id.learn(docs.filter(~fold("doc_id", 5, 0)))
    found = language_id.identify(docs, profiles)
    return found.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "margin")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(_documents(spark, sf_dir).select("doc_id", "text"), percent=90, width=3)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    tree, counts = suffix_tree.grow(docs.filter(~fold("doc_id", 7, 2)))
    found = suffix_tree.score(docs, tree, counts, spend=True)
    return found.withColumn("held_out", fold("doc_id", 7, 2)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.neighbours(_embeddings(spark, sf_dir), k=20, every=20)


def domain(source: Column) -> Column:
    """Sources fall into four domains by their number; one without a number is a domain of its own."""
    number = F.try_to_number(F.regexp_extract(source, "[0-9]+$", 0), F.lit("999999999999"))
    return F.when(number.isNotNull(), F.concat(F.lit("d"), (number % 4).cast("int").cast("string")))


#: Target weights of the mixture by level; what isn't named has weight 1.
MIX_WEIGHTS = {"domain": {"d0": 2.0, "d1": 4.0, "d2": 3.0, "d3": 1.0}, "language": {"en": 3.0, "de": 2.0, "fr": 2.0, "es": 3.0}}


def mixed(docs: DataFrame, **more) -> DataFrame:
    """The mixture's decisions by row, with the tree's values as domain, language and origin."""
    levels = {"domain": domain(docs["source"]), "language": docs["lang"], "origin": docs["source"]}
    return mixing.mix(docs, levels, weights=MIX_WEIGHTS, budget_share=0.6, seed=29, **more)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_documents(spark, sf_dir), max_epochs=4)


def op10_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(_embeddings(spark, sf_dir), k=5, every=50)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    found = neighbour_votes.score(docs, neighbour_votes.learn(docs, labels.filter(~fold("doc_id", 5, 0))))
    return found.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir).select("doc_id", "text", "lang"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, chosen by the id's crc32, continue from some word on with a period of their own
    words; the others, those of null ids too, are left alone."""
    white = r"[\x20\x09-\x0D]+"
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.filter(F.split("text", white), lambda x: x != "")).alias("w"))
    spot = chosen.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    spot = spot.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    again = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), int((n - a + p - 1) div p))), 1, n - a))")
    return spot.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the planted texts: how many runs, the longest one, and digests of all runs and of the text without repeats."""
    found = periodic_runs.find_runs(planted(_documents(spark, sf_dir)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    top = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    parts = [(-F.col("b.s")).alias("start"), F.col("b.l").alias("length"), (-F.col("b.p")).alias("period"), F.floor(1000 * F.col("b.l") / -F.col("b.p")).alias("exponent_milli")]
    return top.select("doc_id", "n_runs", *parts, "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_licences, op2_piece_sampling, op3_pii, op4_language_id, op5_jaccard_join, op6_lm_scores, op7_token_counts, op8_nearest, op9_mixing, op10_bit_sliced, op11_quality, op12_collocations, op13_periodic_runs)}


_JACCARD_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS v FROM documents),
    g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(v) >= 3 THEN list_transform(range(1, len(v) - 1), lambda i: v[i] || ' ' || v[i + 1] || ' ' || v[i + 2]) WHEN len(v) > 0 THEN ['<' || array_to_string(v, ' ') || '>'] ELSE [] END) AS s FROM w),
    n AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY 1),
    l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g AS x JOIN g AS y USING (s) WHERE x.doc_id < y.doc_id GROUP BY 1, 2) JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT doc_id, n AS n_shingles, min(b) AS component_id FROM n JOIN r ON a = doc_id GROUP BY 1, 2
"""

_TOP_SQL = """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT a.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) DESC, b.vec_id) AS INTEGER) AS rank, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
    FROM e AS a JOIN e AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 5
"""


_PHRASES_SQL = r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
    v AS (SELECT lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') AS v FROM p),
    k AS (SELECT unnest(range(1, 5)) AS k),
    o AS (SELECT lang, k, unnest(list_transform(range(1, len(v) - k + 2), lambda i: array_to_string(v[i:i + k - 1], ' '))) AS phrase FROM v, k WHERE len(v) >= k),
    c AS (SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY ALL),
    n AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY 1),
    a AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k >= 2 AND f >= 30),
    s AS (SELECT a.lang, a.phrase, a.a, unnest(range(1, k)) AS cut, w FROM a),
    x AS (SELECT s.lang, s.phrase, s.a, s.cut, l.f AS l, r.f AS r, CAST(CAST(s.a AS HUGEINT) * 2000000 // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score FROM s JOIN c AS l ON l.lang = s.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN c AS r ON r.lang = s.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
    b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    i AS (SELECT DISTINCT a.lang, array_to_string(w[z.s:z.s + z.m - 1], ' ') AS phrase, a.a FROM a, (SELECT unnest(range(1, 4)) AS s) AS y(q), LATERAL (SELECT q AS s, m FROM (SELECT unnest(range(2, 4)) AS m)) AS z WHERE z.m < a.k AND z.s + z.m - 1 <= a.k),
    f AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase AND CAST(i.a AS HUGEINT) * 100 >= CAST(b.a AS HUGEINT) * 80))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM f JOIN n USING (lang) QUALIFY rank <= 2000
"""

#: crc32 a bit at a time, over the id's digits each followed by eight shifts.
_RUNS_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS v, CAST(doc_id AS VARCHAR) AS t FROM documents),
    h AS (SELECT k, doc_id, v, len(v) AS n, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], flatten(list_transform(range(1, len(t) + 1), lambda i: [CAST(ascii(t[i]) AS UBIGINT), 256, 256, 256, 256, 256, 256, 256, 256]))),
        lambda c, x: CASE WHEN x < 256 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), CAST(4294967295 AS UBIGINT)) AS h FROM d),
    s AS (SELECT *, CAST(h // 10 AS BIGINT) AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN CAST(h // 10 AS BIGINT) % n END AS a FROM h),
    p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM s),
    w AS (SELECT k, n, i, CASE WHEN i >= a THEN v[a + (i - a) % p + 1] ELSE v[i + 1] END AS w FROM (SELECT *, unnest(range(0, n)) AS i FROM p)),
    q AS (SELECT x.k, x.i, x.i - y.i AS q FROM w AS x JOIN w AS y ON x.k = y.k AND x.w = y.w AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
    m AS (SELECT k, q, min(i) - q AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS o FROM q) GROUP BY k, q, o HAVING count(*) + q >= greatest(6, 4 * q)),
    r AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m AS z WHERE z.k = m.k AND z.q < m.q AND z.s <= m.s AND z.s + z.l >= m.s + m.l)),
    o AS (SELECT k, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t, min({'l': -l, 's': s, 'q': q}) AS b FROM r GROUP BY k),
    c AS (SELECT w.k, string_agg(w.w, ' ' ORDER BY w.i) AS t FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = w.k AND w.i >= r.s + r.q AND w.i < r.s + r.l) GROUP BY w.k)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(-b.l AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period, CAST(1000 * -b.l // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(o.t, '')) AS runs_sha256, sha256(coalesce(c.t, '')) AS collapsed_sha256
    FROM d LEFT JOIN o USING (k) LEFT JOIN c USING (k)
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express on whole tables; the others are tested against brute force."""
    number = "TRY_CAST(nullif(regexp_extract(source, '[0-9]+$'), '') AS BIGINT)"
    levels = {"domain": f"'d' || ({number} % 4)", "language": "lang", "origin": "source"}
    return {"op1_licences": licences.scan_sql(), "op5_jaccard_join": _JACCARD_SQL, "op10_bit_sliced": _TOP_SQL, "op12_collocations": _PHRASES_SQL, "op13_periodic_runs": _RUNS_SQL, "op9_mixing": mixing.mix_sql(levels, weights=MIX_WEIGHTS, budget_share=0.6, max_epochs=4, seed=29)}
