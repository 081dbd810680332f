"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a
DataFrame; every stage but the last returns the columns of documents.  ``run`` writes each
stage's rows as Parquet to the shared folder and reads them back for the next.

1. language_id: documents whose language can't be told go: no letters, or too far from
   every profile.
2. jaccard_join: of each group of linked documents the one of smallest id stays.
3. pii: personal data is replaced by its kind in brackets, and n_chars follows.
4. mixing: documents are taken once, twice or not at all, by target weights.
5. sentencepiece: sampled pieces of each document, as counts and digests, and the proof
   that decoding gives the text back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm import jaccard_join, language_id, piece_sampling, pii
from tallybrook.llm.queries import mixed
from tallybrook.llm.text import fold, release, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents nearer to no profile than this share of the largest distance are rejected.
LEAST_SCORE = 0.2
#: Near copies are linked by word shingles of this width with at least this Jaccard similarity, in per cent.
NEAR_PERCENT, NEAR_WIDTH = 80, 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language; profiles are learnt from the labelled part of the same input."""
    profiles = language_id.learn(docs.filter(~fold("doc_id", 5, 0)))
    found = language_id.identify(docs, profiles, keep=COLUMNS)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group; repeated rows of one id are one document, null ids stay."""
    found = stored(jaccard_join.similar(docs, percent=NEAR_PERCENT, width=NEAR_WIDTH), "groups")
    release(spark)
    gone = found.filter("doc_id != component_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        kept = kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.filter("doc_id is null"))
    return kept.select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every span, the base's and the CRF's, in place."""
    found = pii.find_pii(docs, pii.learn(docs), mask=True, keep=["lang", "source", "n_chars"])
    length = F.when(F.col("masked").isNotNull() & ((F.col("base") != "") | (F.col("added") != "")), F.length("masked").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source", length.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mixture says, twice at most."""
    taken = mixed(docs, max_epochs=2, keep=["text", "lang", "source", "n_chars"]).filter("n_copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int")))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces_sha256, text_sha256, lossless."""
    return piece_sampling.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), seed=17)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: No stage but the mixture can be put in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
