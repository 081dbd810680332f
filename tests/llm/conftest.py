import random

import pytest

WORDS = "the of and ing shanre anin ndenon river stone cloud light paper green window market letter garden summer winter question answer morning bridge".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.4 else "") + (". " if r.random() < 0.08 else "") for _ in range(n))


@pytest.fixture(scope="session")
def cases():
    """(doc_id, text, lang, source, n_chars): nulls, empty, very long, repeated and near texts."""
    base = prose(1, 120)
    texts = [base, base, base.replace("river", "rivers", 1), base.upper(), prose(2, 300), "", None, "  \t\n ", "12 34 !!", "one", "one two", "ONE\ttwo", "é ▁ x y 𝒳 日本語 <|endoftext|> \x00z", "x" * 5000, prose(3, 9000), "mail a.b@ex.com, b@c ip 10.0.0.1 999.1.1.1 card 4539 1488 0343 6467 call +1 (212) 555-0100."]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, "nobody's text", None, None, 13)]


DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, cases):
    return spark.createDataFrame(cases, DDL).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with further columns that are named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["id", "key", "n", "score", "lang_pred", "base", "masked", "k", "h1", "sigs0", "n_tokens", "tail", "text_sha256", "component", "rank", "share", "domain"]
    return docs.select("*", *(F.lit("x").alias(n) for n in names))
