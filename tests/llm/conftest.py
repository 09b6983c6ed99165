"""Small tables with every awkward case."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=False):
        """documents from (doc_id, text); with extra, columns whose names clash with those that operators add."""
        df = spark.createDataFrame([(i, t, "en", "web", len(t) if t is not None else None) for i, t in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit("mine").alias(c) for c in ("TOKENS", "n_tokens", "toxicity", "Is_Toxic", "surrogate_text", "class", "block", "odd name.with dot", "n_entities", "prefix_counts", "item_id")])
        return df

    return make


def words(seed, n):
    """n made-up words."""
    import random

    r = random.Random(seed)
    return ["".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def made_words():
    return words
