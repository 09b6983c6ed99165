"""The stages one after another, and the registered queries on a small table."""

import __spark_entry__ as entry
import corpus_pipeline as P
import pytest

from millrace.llm import decontamination, queries


def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "bpe"]
    sizes, before = [docs.count()], docs
    for k, (_, stage) in enumerate(P.STAGES):
        after = stage(spark, before, sf)
        if k < 4:
            assert after.columns == docs.columns
        rows = after.collect()
        sizes.append(len(rows))
        before = spark.createDataFrame(rows, after.schema)
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[4] == sizes[5] > 0
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontamination.find_leaks(before, bench).count() == 0
    assert P.run(spark, sf).count() == sizes[-1]


def test_stages_take_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, sf, name):
    n = entry.queries()[name](spark, sf).count()
    assert n > 0 or name == "op6_image_descriptors"  # the small table has no near copies among its vectors


def test_stages_take_awkward_rows(spark, sf, docs_of):
    """Nulls in every column, empty and repeated rows, long texts and clashing names: columns stay, and clean rows with them."""
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None), (None, "a text of no id, which stays"), (2, ""), (3, "..."), (4, "a clean text"), (4, "a clean text"), (5, long), (6, "\n" * 200_000), (None, None), (7, "mail x@y.org")]
    docs = docs_of(rows).selectExpr("doc_id AS DOC_ID", "text AS Text", "cast(null as string) AS lang", "'mine' AS tokens", "'mine' AS Toxicity", "'mine' AS surplus_id", "'mine' AS surrogate_text", "'mine' AS class")
    left = docs
    for name, stage in P.STAGES:
        left = stage(spark, left, sf)
        if name != "bpe":
            assert left.columns == docs.columns
    out = left.collect()
    assert sorted((r.DOC_ID for r in out), key=lambda i: (i is None, i or 0)) == [1, 2, 3, 4, 4, 5, 6, 7, None, None]
    by = {r.DOC_ID: r for r in out}
    assert by[7].Text.startswith("mail ") and by[7].Text != "mail x@y.org" and by[5].Text == long
    assert by[1].n_tokens is None and by[2].n_tokens == 0 and by[6].n_bytes == 200_000 and all(r.surplus_id == "mine" for r in out)
