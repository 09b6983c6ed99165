import random

import pytest

from millrace.llm import bpe

TEXTS = ["", " ", "hello world", "a\n\n  b\t c", "naïve café – 你好 \U0001f600", "<|endoftext|> 'll don't 'S", "x" * 5000, " \n" * 3000, "́́ é"]


def test_round_trip_and_whole_text_ids():
    enc = bpe.encoding()
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("ab1 \n\t'.é你 ") for _ in range(r.randint(1, 400))) for _ in range(200)]
    for t in texts:
        ids = bpe.encode(enc, t, size=7)
        assert ids == enc.encode_ordinary(t)
        assert bpe.decode(enc, ids) == t.encode()


@pytest.mark.parametrize("text", ["\n" * 5_000_000, " " * 5_000_000 + "x", "a" * 5_000_000, "." * 5_000_000, "é" * 5_000_000, "7" * 5_000_000, "\u3000" * 1_000_000 + "你", "x" + "\t" * 1_000_000 + " y" + " " * 1_000_000, "qZ8+/" * 1_000_000])
def test_millions_of_characters_without_a_break(text):
    enc = bpe.encoding()
    assert bpe.decode(enc, bpe.encode(enc, text)) == text.encode()


def test_long_white_space_has_the_ids_of_the_whole(monkeypatch):
    enc, r = bpe.encoding(), random.Random(3)
    for _ in range(300):  # runs on both sides of the limit, which the regex can still take
        text = "".join(r.choice(("a", " b", "\n", "c.", "1", "你")) + r.choice(" \n\t\u3000\x85\x1c") * r.choice((0, 1, 2, 399, 400, 401, 700)) for _ in range(r.randint(1, 6)))
        assert bpe.encode(enc, text) == enc.encode_ordinary(text)


def test_text_column_in_another_case(docs_of):
    docs = docs_of([(1, "abc def ghi jkl")]).selectExpr("doc_id", "text AS TEXT", "'z' AS other")
    (row,) = bpe.with_tokens(docs).collect()
    assert row.n_bytes == 15 and row.TEXT == "abc def ghi jkl" and row.other == "z"


def test_long_text_is_cut_at_safe_places():
    text = "some words, and more of them\n" * 20_000
    assert "".join(bpe.parts(text)) == text
    assert len(list(bpe.parts(text))) > 5
    enc = bpe.encoding()
    assert bpe.encode(enc, text) == enc.encode_ordinary(text)


def test_columns_of_any_table(docs_of):
    docs = docs_of([(1, None), (None, ""), (2, "two words"), (2, "two words")], extra=True)
    out = bpe.with_tokens(docs)
    assert [c for c in out.columns if c.lower() == "tokens"] == ["tokens"]
    rows = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert rows[0].tokens is None and rows[0].n_tokens is None
    assert rows[1].tokens == rows[2].tokens and rows[1].n_bytes == 9
    assert rows[3].tokens == [] and rows[3].n_tokens == 0
    back = {r.doc_id: r.decoded_text for r in bpe.with_text(out).collect()}
    assert back == {1: None, 2: "two words", None: ""}


def test_unpaired_surrogate_counts_as_replacement():
    enc = bpe.encoding()
    assert bpe.decode(enc, bpe.encode(enc, "a\ud800b")).decode() == "a\ufffdb"


def test_empty_table_and_unknown_id(spark, docs_of):
    assert bpe.with_tokens(docs_of([])).count() == 0
    with pytest.raises(Exception):
        bpe.with_text(spark.createDataFrame([([10_000_000],)], "tokens array<int>")).collect()
