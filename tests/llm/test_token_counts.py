import random

import pytest

from millrace.llm import bpe, token_counts

HARD = ["", "a", "don't we'll", "'r 're", "x'v 've", "a  b   c\n\n d", "naïve 你好 😀😀", "1234567 89", "....!!", " \t \n x", "aaaaaaaaaaaaaaaaaaaa", "  x", "é́"]


def test_every_prefix_equals_its_own_encoding():
    enc, own = bpe.encoding(), token_counts.PrefixCounts()
    r = random.Random(3)
    texts = HARD + ["".join(r.choice(["a", "e", "th", "ing", " ", "  ", "\n", "'s", "'", "7", ".", "é", "你"]) for _ in range(r.randint(1, 60))) for _ in range(150)]
    for text in texts:
        assert own.counts(text).tolist() == [len(enc.encode_ordinary(text[:i])) for i in range(len(text) + 1)], text


def test_packing_round_trip():
    own = token_counts.PrefixCounts()
    for text in [*HARD, "b" * 3000, " " * 500 + "x"]:
        counts = own.counts(text)
        assert token_counts.unpack(token_counts.pack(counts)).tolist() == counts.tolist()


def test_budget_cuts(docs_of):
    text = "the quick brown fox jumps over the lazy dog " * 30
    docs = docs_of([(1, text), (2, None), (3, "")], extra=True)
    out = {r.doc_id: r for r in token_counts.with_prefix_counts(docs, budgets=(5, 100)).collect()}
    enc = bpe.encoding()
    cut = out[1].cut_5
    assert len(enc.encode_ordinary(text[:cut])) <= 5 < len(enc.encode_ordinary(text[: cut + 12]))
    assert out[2].n_tokens is None and out[2].prefix_counts is None and out[2].cut_5 is None
    assert out[3].n_tokens == 0 and out[3].cut_100 == 0
    assert token_counts.with_prefix_counts(docs_of([])).count() == 0


@pytest.mark.parametrize("text", ["z" * 20_000, "word " * 20_000, "\n" * 5_000])
def test_very_long(text):
    enc, own = bpe.encoding(), token_counts.solver()
    counts = own.counts(text)
    assert counts[-1] == len(enc.encode_ordinary(text))
    for i in (1, 7, 1000, 4999):
        assert counts[i] == len(enc.encode_ordinary(text[:i]))
