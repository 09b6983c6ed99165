"""Byte-level BPE encoding and decoding with tiktoken and a local file of ranks.

A long text is cut before it is encoded, at places where the splitting regex
would cut it anyway: between a character that is not white space and a single
space or line break that a non-space follows. No piece of the regex crosses such a place and no
look-ahead sees over it, so the ids of the parts joined are the ids of the whole.
A run of LONG_SPACE characters of white space or more never reaches the regex, whose look-ahead would
take a stack frame for each: it is one piece as it stands, but for its last character, which goes with what
follows. What has no safe place within a stretch (letters, digits or marks without a break) is kept whole.

Defined results: a null text has null tokens and null n_tokens; an empty one has
none and 0. Decoding goes by raw bytes and gives back every text, whatever the
characters; unpaired surrogates, which UTF-8 can't hold, count as U+FFFD each. Special
tokens' strings in a text are ordinary text. Input columns named like an added
one are replaced by it.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import map_arrow, with_computed

RANKS = os.environ.get("MILLRACE_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters after which the next safe place is taken.
PART = 50_000
_SAFE = re.compile(r"(?<=[^\W_])[ \n](?=[^\W_])")
LONG_SPACE = 400
#: White space as the splitting regex knows it.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)
_UNPAIRED = re.compile("[\ud800-\udfff]")
_LOADED: dict[str, tiktoken.Encoding] = {}


def encoding(ranks: str = RANKS) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 token and rank a line); read once a process."""
    if ranks not in _LOADED:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[ranks] = tiktoken.Encoding(os.path.basename(ranks), pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _LOADED[ranks]


def parts(text: str, size: int = PART) -> Iterator[str]:
    """text in parts of about size characters, cut at safe places only."""
    first = 0
    while len(text) - first > size:
        m = _SAFE.search(text, first + size)
        if not m:
            break
        yield text[first : m.start()]
        first = m.start()
    yield text[first:]


def clean(text: str) -> str:
    """text as UTF-8 can hold it."""
    return text if text.isascii() else _UNPAIRED.sub("\ufffd", text)


def encode(enc: tiktoken.Encoding, text: str, size: int = PART) -> list[int]:
    text = clean(text)
    if len(text) < LONG_SPACE:
        return enc.encode_ordinary(text)
    tokens: list[int] = []
    at = 0
    for m in _SPACES.finditer(text):
        for part in parts(text[at : m.start()], size):
            tokens += enc.encode_ordinary(part)
        at = m.end() if m.end() == len(text) else m.end() - 1
        tokens += enc._core_bpe.encode_single_piece(text[m.start() : at].encode())
    for part in parts(text[at:], size):
        tokens += enc.encode_ordinary(part)
    return tokens


def decode(enc: tiktoken.Encoding, tokens) -> bytes:
    return enc.decode_bytes(tokens)


def _lists(tokens: list[list[int] | None]) -> pa.Array:
    ends = np.cumsum([0] + [len(t or ()) for t in tokens]).astype(np.int32)
    flat = np.fromiter((x for t in tokens if t for x in t), np.int32, int(ends[-1]))
    missing = np.fromiter((t is None for t in tokens), bool, len(tokens))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(missing))


def with_tokens(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """docs with tokens (array of ids), n_tokens and n_bytes; fails if a text doesn't come back from its tokens."""

    def compute(texts: list[str | None]) -> list[pa.Array]:
        enc = encoding(ranks)
        tokens = [None if t is None else encode(enc, t) for t in texts]
        sizes: list[int | None] = []
        for text, ids in zip(texts, tokens):
            if text is None:
                sizes.append(None)
                continue
            raw = decode(enc, ids)
            if raw != clean(text).encode():
                raise ValueError("decoding the tokens doesn't give the text back")
            sizes.append(len(raw))
        return [_lists(tokens), pa.array([None if t is None else len(t) for t in tokens], pa.int32()), pa.array(sizes, pa.int64())]

    return with_computed(docs, [T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("n_bytes", T.LongType())], compute)


def with_text(tokens: DataFrame, ranks: str = RANKS) -> DataFrame:
    """tokens with decoded (raw bytes) and decoded_text (null where the bytes are no UTF-8); null for null tokens.

    An id that the vocabulary lacks raises an error.
    """
    at = next(i for i, c in enumerate(tokens.columns) if c.lower() == "tokens")
    kept = [i for i, c in enumerate(tokens.columns) if c.lower() not in ("decoded", "decoded_text")]
    schema = T.StructType([*[tokens.schema[i] for i in kept], T.StructField("decoded", T.BinaryType()), T.StructField("decoded_text", T.StringType())])

    def text(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else raw.decode("utf-8")
        except UnicodeDecodeError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                some = batch.slice(first, 500)
                raw = [None if t is None else decode(enc, t) for t in some.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[some.column(i) for i in kept], pa.array(raw, pa.binary()), pa.array([text(r) for r in raw], pa.string())], names=schema.names)

    return map_arrow(tokens, run, schema)
