"""Exact BPE token counts of every prefix of a text, by dynamic programming.

counts[i] is the number of tokens of text[:i], for every i from 0 to
len(text). With the counts stored, "how many tokens has this cut?" and "which is the
longest prefix within this budget?" are look-ups: nothing is encoded again.

The splitting regex cuts a text into pieces; the count of a prefix is that of
the pieces before, plus that of the part of the piece it ends in. Within
a piece the count follows the recurrence of prefix BPE: the encoding of a
byte string is the encoding of a shorter prefix plus one last token, namely the
longest token t that ends the string and stays a token of its own after
the last token of what is before it (merging both apart and together gives the same two
tokens). The tokens that end at a byte come from one Aho-Corasick pass over the piece, and a
piece is solved once a process and looked up from then on. Where the end of the text changes how it is split (runs of white
space, contractions) the prefix's own split is taken.

Counts are stored as differences, one signed byte a character (the few that don't fit
are escaped), deflated.

Defined results: a null text has null counts; an empty one has counts [0];
unpaired surrogates count as U+FFFD. Input columns named like an added one are
replaced by it.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import PATTERN, RANKS, clean, encoding
from .columns import with_computed

BUDGETS = (128, 512, 2048)
#: Pairs of tokens, and twice as many as pieces, that a process keeps; what is new beyond is solved each time.
KEEP = 1_000_000
SHIFT = 24

_SPLIT = regex.compile(PATTERN)
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPACE = r" \t\n\x0b\x0c\r"
#: The same split for texts of ASCII and Latin letters, in the faster standard engine.
_QUICK_SPLIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACE}{_LETTERS}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_OTHER = re.compile(r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]")
_RUN = re.compile(r"\s\s")
_CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)")


def split(text: str) -> list[str]:
    return (_SPLIT if _OTHER.search(text) else _QUICK_SPLIT).findall(text)


class PrefixCounts:
    """Solves the prefixes of pieces under one file of ranks."""

    def __init__(self, ranks: str = RANKS):
        self.enc = encoding(ranks)
        core = self.enc._core_bpe
        self.single = core.encode_single_piece
        self.vocabulary = {token: self.enc.encode_single_token(token) for token in self.enc.token_byte_values()}
        self.tokens = [b""] * (max(self.vocabulary.values()) + 1)
        for token, i in self.vocabulary.items():
            self.tokens[i] = token
        # finds the tokens that end at each byte, the longest first
        self.endings = ahocorasick.Automaton()
        for token, i in self.vocabulary.items():
            self.endings.add_word(token.decode("latin-1"), (len(token), i))
        self.endings.make_automaton()
        #: Whether two tokens stay, and what is known of pieces.
        self.stays: dict[int, bool] = {}
        self.pieces: dict[str, tuple[bytes | np.ndarray, int]] = {}

    def _pair_stays(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b are encoded as the two tokens a and b."""
        known = self.stays.get(a << SHIFT | b)
        if known is None:
            if len(self.stays) > KEEP:
                self.stays.clear()
            both = self.tokens[a] + self.tokens[b]
            known = self.stays[a << SHIFT | b] = both not in self.vocabulary and self.single(both) == [a, b]
        return known

    def every(self, s: bytes) -> list[int]:
        """Token counts of all prefixes of one piece."""
        counts, lasts = [0], [0]
        stays, pair_stays = self.stays, self._pair_stays
        for end, (size, last) in self.endings.iter(s.decode("latin-1")):
            if len(counts) > end + 1:
                continue  # a longer token ends here
            before = end + 1 - size
            if before:
                known = stays.get(lasts[before] << SHIFT | last)
                if not (pair_stays(lasts[before], last) if known is None else known):
                    continue
            counts.append(counts[before] + 1)
            lasts.append(last)
        return counts

    def solve(self, s: bytes) -> int:
        """Token count of one piece."""
        return self.every(s)[-1]

    def piece(self, piece: str) -> tuple[bytes | np.ndarray, int]:
        """(count after each character of a piece that stands alone, count of the whole)."""
        known = self.pieces.get(piece)
        if known is not None:
            return known
        raw = piece.encode("utf-8")
        if not piece.isascii():
            ends = np.cumsum([len(c.encode("utf-8")) for c in piece]).tolist()
        every = self.every(raw)
        counts = every[1:] if piece.isascii() else [every[e] for e in ends]
        if len(piece) == 3 and _CONTRACTION.fullmatch(piece):  # 'r, 'v and 'l alone are split in two
            counts[1] = len(self.single(raw[:1])) + len(self.single(raw[1:2]))
        made = (bytes(counts) if len(raw) <= 100 else np.array(counts, np.int64)), counts[-1]
        if len(raw) <= 1000 and len(self.pieces) < KEEP // 2:
            self.pieces[piece] = made
        return made

    def counts(self, text: str) -> np.ndarray:
        """Token count of text[:i] for i in 0..len(text)."""
        text = clean(text)
        pieces = split(text)
        if not pieces:
            return np.zeros(1, np.int64)
        get, make = self.pieces.get, self.piece
        made = [get(p) or make(p) for p in pieces]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        totals = np.fromiter((m[1] for m in made), np.int64, len(made))
        base = np.cumsum(totals) - totals
        if all(type(m[0]) is bytes for m in made):
            inside = np.frombuffer(b"".join([m[0] for m in made]), np.uint8).astype(np.int64)
        else:
            inside = np.concatenate([np.frombuffer(m[0], np.uint8).astype(np.int64) if type(m[0]) is bytes else m[0] for m in made])
        out = np.concatenate(([0], inside + np.repeat(base, sizes)))
        # a run of white space is one piece as long as the prefix ends in it, but loses its last character to what follows
        if _RUN.search(text):
            starts = np.cumsum(sizes) - sizes
            for k in range(1, len(pieces)):
                if pieces[k - 1].isspace() and pieces[k][0].isspace():
                    out[starts[k] + 1] = base[k - 1] + make(pieces[k - 1] + pieces[k][0])[1]
        return out


_SOLVERS: dict[str, PrefixCounts] = {}


def solver(ranks: str = RANKS) -> PrefixCounts:
    if ranks not in _SOLVERS:
        _SOLVERS[ranks] = PrefixCounts(ranks)
    return _SOLVERS[ranks]


def pack(counts: np.ndarray) -> bytes:
    """Differences as signed bytes; those beyond follow as (place, value)."""
    steps = np.diff(counts)
    odd = np.flatnonzero((steps < -127) | (steps > 127))
    small = steps.copy()
    small[odd] = 0
    extra = np.stack((odd, steps[odd]), 1).astype("<i8").tobytes()
    return len(odd).to_bytes(4, "little") + zlib.compress(extra + small.astype(np.int8).tobytes(), 1)


def unpack(stored: bytes) -> np.ndarray:
    n = int.from_bytes(stored[:4], "little")
    raw = zlib.decompress(stored[4:])
    steps = np.frombuffer(raw[16 * n :], np.int8).astype(np.int64)
    extra = np.frombuffer(raw[: 16 * n], "<i8").reshape(-1, 2)
    steps[extra[:, 0]] = extra[:, 1]
    return np.concatenate(([0], np.cumsum(steps)))


def fits(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def with_prefix_counts(docs: DataFrame, budgets: tuple[int, ...] = BUDGETS, ranks: str = RANKS) -> DataFrame:
    """docs with n_tokens, prefix_counts (packed) and, for each budget, cut_<budget>: the characters of the longest prefix within it."""

    def compute(texts: list[str | None]) -> list[pa.Array]:
        own = solver(ranks)
        totals, stored, cuts = [], [], [[] for _ in budgets]
        for text in texts:
            counts = None if text is None else own.counts(text)
            totals.append(None if counts is None else int(counts[-1]))
            stored.append(None if counts is None else pack(counts))
            for column, budget in zip(cuts, budgets):
                column.append(None if counts is None else fits(counts, budget))
        return [pa.array(totals, pa.int64()), pa.array(stored, pa.binary()), *[pa.array(c, pa.int64()) for c in cuts]]

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("prefix_counts", T.BinaryType()), *[T.StructField(f"cut_{b}", T.LongType()) for b in budgets]]
    return with_computed(docs, added, compute)
