"""Vectorised word hashing shared by the text operators.

A batch of texts is normalised once (NFKC, lower case, runs of anything that is
neither letter nor digit become one space), laid out in one byte buffer, and
every word gets a 64-bit hash from prefix sums of a polynomial over the bytes,
so that the cost a word is a few array operations and no Python call.
A null text counts as an empty one: it has no words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import numpy as np

_SEPARATORS = re.compile(r"[\W_]+")
_RARE_SEPARATOR = re.compile(r"[^\x00-\x7f\w]")
#: ASCII letters in lower case and digits stay, any other ASCII byte becomes a space; bytes of other characters stay.
_TABLE = bytes(ord(chr(b).lower()) if b >= 128 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
_CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _spaced(text: str | None) -> bytes:
    """Lower-case UTF-8 whose words are parted by one or more spaces."""
    if not text:
        return b""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower()
        if _RARE_SEPARATOR.search(text):
            text = _SEPARATORS.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(_TABLE)


def normalise(text: str | None) -> str:
    """Words in lower case with single spaces; '' for null or no word."""
    return b" ".join(_spaced(text).split()).decode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, _CHUNK + 4096)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _hash_chunk(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of a buffer, which spaces part."""
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(data)]))
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the words of text i are hashes[offsets[i]:offsets[i + 1]]."""
    clean = [_spaced(t) for t in texts]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in clean), np.int64, len(clean)))
    data = np.frombuffer(b" ".join(clean), np.uint8)
    del clean
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        if end < len(data):
            space = np.flatnonzero(data[at:end] == 32)
            if len(space):
                end = at + int(space[-1])
            else:
                rest = np.flatnonzero(data[end:] == 32)
                end = end + int(rest[0]) if len(rest) else len(data)
        if end > at:
            h, s = _hash_chunk(data[at:end])
            hashes.append(h)
            starts.append(s + at)
        at = end + 1
    offsets = np.searchsorted(np.concatenate(starts), ends)
    return np.concatenate(hashes), np.concatenate(([0], offsets))


def slices(texts: Sequence[str | None], chars: int = 1_500_000):
    """(first, last) ranges of rows of about so many characters, one row at least."""
    first = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= chars:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def gram_hashes(words: np.ndarray, gaps: Sequence[int]) -> np.ndarray:
    """Hash of the words at i + gap for each gap, for every i that has them all."""
    size = len(words) - max(gaps)
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(size, len(gaps) * 0x632BE59BD9B4E019 & (1 << 64) - 1, np.uint64)
    with np.errstate(over="ignore"):
        for gap in gaps:
            out = (out ^ words[gap : gap + size]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
        return mix(out)
