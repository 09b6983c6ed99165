"""Benchmark decontamination: one Aho-Corasick automaton, one scan of each text.

Patterns are the runs of `window` words of every normalised benchmark text (the
whole text where it is shorter), so that a verbatim item and a passage cut out
of one are both found. A text is normalised once and scanned once; only for a
text with matches are the word positions of the original worked out, and
overlapping matches of one item become one span of original characters.

A character of a script that is written without spaces (Chinese, Japanese kana, Thai, Lao, Khmer, Burmese) counts as a word.

Defined results: a null or empty text has no match; items of fewer than
`min_words` words are no evidence and give no pattern; an item text that occurs
under several ids is reported for each; repeated rows are reported each; with an
empty benchmark nothing matches. Other columns of either table are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import lean, map_arrow, place_of, texts_of
from .textvec import normalise, slices

WINDOW, MIN_WORDS = 13, 5
#: Characters of benchmark text that one automaton may hold (about 40 times as many bytes); more are scanned in several passes.
MAX_CHARS = 8_000_000
MATCHES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("words", T.LongType())])
#: Han, kana, Thai, Lao, Burmese and Khmer letters.
_ALONE = "\u3005-\u3007\u3041-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff\u0e01-\u0e30\u0e40-\u0e46\u0e81-\u0eb0\u0ec0-\u0ec6\u1000-\u102a\u1780-\u17b3"
_WORD = re.compile(rf"[{_ALONE}]|(?:(?![{_ALONE}])[^\W_])+")
_CHARACTER = re.compile(f"[{_ALONE}]")


def words_of(text: str | None) -> str:
    """The words of a text with single spaces."""
    clean = normalise(text)
    return clean if clean.isascii() or not _CHARACTER.search(clean) else " ".join(_WORD.findall(clean))


def patterns(items: list[tuple[int | None, str | None]], window: int = WINDOW, min_words: int = MIN_WORDS) -> dict[str, list[int]]:
    """' w1 w2 ... ' -> places in items of the texts that have this run of words."""
    found: dict[str, list[int]] = {}
    for place, (_, text) in enumerate(items):
        words = words_of(text).split()
        if len(words) < max(1, min_words):
            continue
        size = min(window, len(words))
        for i in range(len(words) - size + 1):
            places = found.setdefault(f" {' '.join(words[i : i + size])} ", [])
            if not places or places[-1] != place:
                places.append(place)
    return found


def automaton(items: list[tuple[int | None, str | None]], window: int = WINDOW, min_words: int = MIN_WORDS):
    """The automaton over patterns(items), or None where there is no pattern."""
    built = ahocorasick.Automaton()
    for key, places in patterns(items, window, min_words).items():
        built.add_word(key, (len(key), tuple(places)))
    if not len(built):
        return None
    built.make_automaton()
    return built


def word_spans(text: str, word: re.Pattern = _WORD) -> tuple[list[str], list[tuple[int, int]]]:
    """(words, (start, end) in text of each), normalised piece by piece."""
    if text.isascii():
        found = list(word.finditer(text))
        return [m.group().lower() for m in found], [m.span() for m in found]
    # a character and the marks (or conjoining jamo) after it are normalised as one
    cuts = [0] + [i for i in range(1, len(text)) if not unicodedata.combining(text[i]) and not "ᅠ" <= text[i] <= "ᇿ" and text[i] not in "ﾞﾟ"] + [len(text)]
    pieces = [unicodedata.normalize("NFKC", text[a:b]).lower() for a, b in zip(cuts, cuts[1:])]
    origin = [i for i, p in enumerate(pieces) for _ in p]
    found = list(word.finditer("".join(pieces)))
    return [m.group() for m in found], [(cuts[origin[m.start()]], cuts[origin[m.end() - 1] + 1]) for m in found]


def matches(built, text: str | None, places: list[int | None]) -> list[tuple[int | None, int, int, int]]:
    """(item id, start, end, words) of the spans of text that items of the automaton cover."""
    clean = words_of(text)
    if built is None or not clean or next(built.iter(f" {clean} "), None) is None:
        return []
    words, spans = word_spans(text)
    clean = " ".join(words)  # the same words, but for marks that the whole text combines otherwise: here each has its place
    by_item: dict[int, list[tuple[int, int]]] = {}
    for end, (size, items) in built.iter(f" {clean} "):
        for place in items:
            by_item.setdefault(place, []).append((end - size + 1, end - 1))
    found = []
    for place, hits in by_item.items():
        merged: list[list[int]] = []
        for a, b in hits:  # in the order of their ends
            while merged and a <= merged[-1][1]:
                a = min(a, merged.pop()[0])
            merged.append([a, b])
        for a, b in merged:
            first, last = clean.count(" ", 0, a), clean.count(" ", 0, b)
            found.append((places[place], spans[first][0], spans[last][1], last - first + 1))
    return sorted(found, key=lambda m: (m[0] is None, m[0] or 0, m[1]))


def _chunks(benchmark: DataFrame, max_chars: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, in lists of which each makes one automaton of a checked size; the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // max_chars) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield [(r[0], r[1]) for r in (items if n == 1 else items.filter(part == k)).collect()]


def _built(token: str, shared, window: int, min_words: int):
    """This worker's automaton for a broadcast list of items; built once, the last one is kept. The token names the list."""
    if _CACHE.get("token") != token:
        _CACHE.clear()
        _CACHE.update(token=token, automaton=automaton(shared.value, window, min_words), ids=[i for i, _ in shared.value])
    return _CACHE["automaton"], _CACHE["ids"]


_CACHE: dict = {}


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, item_id, start_char, end_char, words: every span of a document that a benchmark text covers."""
    spark, out = docs.sparkSession, None
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items in _chunks(benchmark, max_chars):
        shared, token = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, token=token) -> Iterator[pa.RecordBatch]:
            built, places = _built(token, shared, window, min_words)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(i, *m) for i, text in zip(ids, texts_of(batch)) for m in matches(built, text, places)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=MATCHES.names)

        found = source.mapInArrow(lean(run), MATCHES)
        out = found if out is None else out.union(found)
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, max_chars: int = MAX_CHARS) -> DataFrame:
    """docs without the rows whose text has a match; all columns and all other rows stay as they are."""
    spark = docs.sparkSession
    at = place_of("text", docs.columns)
    for items in _chunks(benchmark, max_chars):
        shared, token = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, token=token) -> Iterator[pa.RecordBatch]:
            built, _ = _built(token, shared, window, min_words)
            for batch in batches:
                if built is None:
                    yield batch
                    continue
                texts = batch.column(at).to_pylist()
                for first, last in slices(texts):
                    keep = [next(built.iter(f" {words_of(t)} "), None) is None if t else True for t in texts[first:last]]
                    yield batch.slice(first, last - first).filter(pa.array(keep, pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
    return docs
