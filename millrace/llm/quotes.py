"""Chat formatting: quotations are linked to the messages they come from and taken out.

Lines that begin with '>' are quotations, nested as deep as they have marks;
a line such as "On Monday Ann wrote:" before one belongs to it. Consecutive
lines of one depth are a passage. Its words are hashed, and looked up among
the hashes of the passages of earlier messages of the same conversation:
every run of a message's own text that has as many words, whichever word it begins at. The latest earlier message that has the passage is its original. A message
replies to the original of its shallowest linked passage (the last of those), or, without
one, to the message before it. The conversation is put in reply order:
every message right after the one it replies to and the replies that came
before, threads in the order of turns.

One shuffle brings a conversation's different messages together; the hash join within it is local. A conversation is
one row of one task: its messages have to fit into that task's memory.

Defined results: equal messages (turn, role and text) of a conversation count once; messages of one
turn are in the order of role and text; a null turn comes last; each message with a null
conv_id is a conversation of its own; a null text is an empty message; a message of nothing but
quotations stays, with an empty text. A passage without an
original is taken out too, and is counted in n_quotes but not in n_linked; its text is kept in
unlinked. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import lean
from .textvec import mix, word_hashes

_MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)(.*)", re.DOTALL)
_SAID = re.compile(r"[ \t]*(?:On\b.{0,200}\bwrote|Am\b.{0,200}\bschrieb\b.{0,80}|Le\b.{0,200}\ba écrit|El\b.{0,200}\bescribió)[ \t\xa0]?:[ \t]*", re.IGNORECASE)
#: Beginnings of lines and sentences; originals are looked up from every word, so that nothing here depends on them.
_BEGIN = re.compile(r"(?:^|(?<=[.!?…]))\s*(?=\S)", re.MULTILINE)


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(depth, passage)]) of a message."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    open_depth = 0
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        if not m:
            own.append(line)
            open_depth = 0
            continue
        depth, rest = m.group(1).count(">"), m.group(2)
        if open_depth == 0:  # what announces the quotation goes with it
            while own and not own[-1].strip():
                own.pop()
            if own and _SAID.fullmatch(own[-1]):
                own.pop()
        if not rest.strip() or _SAID.fullmatch(rest):
            open_depth = -depth  # an empty or announcing line ends the passage
        elif open_depth == depth:
            passages[-1][1].append(rest)
        else:
            passages.append((depth, [rest]))
            open_depth = depth
    return "\n".join(own).strip() if passages or open_depth else (text or ""), [(d, "\n".join(p)) for d, p in passages]


def hash_of(words: np.ndarray) -> int:
    """Of a run of words."""
    return int(run_hashes(words, np.array([0]), len(words))[0])


_BASE = np.uint64(0x9E3779B97F4A7C15)


def run_sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of words, and what takes a sum back to the first place."""
    n = len(words)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, _BASE, np.uint64))))
        back = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))))
        return np.concatenate(([np.uint64(0)], np.cumsum(words * power[:n]))), back


def run_hashes(words: np.ndarray, starts: np.ndarray, size: int, made: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Hash of the size words from each start, from prefix sums (run_sums(words), if made)."""
    sums, back = made or run_sums(words)
    with np.errstate(over="ignore"):
        return mix((sums[starts + size] - sums[starts]) * back[starts] + np.uint64(size))


def link(messages: list[tuple]) -> list[dict]:
    """Messages (turn, role, text) of one conversation, in reply order, linked and without quotations."""
    ordered = sorted(set(messages), key=lambda m: (m[0] is None, m[0] or 0, m[1] or "", m[2] or ""))
    parsed = [parse(m[2]) for m in ordered]
    # sizes of the passages that are looked up, and from which message on
    wanted: list[tuple[int, int, int, str, np.ndarray]] = []
    for i, (_, passages) in enumerate(parsed):
        for depth, passage in passages:
            words, _ = word_hashes([passage])
            wanted.append((i, depth, len(words), passage, words))
    originals: dict[tuple[int, int], list[int]] = {}
    if wanted:
        # what is looked up of each size, and the words it begins with
        asked = {size: np.unique(np.array([hash_of(w[4]) for w in wanted if w[2] == size], np.uint64)) for size in sorted({w[2] for w in wanted if w[2]})}
        first = np.unique(np.array([w[4][0] for w in wanted if w[2]], np.uint64))
        last = max(w[0] for w in wanted)
        for j, (own, _) in enumerate(parsed[:last]):
            words, _ = word_hashes([own])
            starts = np.flatnonzero(np.isin(words, first))
            if not len(starts):
                continue
            made = run_sums(words)
            for size, hashes in asked.items():
                inside = starts[: np.searchsorted(starts, len(words) - size, "right")]
                if not len(inside):
                    break
                made_here = run_hashes(words, inside, size, made)
                for h in np.intersect1d(made_here, hashes).tolist():
                    originals.setdefault((size, h), []).append(j)
    links: list[list[tuple[int, int | None, str]]] = [[] for _ in ordered]
    for i, depth, size, passage, words in wanted:
        found = [j for j in originals.get((size, hash_of(words)), ()) if j < i] if size else []
        links[i].append((depth, found[-1] if found else None, passage))
    parent: list[int | None] = []
    for i, own in enumerate(links):
        linked = [(d, -j) for d, j, _ in own if j is not None]
        parent.append(-min(linked)[1] if linked else i - 1 if i else None)
    children: list[list[int]] = [[] for _ in ordered]
    for i, p in enumerate(parent):
        if p is not None:
            children[p].append(i)
    out, stack = [], [(i, 0) for i in range(len(ordered) - 1, -1, -1) if parent[i] is None]
    while stack:
        i, depth = stack.pop()
        out.append(
            {
                "turn": ordered[i][0],
                "role": ordered[i][1],
                "text": parsed[i][0],
                "reply_to": None if parent[i] is None else ordered[parent[i]][0],
                "depth": depth,
                "quotes": [None if j is None else ordered[j][0] for _, j, _ in links[i]],
                "unlinked": [p for _, j, p in links[i] if j is None],
            }
        )
        stack += [(c, depth + 1) for c in reversed(children[i])]
    return out


_MESSAGE = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("reply_to", pa.int64()), ("depth", pa.int32()), ("quotes", pa.list_(pa.int64())), ("unlinked", pa.list_(pa.string()))])
_DDL = "conv_id bigint, messages array<struct<turn: bigint, role: string, text: string, reply_to: bigint, depth: int, quotes: array<bigint>, unlinked: array<string>>>, n_messages int, n_quotes int, n_linked int"


def link_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, messages (in reply order), n_messages, n_quotes, n_linked: a row each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                some = batch.slice(first, 200)
                made = [link([(m["turn"], m["role"], m["text"]) for m in group]) for group in some.column(1).to_pylist()]
                quotes = [sum(len(m["quotes"]) for m in c) for c in made]
                linked = [sum(q is not None for m in c for q in m["quotes"]) for c in made]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(made, pa.list_(_MESSAGE)), pa.array([len(c) for c in made], pa.int32()), pa.array(quotes, pa.int32()), pa.array(linked, pa.int32())],
                    names=["conv_id", "messages", "n_messages", "n_quotes", "n_linked"],
                )

    source = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("m"))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("m"))  # messages of no conversation don't meet
    return source.groupBy("conv_id", alone.alias("alone")).agg(F.collect_set("m").alias("m")).select("conv_id", "m").mapInArrow(lean(run), _DDL)
