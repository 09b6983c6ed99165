"""All pairs of documents whose sets of word n-grams have a Jaccard similarity of THRESHOLD or more.

Steps, each a map or a shuffle of packed arrays rather than of single grams:

1. Every text becomes its set of n-gram hashes (the words as one gram where it has fewer
   than n). Texts of one set make a *class*, named by a 64-bit hash of the set and its size;
   from here on a class counts once, however many copies it has, and the copies are (doc_id, class) rows
   that are never gathered by class.
2. Grams are shuffled by range of hash, packed class by class, and each range finds in how
   many classes its grams occur. A gram of a single class can't be shared, so only
   repeated grams go on, back to their classes. A gram in HOT classes of one slice of texts is
   known to be frequent there and then: the slice reports it once and sends its classes straight on, so
   that a range holds fewer than HOT entries of it a slice. Such grams rank last everywhere.
3. A class orders its grams by rarity. The unique ones come first and can't meet
   anything; the prefix that remains (size - ceil(t * size) + 1 grams, less the unique ones) is
   what it joins on. Classes whose repeated grams can't reach the threshold end here.
   A gram in the prefixes of HEAVY classes or more is *heavy*. Heavy grams that one prefix holds belong together, and so do
   the classes that hold them: two such classes are compared with each other in step 6, and only there.
4. The other prefix grams are counted by cells of their hash and shuffled in groups of cells of about
   PAIR_ROWS entries; a larger cell is parted by class and paired part by part. Classes that meet there pass the length filter, the
   positional filter and the suffix filter: the gram space is parted into FANOUT
   fixed ranges, and the sum of the smaller counts of each range bounds the overlap.
5. Candidate pairs are shuffled by pair of blocks, repeats fall away, the classes that they need are sent
   to the same place once a block pair, and each pair is verified once, over whole sets. What leaves a
   block pair is a spanning forest of its similar pairs and each class's number of links, not the pairs.
6. Classes that heavy grams hold together are cut into blocks of up to DENSE_ROWS, and each pair of blocks gets the
   overlaps of all its pairs at once: grams that many of them have by a product of matrices, the others one by one.
   What leaves is as in step 5, so that a text of many thousand variants costs no row for each pair of them.

The number of groups of every shuffle follows from the bytes of the texts, and each group has its own partition.
There is no cap on partners, and no list of a frequent gram is skipped: pairs are
formed in slices, so that memory is bounded however many there are. Verification counts
48-bit hashes; two of a pair's grams fall together with a chance of about |a| |b| / 2**48, two
classes of c with one of c * c / 2**65.

Defined results: rows with a null doc_id take part in nothing, neither do null texts
and texts without a word; repeated rows count once; a doc_id with several texts takes
part with each, and they belong to one group; similar texts of one id count as links of it. Other columns are
not looked at, whatever their names. An empty table has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import fresh_name, lean, quoted, texts_of
from .links import AT_ONCE, block_keys, block_of, components, forest, group_of_parts, layout, linked, linked_rows, own_partitions, pairs_within, settled, spread_keys
from .textvec import gram_hashes, mix, slices, word_hashes

N, THRESHOLD = 5, 0.4
FANOUT = 16
#: Classes of one slice of texts from which a gram is frequent.
HOT = 64
#: Bytes of text whose grams a range has, bytes of gram sets that a block pair has, and prefix entries of a group.
RANGE_BYTES, BLOCK_BYTES, PAIR_ROWS = 24 << 20, 24 << 20, 1_000_000
#: Classes in whose prefixes a gram is heavy; classes and bytes of gram sets of a block of classes that heavy grams hold together; most partitions of their pairs.
HEAVY, DENSE_ROWS, DENSE_BYTES, DENSE_PARTITIONS = 128, 4096, 8 << 20, 2000
#: Characters of a slice.
SLICE = 3_000_000


# ---- plain functions over arrays ----


def gram_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """The sorted distinct gram hashes of each text; empty for a text without words."""
    words, at = word_hashes(texts)
    out = []
    grams = gram_hashes(words, tuple(range(n)))
    for a, b in zip(at[:-1], at[1:]):
        out.append(np.unique(grams[a : b - n + 1]) if b - a >= n else gram_hashes(words[a:b], tuple(range(b - a))) if b > a else np.zeros(0, np.uint64))
    return out


def class_of(grams: np.ndarray) -> int:
    """A signed 64-bit name of a set of grams."""
    with np.errstate(over="ignore"):
        total = mix(np.array([grams.sum() * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_xor.reduce(mix(grams)) + np.uint64(len(grams))], np.uint64))
    return int(total.view(np.int64)[0])


def needed(size_a, size_b, t: float):
    """Least overlap of two sets of Jaccard similarity t."""
    return np.ceil(t / (1 + t) * (size_a + size_b) - 1e-9).astype(np.int64)


def prefix_length(size, t: float):
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def _pack(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _counts(x: np.ndarray) -> bytes:
    """In as few bytes each as the largest needs."""
    return _pack(x, "<u1" if x.max() < 1 << 8 else "<u2" if x.max() < 1 << 16 else "<u4")


def _six(x: np.ndarray) -> bytes:
    """The low 48 bits of each number."""
    return np.ascontiguousarray(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    x = np.zeros((len(raw) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return x.view("<u8").ravel()


def _table(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.table({n: pa.array(list(c), k) for c, (n, k) in zip(columns, kinds)})


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _spans(places: np.ndarray):
    """(value, first, last) of each run of sorted values."""
    starts = _firsts(places)
    yield from zip(places[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(places)])


# ---- step 1: classes and packed grams ----

#: Kinds of rows: (doc, class) of texts; grams of classes; frequent grams; frequent grams of classes; sizes of classes.
_DOCS, _GRAMS, _FREQUENT, _HELD, _SIZES = range(5)
_STEP1 = [("bucket", pa.int32()), ("kind", pa.int8()), ("classes", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())]
_STEP1_DDL = "bucket int, kind tinyint, classes binary, counts binary, grams binary"


def _by_range(ranges: np.ndarray, n: int, chars: int, hot: int):
    """ranges: the key of each range's group; the keys serve for the parts of step 3 as well."""
    wide = len(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch)
            for first, last in slices(texts, chars):
                rows: list[tuple] = []
                fresh: dict[int, np.ndarray] = {}
                docs: list[tuple[int, int]] = []
                for i, grams in zip(ids[first:last], gram_sets(texts[first:last], n)):
                    if len(grams) and i is not None:
                        name = class_of(grams)
                        fresh[name] = grams
                        docs.append((i, name))
                if not fresh:
                    continue
                pairs = np.array(docs, np.int64)
                part = (mix(pairs[:, 0].astype(np.uint64)) % np.uint64(wide)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                for k, a, b in _spans(part[order]):
                    rows.append((int(ranges[k]), _DOCS, _pack(pairs[order[a:b], 1], "<i8"), None, _pack(pairs[order[a:b], 0], "<i8")))
                names = np.fromiter(fresh, np.int64, len(fresh))
                sizes = np.array([len(g) for g in fresh.values()])
                part = names % wide
                order = np.argsort(part, kind="stable")
                for k, a, b in _spans(part[order]):
                    rows.append((int(ranges[k]), _SIZES, _pack(names[order[a:b]], "<i8"), _counts(sizes[order[a:b]]), None))
                grams = np.concatenate(list(fresh.values()))
                owner = np.repeat(np.arange(len(fresh)), sizes)
                if len(fresh) >= hot:
                    inorder = np.sort(grams)
                    often = np.unique(inorder[hot - 1 :][inorder[hot - 1 :] == inorder[: len(inorder) - hot + 1]])
                    if len(often):
                        at = np.searchsorted(often, grams)
                        at[at == len(often)] = 0
                        held = often[at] == grams
                        rows += _rows(often, np.zeros(0, np.int64), _range_of(often, wide), names, ranges, _FREQUENT)
                        rows += _rows(grams[held], owner[held], part[owner[held]], names, ranges, _HELD)
                        grams, owner = grams[~held], owner[~held]
                # sets are sorted, so stable sorting by range keeps classes together
                rows += _rows(grams, owner, _range_of(grams, wide), names, ranges, _GRAMS)
                yield from _table(rows, _STEP1).to_batches()

    return run


def _range_of(grams: np.ndarray, wide: int) -> np.ndarray:
    return ((grams >> np.uint64(32)) * np.uint64(wide) >> np.uint64(32)).astype(np.int64)


def _rows(grams: np.ndarray, owner: np.ndarray, place: np.ndarray, names: np.ndarray, keys: np.ndarray, kind: int) -> list[tuple]:
    """A row for each place that has grams: them, class by class. owner is empty where classes don't matter."""
    order = np.argsort(place, kind="stable")
    grams, owner = grams[order], owner[order] if len(owner) else owner
    rows = []
    for k, a, b in _spans(place[order]):
        if len(owner):
            new = _firsts(owner[a:b])
            rows.append((int(keys[k]), kind, _pack(names[owner[a:b][new]], "<i8"), _counts(np.diff(np.append(new, b - a))), _six(grams[a:b])))
        else:
            rows.append((int(keys[k]), kind, None, None, _six(grams[a:b])))
    return rows


def _unpack(classes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(classes, "<i8")
    return names, np.frombuffer(counts, f"<u{len(counts) // len(names)}").astype(np.int64)


def _entries(classes: list, counts: list, grams: list) -> tuple[np.ndarray, np.ndarray]:
    """(class, gram) of every gram of packed rows."""
    total = sum(map(len, grams)) // 6
    names, found = np.empty(total, np.int64), np.zeros((total, 8), np.uint8)  # filled in place, as they are the most that a task holds
    at = 0
    for c, m, g in zip(classes, counts, grams):
        end = at + len(g) // 6
        names[at:end] = np.repeat(*_unpack(c, m))
        found[at:end, :6] = np.frombuffer(g, np.uint8).reshape(-1, 6)
        at = end
    return names, found.view("<u8").ravel()


# ---- step 2: repeated grams, packed by class ----

_STEP2 = [("part", pa.int32()), ("kind", pa.int8()), ("classes", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary()), ("ranks", pa.binary())]
_STEP2_DDL = "part int, kind tinyint, classes binary, counts binary, grams binary, ranks binary"
_LAST = 255


def _repeated(ranges: np.ndarray):
    wide = len(ranges)

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        rows: list[tuple] = []
        columns: dict[int, list[list]] = {k: [[], [], []] for k in (_GRAMS, _FREQUENT)}
        for kind, *row in zip(*(group.column(x).to_pylist() for x in ("kind", "classes", "counts", "grams"))):
            if kind in columns:
                for held, x in zip(columns[kind], row):
                    held.append(x)
            else:
                rows.append((bucket, kind, *row, None))
        name, gram = _entries(*columns[_GRAMS])
        often = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(_from_six, columns[_FREQUENT][2])]))
        del columns
        order = np.argsort(gram, kind="stable")
        gram, name = gram[order], name[order]
        # only grams that occur twice, or are frequent, can be repeated; of those, the classes are told apart
        same = gram[1:] == gram[:-1]
        twice = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(gram) else np.zeros(0, bool)
        if len(often):
            twice |= _among(gram, often)
        gram, name = gram[twice], name[twice]
        order = np.lexsort((name, gram))
        gram, name = gram[order], name[order]
        first = np.concatenate(([True], (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])))[: len(gram)]
        gram, name = gram[first], name[first]
        if len(gram):
            new = _firsts(gram)
            df = np.diff(np.append(new, len(gram)))
            rank = np.minimum(_LAST - 1, np.round(16 * np.log2(df))).astype(np.uint8)  # 0: one class only
            if len(often):
                rank[_among(gram[new], often)] = _LAST
            rank = np.repeat(rank, df)
            keep = rank > 0
            gram, name, rank = gram[keep], name[keep], rank[keep]
            part = name % wide
            order = np.lexsort((gram, name, part))
            gram, name, rank = gram[order], name[order], rank[order]
            for k, a, b in _spans(part[order]):
                new = _firsts(name[a:b])
                rows.append((int(ranges[k]), _GRAMS, _pack(name[a:b][new], "<i8"), _counts(np.diff(np.append(new, b - a))), _six(gram[a:b]), rank[a:b].tobytes()))
        return _table(rows, _STEP2)

    return run


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of x are in some, which is sorted and not empty."""
    at = np.searchsorted(some, x)
    at[at == len(some)] = 0
    return some[at] == x


# ---- step 3: classes with their repeated grams, rare first ----

_STEP3_DDL = "doc_id bigint, class bigint, size int, grams binary, prefix int, light int"


def _assemble(t: float, heavy: int):
    """The distinct (doc_id, class); and one row, without doc_id, for each class that may have a partner: its repeated grams in order of rarity.

    The first `light` grams of its prefix are in too few classes to be heavy.
    """
    limit = min(_LAST - 1, round(16 * math.log2(heavy)))

    def run(group: pa.Table) -> pa.Table:
        by: dict[int, list[tuple]] = {k: [] for k in (_DOCS, _GRAMS, _HELD, _SIZES)}
        for kind, *row in zip(*(group.column(x).to_pylist() for x in ("kind", "classes", "counts", "grams", "ranks"))):
            by[kind].append(row)
        nothing = np.zeros((0, 2), np.int64)
        docs = np.concatenate([nothing, *[np.stack((np.frombuffer(g, "<i8"), np.frombuffer(c, "<i8")), 1) for c, _, g, _ in by[_DOCS]]])
        docs = docs[np.lexsort((docs[:, 1], docs[:, 0]))]
        docs = docs[np.concatenate(([True], (docs[1:] != docs[:-1]).any(axis=1)))[: len(docs)]]
        sizes = np.concatenate([nothing, *[np.stack(_unpack(c, m), 1) for c, m, _, _ in by[_SIZES]]])
        known, at = np.unique(sizes[:, 0], return_index=True)
        sizes = sizes[at, 1]
        name, gram = _entries(*([r[k] for r in by[_GRAMS] + by[_HELD]] for k in range(3)))
        rank = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(r[3], np.uint8) for r in by[_GRAMS]]])
        rank = np.concatenate((rank, np.full(len(gram) - len(rank), _LAST, np.uint8)))
        order = np.lexsort((gram, rank, name))
        name, gram, rank = name[order], gram[order], rank[order]
        # a frequent gram of a class can come from several slices, and from a range too
        new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])))[: len(gram)]
        name, gram, rank = name[new], gram[new], rank[new]
        rows: list[tuple] = []
        for own, a, b in _spans(name):
            size = int(sizes[np.searchsorted(known, own)])
            prefix = int(prefix_length(np.int64(size), t)) - (size - (b - a))
            if prefix > 0:
                rows.append((own, size, _six(gram[a:b]), prefix, min(prefix, int(np.searchsorted(rank[a:b], limit)))))
        own, size, grams, prefix, light = zip(*rows) if rows else ([],) * 5
        none = [None] * len(docs)
        return pa.table(
            {
                "doc_id": pa.array([*docs[:, 0].tolist(), *[None] * len(rows)], pa.int64()),
                "class": pa.array([*docs[:, 1].tolist(), *own], pa.int64()),
                "size": pa.array([*none, *size], pa.int32()),
                "grams": pa.array([*none, *grams], pa.binary()),
                "prefix": pa.array([*none, *prefix], pa.int32()),
                "light": pa.array([*none, *light], pa.int32()),
            }
        )

    return run


# ---- heavy grams ----


def _heavy_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many prefixes the grams are that may be heavy."""
    for batch in batches:
        some = [_from_six(g[6 * a : 6 * p]) for g, a, p in zip(*(batch.column(x).to_pylist() for x in ("grams", "light", "prefix"))) if p > a]
        if some:
            gram, n = np.unique(np.concatenate(some), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(n)], names=["gram", "n"])


def _heavy_of(batch: pa.RecordBatch, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in heavy) of each heavy gram of a prefix, row by row."""
    a, p = (np.array(batch.column(x).to_pylist(), np.int64) for x in ("light", "prefix"))
    row = np.repeat(np.arange(len(a)), p - a)
    gram = np.concatenate([np.zeros(0, np.uint64), *[_from_six(g[6 * i : 6 * j]) for g, i, j in zip(batch.column("grams").to_pylist(), a, p) if j > i]])
    held = _among(gram, heavy)
    return row[held], np.searchsorted(heavy, gram[held])


def _heavy_links(shared):
    """Places of heavy grams that one prefix holds: the first of the prefix with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at = _heavy_of(batch, shared.value)
            if len(row):
                new = _firsts(row)
                links = np.unique(np.stack((np.repeat(at[new], np.diff(np.append(new, len(row)))), at), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["u", "v"])

    return run


def _held_together(shared):
    """dense, class, size, grams of the classes with heavy grams; dense names those that belong together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, dense = shared.value
        for batch in batches:
            row, at = _heavy_of(batch, heavy)
            if len(row):
                new = _firsts(row)
                some = batch.select(["class", "size", "grams"]).take(pa.array(row[new]))
                yield pa.RecordBatch.from_arrays([pa.array(dense[at[new]], pa.int32()), *some.columns], names=["dense", *some.schema.names])

    return run


def heavy_grams(joining: DataFrame, heavy: int) -> tuple[np.ndarray, np.ndarray]:
    """(the sorted grams in the prefixes of so many classes, the number of what each belongs to)."""
    counts = joining.filter("light < prefix").select("grams", "light", "prefix").mapInArrow(lean(_heavy_counts), "gram bigint, n bigint")
    grams = np.sort(np.array([r.gram for r in counts.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= heavy).select("gram").collect()], np.int64)).astype(np.uint64)
    dense = np.arange(len(grams))
    if len(grams):
        shared = joining.sparkSession.sparkContext.broadcast(grams)
        for u, v in components(joining.filter("light < prefix").select("grams", "light", "prefix").mapInArrow(lean(_heavy_links(shared)), "u bigint, v bigint")).collect():
            dense[u] = v
    return grams, np.unique(dense, return_inverse=True)[1]


# ---- step 4: candidates ----

_STEP4 = [("bucket", pa.int32()), ("part", pa.int32()), ("whole", pa.bool_()), ("dense", pa.binary()), ("classes", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("spread", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())]
_STEP4_DDL = "bucket int, part int, whole boolean, dense binary, classes binary, sizes binary, places binary, spread binary, counts binary, grams binary"


def _spread(grams: np.ndarray) -> np.ndarray:
    """How many of the grams fall into each of FANOUT ranges of their mixed hash."""
    return np.bincount((mix(grams.copy()) >> np.uint64(60)).astype(np.int64), minlength=FANOUT)


def _cell(grams: np.ndarray, cells: int) -> np.ndarray:
    return (mix(grams.copy()) % np.uint64(cells)).astype(np.int64)


def _prefix_counts(cells: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, _ = shared.value
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for g, p in zip(batch.column("grams").to_pylist(), batch.column("prefix").to_pylist()):
                gram = _from_six(g[: 6 * p])
                total += np.bincount(_cell(gram[~_among(gram, heavy)] if len(heavy) else gram, cells), minlength=cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return run


def _prefixes(cells: int, shared_heavy, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, number = shared_heavy.value
        base, parts, keys = shared.value
        for batch in batches:
            rows: list[tuple] = []
            names, sizes = batch.column("class").to_numpy(), batch.column("size").to_numpy()
            sets = [_from_six(g) for g in batch.column("grams").to_pylist()]
            prefix = batch.column("prefix").to_pylist()
            spread = np.array([_spread(g) for g in sets], np.int64).reshape(-1, FANOUT)
            gram = np.concatenate([g[:p] for g, p in zip(sets, prefix)] or [np.zeros(0, np.uint64)])
            owner = np.repeat(np.arange(len(sets)), prefix)
            # place in the full order: the grams that are unique to the class come first
            place = np.concatenate([np.arange(p) + (s - len(g)) for g, p, s in zip(sets, prefix, sizes)] or [np.zeros(0, np.int64)])
            dense = np.full(len(sets), -1, np.int64)
            if len(heavy):
                held = _among(gram, heavy)
                dense[owner[held]] = number[np.searchsorted(heavy, gram[held])]  # all of a class have the same
                gram, owner, place = gram[~held], owner[~held], place[~held]
            cell = _cell(gram, cells)

            def add(group: int, part: int, whole: bool, at: np.ndarray) -> None:
                new = _firsts(owner[at])
                own = owner[at][new]
                rows.append((int(keys[group]), part, whole, _pack(dense[own], "<i4") if dense[own].max() >= 0 else None, _pack(names[own], "<i8"), _pack(sizes[own], "<i4"), _pack(place[at], "<i4"), _counts(spread[own].ravel()), _pack(np.diff(np.append(new, len(at))), "<u4"), _six(gram[at])))

            plain = np.flatnonzero(parts[cell] == 1)
            order = plain[np.argsort(base[cell[plain]], kind="stable")]
            for group, a, b in _spans(base[cell[order]]):
                add(group, 0, True, order[a:b])
            large = np.flatnonzero(parts[cell] > 1)
            for c in np.unique(cell[large]).tolist():
                inside = large[cell[large] == c]
                n, first = int(parts[c]), int(base[c])
                part = (mix(names[owner[inside]].astype(np.uint64)) % np.uint64(n)).astype(np.int64)
                for p in np.unique(part).tolist():
                    for other in range(n):
                        add(group_of_parts(first, n, p, other), p, p == other, inside[part == p])
            yield from _table(rows, _STEP4).to_batches()

    return run


_PAIRS = [("block", pa.int32()), ("classes", pa.binary()), ("counts", pa.binary()), ("partners", pa.binary())]
_PAIRS_DDL = "block int, classes binary, counts binary, partners binary"


def _candidates(blocks: int, keys: np.ndarray, t: float):
    def run(group: pa.Table) -> pa.Table:
        names, sizes, places, spreads, counts, grams, parts, dense = [], [], [], [], [], [], [], []
        whole = group.column("whole")[0].as_py()
        for part, h, c, s, p, d, m, g in zip(*(group.column(x).to_pylist() for x in ("part", "dense", "classes", "sizes", "places", "spread", "counts", "grams"))):
            names.append(np.frombuffer(c, "<i8"))
            parts.append(np.full(len(names[-1]), part, np.int32))
            dense.append(np.frombuffer(h, "<i4") if h is not None else np.full(len(names[-1]), -1, np.int32))
            sizes.append(np.frombuffer(s, "<i4").astype(np.int64))
            places.append(np.frombuffer(p, "<i4").astype(np.int64))
            spreads.append(np.frombuffer(d, f"<u{len(d) // (FANOUT * len(names[-1]))}").reshape(-1, FANOUT))
            counts.append(np.frombuffer(m, "<u4"))
            grams.append(_from_six(g))
        name, size, place, spread, gram, part, together = map(np.concatenate, (names, sizes, places, spreads, grams, parts, dense))
        del sizes, places, spreads, grams, parts, dense, group
        entry = np.repeat(np.arange(len(name)), np.concatenate(counts))
        order = np.argsort(gram, kind="stable")
        gram, entry, place = gram[order], entry[order], place[order]
        new = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        found = np.zeros(0, np.int64)
        size, wide = size[entry], len(name)
        held: list[np.ndarray] = []
        some_dense = bool((together >= 0).any())
        for i, j in pairs_within(new, np.diff(np.append(new, len(gram)))):
            a, b = size[i], size[j]
            need = needed(a, b, t)
            ok = np.minimum(a, b) >= np.ceil(t * np.maximum(a, b) - 1e-9)
            ok &= 1 + np.minimum(a - place[i] - 1, b - place[j] - 1) >= need
            if not whole:
                ok &= part[entry[i]] != part[entry[j]]
            if some_dense:
                ok &= (together[entry[i]] != together[entry[j]]) | (together[entry[i]] < 0)  # the others are in step 6
            x, y = entry[i[ok]], entry[j[ok]]
            key = np.unique(np.minimum(x, y) * wide + np.maximum(x, y))
            held.append(key)
            if sum(map(len, held)) > 4 * AT_ONCE:
                found, held = np.unique(np.concatenate([found, *held])), []
        found = np.unique(np.concatenate([found, *held]))
        rows: list[tuple] = []
        by_block: list[np.ndarray] = []
        total = np.zeros(len(name), np.int64)
        total[entry] = size
        for k in range(0, len(found), AT_ONCE // 8):
            x, y = np.divmod(found[k : k + AT_ONCE // 8], wide)
            ok = np.minimum(spread[x], spread[y]).sum(axis=1) >= needed(total[x], total[y], t)
            x, y = name[x[ok]], name[y[ok]]
            by_block.append(np.stack((np.minimum(x, y), np.maximum(x, y)), 1)[x != y])
        if by_block:
            pairs = np.concatenate(by_block)
            block = block_of(pairs[:, 0] % blocks, pairs[:, 1] % blocks, blocks, keys)
            order = np.lexsort((pairs[:, 1], pairs[:, 0], block))
            pairs, block = pairs[order], block[order]
            new = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))[: len(block)]
            for a, b in zip(new, np.append(new[1:], len(block))):
                first = np.flatnonzero(np.concatenate(([True], pairs[a + 1 : b, 0] != pairs[a : b - 1, 0])))
                rows.append((int(block[a]), _pack(pairs[a:b, 0][first], "<i8"), _counts(np.diff(np.append(first, b - a))), _pack(pairs[a:b, 1], "<i8")))
        return _table(rows, _PAIRS)

    return run


# ---- step 5: verification ----

_WANTED = [("class", pa.int64()), ("block", pa.int32()), ("pairs", pa.binary())]
_WANTED_DDL = "class bigint, block int, pairs binary"


def _distinct_pairs(group: pa.Table) -> pa.Table:
    """A row with the distinct pairs of a block pair (class null), and one for each class that they need."""
    parts = []
    for c, m, p in zip(*(group.column(x).to_pylist() for x in ("classes", "counts", "partners"))):
        own, counts = _unpack(c, m)
        parts.append(np.stack((np.repeat(own, counts), np.frombuffer(p, "<i8")), 1))
    raw = np.concatenate(parts)
    block = group.column("block")[0].as_py()
    raw = raw[np.lexsort((raw[:, 1], raw[:, 0]))]
    pairs = raw[np.concatenate(([True], (raw[1:] != raw[:-1]).any(axis=1)))]
    rows: list[tuple] = [(None, block, _pack(pairs, "<i8"))]
    rows += [(int(c), block, None) for c in np.unique(pairs)]
    return _table(rows, _WANTED)


_VERIFIED = [("class_a", pa.int64()), ("class_b", pa.int64()), ("overlap", pa.int32()), ("jaccard", pa.float64())]
_VERIFIED_DDL = "class_a bigint, class_b bigint, overlap int, jaccard double"
_LINKS_DDL = "class bigint, other bigint, links bigint"


def _verify(t: float, pairwise: bool):
    """Each similar pair; or their spanning forest, and how many documents each class is linked with."""

    def run(group: pa.Table) -> pa.Table:
        sets: dict[int, tuple[int, np.ndarray]] = {}
        copies: dict[int, int] = {}
        pairs = []
        for name, size, n, grams, p in zip(*(group.column(x).to_pylist() for x in ("class", "size", "copies", "grams", "pairs"))):
            if p is not None:
                pairs.append(np.frombuffer(p, "<i8").reshape(-1, 2))
            elif grams is not None:
                sets[name] = size, np.sort(_from_six(grams))
                copies[name] = n
        rows = []
        for a, b in np.concatenate(pairs).tolist() if pairs else ():
            (m, x), (n, y) = sets[a], sets[b]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            if both >= needed(m, n, t):
                rows.append((a, b, both, both / (m + n - both)))
        return _table(rows, _VERIFIED) if pairwise else linked_rows(np.array([r[:2] for r in rows], np.int64).reshape(-1, 2), copies)

    return run


# ---- step 6: classes that heavy grams hold together ----

_DENSE_DDL = "key int, part int, whole boolean, class bigint, size int, copies bigint, grams binary"


def _to_blocks(shared):
    """Each class once for every pair of blocks that its block is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, blocks, keys = shared.value
        for batch in batches:
            dense = batch.column("dense").to_numpy()
            n = blocks[dense]
            part = (mix(batch.column("class").to_numpy().astype(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
            sets = batch.select(["class", "size", "copies", "grams"])
            at = 0
            while at < len(n):
                end = at + max(1, int(np.searchsorted(np.cumsum(n[at:]), DENSE_ROWS, "right")))
                row = np.repeat(np.arange(at, end), n[at:end])
                other = np.arange(len(row)) - np.repeat(np.cumsum(n[at:end]) - n[at:end], n[at:end])
                i, j, wide = np.minimum(part[row], other), np.maximum(part[row], other), n[row]
                key = keys[first[dense[row]] + i * wide - i * (i - 1) // 2 + j - i]  # as group_of_parts
                some = sets.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array(part[row], pa.int32()), pa.array(part[row] == other), *some.columns], names=["key", "part", "whole", *some.schema.names])
                at = end

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first, matrix): how many grams some sets of a, from first on, share with each of b.

    A gram goes by a product of matrices where it is in so many sets that this costs less than its pairs one by one.
    """
    rows, wide = len(a), len(b)
    kinds, gram = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(rows + wide), [len(x) for x in (*a, *b)])
    left = row < rows
    n_a, n_b = np.bincount(gram[left], minlength=len(kinds)), np.bincount(gram[~left], minlength=len(kinds))
    many = n_a * n_b * 100 >= rows * wide
    column = np.cumsum(many) - 1
    x, y = np.zeros((rows, int(many.sum())), np.uint8), np.zeros((wide, int(many.sum())), np.uint8)
    for to, side, less in ((x, left, 0), (y, ~left, rows)):
        at = side & many[gram]
        to[row[at] - less, column[gram[at]]] = 1
    few = ~many & (n_a > 0) & (n_b > 0)
    at = np.flatnonzero(left & few[gram])
    few_row, few_gram = row[at], gram[at]  # row by row
    at = np.flatnonzero(~left & few[gram])
    at = at[np.argsort(gram[at], kind="stable")]
    there, start = row[at] - rows, np.searchsorted(gram[at], np.arange(len(kinds)))
    step = max(1, AT_ONCE // 2 // wide)
    for first in range(0, rows, step):
        last = min(rows, first + step)
        both = np.zeros((last - first, wide), np.float32)  # exact up to 2**24
        for k in range(0, x.shape[1], 1024):
            both += x[first:last, k : k + 1024].astype(np.float32) @ y[:, k : k + 1024].astype(np.float32).T
        i, end = np.searchsorted(few_row, (first, last))
        ends = np.cumsum(n_b[few_gram[i:end]])
        done = 0
        while done < end - i:
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + AT_ONCE // 2, "right")))
            g = few_gram[i + done : i + upto]
            n = n_b[g]
            place = np.repeat(start[g] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both += np.bincount(np.repeat((few_row[i + done : i + upto] - first) * wide, n) + there[place], minlength=both.size).reshape(both.shape)
            done = upto
        yield first, both


def _merged(label: np.ndarray, i: np.ndarray, j: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """label, the least member of each one's tree, after linking i and j where ok has them."""
    while True:
        apart = ok & (label[i][:, None] != label[j])
        rows, columns = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
        if not len(rows):
            return label
        ends = np.concatenate((label[i[rows]], label[j[columns]])), np.concatenate((label[j[apart[rows].argmax(axis=1)]], label[i[apart[:, columns].argmax(axis=0)]]))
        to = np.arange(len(label))
        for x, least in forest(np.unique(np.stack(ends, 1), axis=0)):
            to[x] = least
        label = to[label]


def _verify_dense(t: float, pairwise: bool):
    """As _verify, of all pairs between two blocks or within one."""

    def run(group: pa.Table) -> pa.Table:
        part, name, size, copies = (group.column(x).to_numpy() for x in ("part", "class", "size", "copies"))
        whole = group.column("whole")[0].as_py()
        sets = [_from_six(g) for g in group.column("grams").to_pylist()]
        size = size.astype(np.int64)
        a = np.flatnonzero(part == part.min())
        b = a if whole else np.flatnonzero(part != part.min())
        label, links = np.arange(len(name)), np.zeros(len(name), np.int64)
        pairs: list[np.ndarray] = []
        for first, both in overlaps([sets[k] for k in a], [sets[k] for k in b]) if len(b) else ():
            i = a[first : first + len(both)]
            ok = both >= needed(size[i][:, None], size[b], t)
            if whole:
                ok &= i[:, None] < b
            if pairwise:
                x, y = np.nonzero(ok)
                pairs.append(np.stack((i[x], b[y], both[x, y].astype(np.int64))))
                continue
            n = ok.astype(np.float64)  # sums below 2**53 are exact
            links[i] += (n @ copies[b]).astype(np.int64)
            links[b] += (copies[i] @ n).astype(np.int64)
            label = _merged(label, i, b, ok)
        if pairwise:
            x, y, both = np.concatenate([np.zeros((3, 0), np.int64), *pairs], axis=1)
            return pa.table({"class_a": np.minimum(name[x], name[y]), "class_b": np.maximum(name[x], name[y]), "overlap": both.astype(np.int32), "jaccard": both / (size[x] + size[y] - both)})
        x, y = np.flatnonzero(label != np.arange(len(name))), np.flatnonzero(links)
        none = pa.nulls
        return pa.table(
            {
                "class": np.concatenate((name[x], name[y])),
                "other": pa.concat_arrays([pa.array(name[label[x]]), none(len(y), pa.int64())]),
                "links": pa.concat_arrays([none(len(x), pa.int64()), pa.array(links[y])]),
            }
        )

    return run


def _dense_links(dense: DataFrame, weights: DataFrame, numbers: int, t: float, pairwise: bool) -> DataFrame:
    """dense: as of _held_together(), with numbers below `numbers`; it is read twice."""
    rows = DENSE_ROWS // 4 if pairwise else DENSE_ROWS
    blocks = np.ones(numbers, np.int64)
    for number, n, size in dense.groupBy("dense").agg(F.count("class"), F.sum(F.octet_length("grams"))).collect():
        blocks[number] = max(math.ceil(n / rows), math.ceil(size / DENSE_BYTES))
    groups = blocks * (blocks + 1) // 2
    total = int(groups.sum())
    parted = min(total, DENSE_PARTITIONS)
    shared = dense.sparkSession.sparkContext.broadcast((np.cumsum(groups) - groups, blocks, spread_keys(total, parted)))
    placed = dense.join(weights, "class").select("dense", "class", "size", "copies", "grams").mapInArrow(lean(_to_blocks(shared)), _DENSE_DDL)
    return placed.repartition(parted, "key").groupBy("key").applyInArrow(lean(_verify_dense(t, pairwise)), _VERIFIED_DDL if pairwise else _LINKS_DDL)


# ---- the join ----


def _ranges(size: int, share: int) -> int:
    """Groups for so many bytes of text; beyond some TB fewer, larger ones, as a row from one group to another then holds few grams."""
    return max(8, min(math.ceil(size / share), math.isqrt(max(0, size) // 384)))


def classes(docs: DataFrame, n: int = N, t: float = THRESHOLD, share: int = RANGE_BYTES, hot: int = HOT, heavy: int = HEAVY) -> DataFrame:
    """doc_id, class of all documents; and class, size, grams, prefix, light, with a null doc_id, of the classes that may have a partner."""
    names = {c.lower(): F.col(quoted(c)) for c in docs.columns}
    source = docs.select(names["doc_id"].cast("long").alias("doc_id"), names["text"].cast("string").alias("text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = own_partitions(_ranges(size, share))
    packed = source.mapInArrow(lean(_by_range(ranges, n, max(SLICE, 384 * len(ranges)), hot)), _STEP1_DDL)
    repeated = packed.repartition(len(ranges), "bucket").groupBy("bucket").applyInArrow(lean(_repeated(ranges)), _STEP2_DDL)
    return repeated.repartition(len(ranges), "part").groupBy("part").applyInArrow(lean(_assemble(t, heavy)), _STEP3_DDL)


def similar_classes(found: DataFrame, t: float = THRESHOLD, pairwise: bool = True, most: int = PAIR_ROWS, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame]:
    """(class_a, class_b, overlap, jaccard of the classes() that are similar, or what linked() needs instead; what is persisted for it).

    found is read several times: cut its lineage first. heavy: as in classes().
    """
    spark = found.sparkSession
    joining = found.filter("doc_id is null").select("class", "size", "grams", "prefix", "light")
    weights = found.filter("doc_id is not null").groupBy("class").agg(F.count("doc_id").alias("copies"))
    entries, size = joining.agg(F.coalesce(F.sum("prefix"), F.lit(0)), F.coalesce(F.sum(F.octet_length("grams")), F.lit(0))).first()
    grams, numbers = heavy_grams(joining, heavy)
    held = spark.sparkContext.broadcast((grams, numbers))
    cells = max(64, 8 * math.ceil(entries / most))
    counts = np.zeros((1, cells), np.int64)
    for cell, n in joining.select("grams", "prefix").mapInArrow(lean(_prefix_counts(cells, held)), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n")).collect():
        counts[0, cell] = n
    base, parts = layout(counts, max(1, min(most, entries // 16)))
    groups = int((base + parts * (parts + 1) // 2).max())
    shared = spark.sparkContext.broadcast((base[0], parts[0], own_partitions(groups)))
    blocks = max(4, math.ceil(2 * size / BLOCK_BYTES))
    prefixes = joining.mapInArrow(lean(_prefixes(cells, held, shared)), _STEP4_DDL).repartition(groups, "bucket")
    keys, parted = block_keys(blocks)
    pairs = prefixes.groupBy("bucket").applyInArrow(lean(_candidates(blocks, keys, t)), _PAIRS_DDL)
    wanted = pairs.repartition(parted, "block").groupBy("block").applyInArrow(lean(_distinct_pairs), _WANTED_DDL).persist(StorageLevel.DISK_ONLY)
    sets = wanted.filter("class is not null").select("class", "block").join(joining.select("class", "size", "grams").join(weights, "class"), "class")
    nothing = F.lit(None)
    together = sets.select("block", "class", "size", "copies", "grams", nothing.cast("binary").alias("pairs")).union(
        wanted.filter("class is null").select("block", "class", nothing.cast("int").alias("size"), nothing.cast("bigint").alias("copies"), nothing.cast("binary").alias("grams"), "pairs")
    )
    verified = together.repartition(parted, "block").groupBy("block").applyInArrow(lean(_verify(t, pairwise)), _VERIFIED_DDL if pairwise else _LINKS_DDL)
    if len(grams):
        dense = settled(joining.filter("light < prefix").mapInArrow(lean(_held_together(held)), "dense int, class bigint, size int, grams binary"))
        verified = verified.union(_dense_links(dense, weights, int(numbers.max()) + 1, t, pairwise))
    return verified, wanted


def similar_documents(docs: DataFrame, n: int = N, t: float = THRESHOLD, **sizes: int) -> DataFrame:
    """doc_id, class_id, n_links: one row for each document that is similar to another.

    class_id is the smallest doc_id that similar pairs lead to, directly or not, and n_links the number of documents that
    are similar to this one. sizes: share, hot and heavy as in classes(), most as in similar_classes().
    """
    most = sizes.pop("most", PAIR_ROWS)
    found = settled(classes(docs, n, t, **sizes))
    verified, held = similar_classes(found, t, False, most, sizes.get("heavy", HEAVY))
    verified = settled(verified)
    held.unpersist()
    members = found.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "class")
    return linked(members, verified).withColumnRenamed("id", "doc_id")


def similar_pairs(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(class_a, class_b, overlap, jaccard of every two similar sets; doc_id, class of every document): the join itself, copies not multiplied out."""
    found = settled(classes(docs, n, t))
    return similar_classes(found, t)[0], found.filter("doc_id is not null").select("doc_id", "class")


#: Bytes of ids, 8 each, up to which they are sent to every executor instead of shuffling the texts.
BROADCAST_BYTES = 64 << 20


def drop_similar(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """docs without all but the smallest id of each group that similar pairs link, all columns as they were.

    An id is one document, whatever number of rows it has: they stay or go
    together. Rows that take part in nothing (no id, no words) stay.
    """
    other = fresh_name("surplus_id", docs.columns)
    gone = settled(similar_documents(docs, n, t).filter("doc_id != class_id").select(F.col("doc_id").alias(other)))
    name = next(c for c in docs.columns if c.lower() == "doc_id")
    if gone.count() * 8 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(quoted(name)).cast("long") == F.col(other), "left_anti")
