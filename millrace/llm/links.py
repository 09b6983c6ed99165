"""What the similarity joins share: pairs within groups, connected components, and one row for each linked row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import lean

#: Most pairs that are formed at once.
AT_ONCE = 2_000_000


def pairs_within(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with i < j for all two members of each run starts[k], sizes[k], in bounded slices."""
    for size in np.unique(sizes[sizes > 1]):
        at = starts[sizes == size]
        if size <= 64:
            a, b = np.triu_indices(size, 1)
            step = max(1, AT_ONCE // len(a))
            for k in range(0, len(at), step):
                some = at[k : k + step, None]
                yield (some + a).ravel(), (some + b).ravel()
        else:
            for first in at:
                i = 0
                while i < size - 1:
                    rows = max(1, min(size - 1 - i, AT_ONCE // size))
                    a = np.repeat(np.arange(i, i + rows), size - 1 - np.arange(i, i + rows))
                    ends = np.cumsum(size - 1 - np.arange(i, i + rows))
                    b = np.arange(len(a)) - np.repeat(ends - (size - 1 - np.arange(i, i + rows)), size - 1 - np.arange(i, i + rows)) + a + 1
                    yield first + a, first + b
                    i += rows


def settled(df: DataFrame) -> DataFrame:
    """df computed once and written to spark.checkpoint.dir, which all executors share; on one machine a local folder stands in where none is set."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="millrace-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def layout(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first group, parts) of each cell of each table: neighbours share a group up to `most`; a larger cell has parts * (parts + 1) / 2 groups."""
    base, parts = np.zeros(counts.shape, np.int64), np.ones(counts.shape, np.int64)
    group = -1
    for t, row in enumerate(counts.tolist()):
        held = None  # of the group that is being filled; tables share none
        for c, n in enumerate(row):
            if n > most:
                parts[t, c] = -(-n // most)
                base[t, c], held = group + 1, None
                group += int(parts[t, c] * (parts[t, c] + 1) // 2)
            else:
                if held is None or held + n > most:
                    group, held = group + 1, 0
                base[t, c] = group
                held += n
    return base, parts


def group_of_parts(first: int, n: int, a: int, b: int) -> int:
    """The group that pairs parts a and b of a cell of n parts."""
    i, j = min(a, b), max(a, b)
    return first + i * n - i * (i - 1) // 2 + j - i


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash of int values (MurmurHash3, 32 bits, seed 42), by which it picks the partition of a key."""
    with np.errstate(over="ignore"):
        k = x.astype(np.int32).view(np.uint32) * np.uint32(0xCC9E2D51)
        k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
        h = np.uint32(42) ^ k
        h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        return (h ^ h >> np.uint32(16)).view(np.int32)


def spread_keys(n: int, partitions: int) -> np.ndarray:
    """n different ints of which repartition(partitions, int column) sends the k-th to one partition for each k % partitions: all get equally many."""
    each, tried = -(-n // partitions), max(64, 4 * n)
    while True:
        place = spark_hash(np.arange(tried)).astype(np.int64) % partitions
        if np.bincount(place, minlength=partitions).min() >= each:
            order = np.argsort(place, kind="stable")
            starts = np.searchsorted(place[order], np.arange(partitions))
            k = np.arange(n)
            return order[starts[k % partitions] + k // partitions].astype(np.int32)
        tried *= 2


def own_partitions(n: int) -> np.ndarray:
    """n ints that repartition(n, int column) sends to n different partitions: no task gets two groups, and none stays idle."""
    return spread_keys(n, n)


def block_keys(blocks: int) -> tuple[np.ndarray, int]:
    """(the key of each pair of blocks, as block_of numbers them; the partitions they are spread over)."""
    pairs = blocks * (blocks + 1) // 2
    partitions = min(pairs, 4 * blocks)
    return spread_keys(pairs, partitions), partitions


def block_of(a: np.ndarray, b: np.ndarray, blocks: int, keys: np.ndarray) -> np.ndarray:
    """The key of the pair of blocks in which a and b are, in whatever order."""
    i, j = np.minimum(a, b), np.maximum(a, b)
    return keys[i * blocks - i * (i - 1) // 2 + j - i]


def forest(edges: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, as (node, smallest node of its tree) of every node that isn't the smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges.tolist():
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent if root(x) != x]


def linked_rows(pairs: np.ndarray, copies: dict[int, int]) -> pa.Table:
    """class, other, links: the forest of the similar pairs (other set), and of each class the number of rows in its partners."""
    rows: list[tuple] = [(u, v, None) for u, v in forest(pairs)]
    both = np.concatenate((pairs, pairs[:, ::-1]))
    if len(both):
        own, at = np.unique(both[:, 0], return_inverse=True)
        total = np.bincount(at, weights=[copies[x] for x in both[:, 1].tolist()]).astype(np.int64)
        rows += [(c, None, n) for c, n in zip(own.tolist(), total.tolist())]
    columns = list(zip(*rows)) if rows else [[]] * 3
    return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(("class", "other", "links"), columns)})


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.stack([c.to_numpy() for c in b.columns], 1) for b in batches if b.num_rows]
    edges = forest(np.concatenate(held)) if held else []
    if edges:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], names=["u", "v"])


#: Edges, of 16 bytes, that one task takes: some 100 MB as Python has them.
FEW_EDGES = 500_000


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """u, v: every node of the edges that isn't the smallest of its connected component, with the smallest.

    Trees within partitions first. What is left of up to FEW_EDGES is joined in one task; beyond, rounds of large-star and
    small-star (Kiveris et al., 2014) go on until the edges stay the same.
    """
    edges = settled(edges.toDF("u", "v").filter("u != v").mapInArrow(lean(_local_forest), "u bigint, v bigint"))
    state = None
    while True:
        sums = edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == state or not sums[0]:
            return edges
        if sums[0] <= few:
            return edges.repartition(1).mapInArrow(lean(_local_forest), "u bigint, v bigint")
        state = tuple(sums)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = settled(small.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def linked(members: DataFrame, verified: DataFrame) -> DataFrame:
    """id, class_id, n_links: one row for each member that has a link.

    members: the distinct (id, class); verified: rows as of linked_rows(), in any number of parts. Members of one
    class are linked with each other. class_id is the smallest id that links lead to, directly or
    not; the classes of one id belong together. n_links counts the other members of its classes and of their partners.
    """
    several = members.groupBy("id").agg(F.min("class").alias("least"), F.count("class").alias("n")).filter("n > 1")
    edges = verified.filter("other is not null").select("class", "other").union(members.join(several, "id").filter("class != least").select("class", "least"))
    roots = components(edges).select(F.col("u").alias("class"), "v")
    counts = verified.filter("other is null").groupBy("class").agg(F.sum("links").alias("links"))
    sizes = members.groupBy("class").agg(F.count("id").alias("copies"), F.min("id").alias("first"))
    known = sizes.join(roots, "class", "left").join(counts, "class", "left").select("class", F.coalesce("v", "class").alias("root"), "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    least = known.groupBy("root").agg(F.min("first").alias("class_id"))
    named = known.filter("links > 0").join(least, "root").select("class", "class_id", "links")
    return members.join(named, "class").groupBy("id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("n_links"))
