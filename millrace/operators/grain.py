"""Whether a key is unique in a table: exact, in one aggregation that spills, or several within a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError

EXAMPLES = 3
HASH_BYTES, SHARE = 8, 7 / 8


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count; two nulls are a repeat."""
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check(df: DataFrame, keys: list[str], what: str = "the target", memory: int | None = None) -> int:
    """Raises SchemaError, with examples, if a key has several rows; the number of passes it took.

    One aggregation that spills; with `memory`, as many as hashes alone would need in it, each over the keys
    whose hash falls into its share, so that nothing has to spill.
    """
    only = df.select(*[F.col(f"`{k}`") for k in keys])
    n = passes(only.count(), memory) if memory else 1
    for k in range(n):
        part = only if n == 1 else only.filter(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in keys]), F.lit(n)) == k)
        found = duplicates(part, keys).limit(EXAMPLES).collect()
        if found:
            some = "; ".join(f"{', '.join(f'{c}={r[c]!r}' for c in keys)} ({r['n']} rows)" for r in found)
            raise SchemaError(f"{what} has several rows for one {', '.join(keys)}: {some}")
    return n


def passes(rows: int, memory: int) -> int:
    """How many passes a check by hashes takes in this memory."""
    a_pass = max(1, int(memory * SHARE) // HASH_BYTES)
    return max(1, -(-rows // a_pass))
