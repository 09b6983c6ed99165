"""The value at a rank of a column: exact, by counting rows in ever narrower ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a range that are counted at once; as many rows come to the driver in a pass.
PARTS = 4096


def quantile(df: DataFrame, value: Column, share: float) -> int | None:
    """The smallest value that this share of the rows, at least, don't exceed; None without rows. Nulls don't count.

    For whole numbers that are less than 2**63 apart. No row is moved, and a task holds a count for each part: the
    scans follow from the range (a year of microseconds takes at most five), not from the rows.
    """
    v = F.col("__mr_value")
    values = df.select(value.cast("long").alias("__mr_value"))
    low, high, n = values.agg(F.min(v), F.max(v), F.count(v)).first()
    if not n:
        return None
    rank = max(1, math.ceil(n * share))
    while low < high:
        width = (high - low) // PARTS + 1
        part = F.call_function("div", v - F.lit(low).cast("long"), F.lit(width).cast("long"))
        counted = values.filter(v.between(low, high)).groupBy(part.alias("part")).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))
        for r in sorted(counted.collect()):
            if rank <= r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
        else:
            raise RuntimeError("the rows changed while they were counted")
    return low
