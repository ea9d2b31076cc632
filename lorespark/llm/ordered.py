"""Buckets of neighbouring keys of about equal size, as a pure function of the key.

The bounds are percentiles of the key over all rows, so clustered or sparse keys spread evenly; a task that is run again
puts a row where it was, which sampling range partitioners don't promise from one execution to the next.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def order_key(name: str = "doc_id") -> Column:
    """The key to order by: a null comes first."""
    return F.coalesce(F.col(name).cast("long"), F.expr("-9223372036854775807L - 1L"))


def bounds(df: DataFrame, key: Column, buckets: int) -> list[int]:
    """At most buckets - 1 bounds, ascending; bucket b holds the keys from bound b on."""
    if buckets < 2:
        return []
    at = ",".join(f"{k / buckets!r}D" for k in range(1, buckets))
    got = df.select(key.alias("key")).agg(F.expr(f"percentile_approx(key, array({at}), {max(10_000, 20 * buckets)})")).first()[0]
    return sorted(set(got or []))


def bucket(key: Column, cuts: list[int]) -> Column:
    """The bucket of a key: how many bounds are not above it, searched in two steps."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    at_most = lambda values: F.size(F.filter(values, lambda b: b <= key))
    top = at_most(_longs([g[0] for g in groups]))
    within = F.expr("array(" + ",".join(_sql(g) for g in groups) + ")")
    return F.when(top == 0, 0).otherwise((top - 1) * step + at_most(F.element_at(within, top)))


def _sql(values: list[int]) -> str:
    return "array(" + ",".join(f"{v}L" if v > LOWEST else "-9223372036854775807L - 1L" for v in values) + ")"


def _longs(values: list[int]) -> Column:
    return F.expr(_sql(values))
