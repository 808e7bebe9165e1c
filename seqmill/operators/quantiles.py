"""Exact quantiles of large groups, by counting: no group is ever held in one buffer.

Each place that is asked for has a range of values in which it lies, at first that of its group. A
round cuts every range into ``CUTS`` buckets, counts them (in the tasks that read the rows first, so
that at most ``CUTS`` rows of a range leave a task), and takes the bucket that holds the place; its own
least and largest value are the next range. A range of one value is the answer. Values at least halve
their spread ``log2(CUTS)`` times in a round, so a few rounds do; each reads the rows once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmill.operators import corpus
from seqmill.session import fresh, stored

CUTS = 1 << 12


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and a double column for each of ``shares`` (name -> share from 0 to 1), between two values their mean by distance.

    Nulls and NaN do not count; a group without values has no row. No keys: one group.
    """
    place, low, high, bucket, at, before, n = fresh("place", "low", "high", "bucket", "at", "before", "n")
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*[F.col(f"`{k}`") for k in keys], v.alias(at)).where(F.col(at).isNotNull() & ~F.isnan(at))
    sizes = stored(rows.groupBy(*keys).agg(F.count("*").alias(n), F.min(at).alias(low), F.max(at).alias(high)).where(F.col(n) > 0), "ranges")
    wanted = F.array(*[F.floor((F.col(n) - 1) * s).cast("long") + k for s in sorted(set(shares.values())) for k in (0, 1)])
    places = F.array_distinct(F.transform(wanted, lambda p: F.least(p, F.col(n) - 1)))
    # ``before`` rows of the group lie below the range; an open range still has more than one value
    open_ends = stored(sizes.select(*keys, F.explode(places).alias(place), low, high, F.lit(0).cast("long").alias(before)), "ranges")
    done = open_ends.where(F.col(low) == F.col(high))
    open_ends = open_ends.where(F.col(low) < F.col(high))
    while open_ends.limit(1).count():
        if keys:  # a null key is a group like any other
            same = [f"{k}_{place}" for k in keys]
            ranges = open_ends.select(*[F.col(f"`{k}`").alias(s) for k, s in zip(keys, same, strict=True)], place, low, high, before)
            on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{s}`")) for k, s in zip(keys, same, strict=True)]
            joined = rows.join(corpus.small(ranges), on).drop(*same)
        else:
            joined = rows.crossJoin(F.broadcast(open_ends))  # as many rows as shares, twice
        inside = joined.where(F.col(at).between(F.col(low), F.col(high)))
        width, beyond = F.col(high) - F.col(low), F.col(at) - F.col(low)
        halved = (F.col(at) / 2 - F.col(low) / 2) / (F.col(high) / 2 - F.col(low) / 2)  # for ranges wider than a double
        cut = F.least(F.lit(CUTS - 1), F.floor(F.when(width < float("inf"), beyond / width).otherwise(halved) * CUTS).cast("int"))
        cut = F.when(F.col(at) == F.col(high), CUTS - 1).otherwise(cut)
        counted = inside.groupBy(*keys, place, before, cut.alias(bucket)).agg(F.count("*").alias(n), F.min(at).alias(low), F.max(at).alias(high))
        w = W.partitionBy(*keys, place).orderBy(bucket)  # CUTS rows at most
        below = F.col(before) + F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        found = counted.withColumn(before, below).where((F.col(before) <= F.col(place)) & (F.col(place) < F.col(before) + F.col(n)))
        found = stored(found.select(*keys, place, low, high, before), "ranges")
        done = done.unionByName(found.where(F.col(low) == F.col(high)))
        open_ends = found.where(F.col(low) < F.col(high))
    values = done.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(place, low))).alias(at))  # two places for each share
    if keys:
        same = [f"{k}_{n}" for k in keys]
        all_sizes = sizes.select(*[F.col(f"`{k}`").alias(s) for k, s in zip(keys, same, strict=True)], n)
        both = values.join(all_sizes, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{s}`")) for k, s in zip(keys, same, strict=True)])
    else:
        both = values.crossJoin(F.broadcast(sizes.select(n)))  # one row each

    def share(s: float):
        exact = (F.col(n) - 1) * s
        lower = F.floor(exact).cast("long")
        x, y = F.element_at(at, lower), F.element_at(at, F.least(lower + 1, F.col(n) - 1))
        return x + (y - x) * (exact - lower)

    return both.select(*[F.col(f"`{k}`") for k in keys], *[share(s).alias(name) for name, s in shares.items()])
