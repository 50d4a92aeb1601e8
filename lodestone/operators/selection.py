"""Exact percentiles by distributed selection.

A rank's range starts as its group's least and greatest value. In each round the values within a range are counted by PARTS equal
parts of it, with the least and greatest value of each part; counts are added up in the tasks before they are shuffled, so a round moves at most PARTS small rows a
range and task, whatever the size of the groups. The part that holds the rank gives the next range, by its own least and
greatest value, until these are equal. Every third round parts by sign and exponent instead, so that values of all scales need few rounds as well. No
task holds a group, and ranges that are found leave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

PARTS = 4096
_LARGEST = 1.7976931348623157e308


def _part(x: Column, lo: Column, hi: Column) -> Column:
    """The part of lo..hi that x lies in: it never falls as x grows, whatever rounding does. Infinite values have parts of their own."""
    low, high = F.greatest(lo, F.lit(-_LARGEST)) / 2, F.least(hi, F.lit(_LARGEST)) / 2
    at = F.floor((x / 2 - low) / (high - low) * PARTS)
    inside = F.when(high > low, F.least(at, F.lit(PARTS).cast("long"))).otherwise(F.lit(0).cast("long"))
    return F.when(x == float("inf"), F.lit(PARTS + 1).cast("long")).when(x == float("-inf"), F.lit(-1).cast("long")).otherwise(inside)


def _octave(x: Column) -> Column:
    """The sign and exponent of x in one number, which never falls as x grows."""
    size = F.least(F.log2(F.greatest(F.abs(x), F.lit(5e-324))), F.lit(1100.0))
    at = F.floor(size).cast("long") + 1100
    return F.when(x > 0, at).when(x < 0, -at).otherwise(F.lit(0).cast("long"))


def percentiles(df: DataFrame, by: list[str], value: str, points=(0.5, 0.95, 0.99)) -> DataFrame:
    """by and p50, p95, ...: the percentiles of each group, between two values in proportion to where they lie. Nulls and NaN take no part; groups
    without other values have null percentiles."""
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*keys, F.col(value).cast("double").alias("_x"))
    real = rows.where("_x IS NOT NULL AND NOT isnan(_x)")
    groups = stored(real.groupBy(*names).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")), "groups")
    place = [(F.col("_n") - 1) * F.lit(float(p)) for p in points]
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in place])))
    # a range with the ranks in it, counted from its own start
    going = groups.select(*names, F.explode(wanted).alias("_rank"), F.lit(0).cast("long").alias("_before"), "_lo", "_hi")
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names], F.lit(True))
    found, rounds = None, 0
    while True:
        done = going.where("_lo = _hi").select(*names, "_rank", F.col("_lo").alias("_v"))
        found = done if found is None else found.unionByName(done)
        going = going.where("_lo < _hi")
        if going.isEmpty():
            break
        rounds += 1
        part = _octave(F.col("_x")) if rounds % 3 == 0 else _part(F.col("_x"), F.col("_lo"), F.col("_hi"))
        ranges = going.select(*names, "_lo", "_hi").distinct()
        inside = real.alias("r").join(ranges.alias("g"), same("r", "g") & (F.col("_x") >= F.col("g._lo")) & (F.col("_x") <= F.col("g._hi")))
        inside = inside.select(*[F.col(f"g.{c}") for c in names], F.col("g._lo").alias("_lo"), F.col("g._hi").alias("_hi"), "_x")
        counts = inside.groupBy(*names, "_lo", "_hi", part.alias("_part")).agg(F.count("*").alias("_c"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        order = Window.partitionBy(*names, "_lo", "_hi").orderBy("_part")  # at most PARTS + 3 rows a range
        counts = counts.withColumn("_end", F.sum("_c").over(order))
        on = same("t", "c") & (F.col("t._lo") == F.col("c._lo")) & (F.col("t._hi") == F.col("c._hi"))
        rank = F.col("t._rank") - F.col("t._before")
        hit = going.alias("t").join(counts.alias("c"), on & (rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_c")))
        going = stored(hit.select(*[F.col(f"t.{c}") for c in names], "_rank", (F.col("_before") + F.col("_end") - F.col("_c")).alias("_before"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi")), "ranges")
    at = groups.select(*names, "_n", F.posexplode(F.array(*place)).alias("_p", "_h"))
    ends = found.alias("v").join(at.alias("a"), same("v", "a") & ((F.col("_rank") == F.floor("_h")) | (F.col("_rank") == F.ceil("_h"))))
    low, high = F.max(F.when(F.col("_rank") == F.floor("_h"), F.col("_v"))), F.max(F.when(F.col("_rank") == F.ceil("_h"), F.col("_v")))
    share = F.max(F.col("_h") - F.floor("_h"))
    mixed = F.when(low == high, low).otherwise(low * (1 - share) + high * share)
    each = ends.groupBy(*[F.col(f"a.{c}") for c in names], "_p").agg(mixed.alias("_v"))
    wide = each.groupBy(*names).agg(*[F.max(F.when(F.col("_p") == i, F.col("_v"))).alias(f"p{round(p * 100)}") for i, p in enumerate(points)])
    every = rows.select(*names).distinct() if names else None
    if every is not None:
        wide = every.alias("e").join(wide.alias("w"), same("e", "w"), "left").select(*[F.col(f"e.{c}") for c in names], *[f"p{round(p * 100)}" for p in points])
    return wide.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(by)], *[f"p{round(p * 100)}" for p in points])
