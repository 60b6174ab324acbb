"""Exact nearest-rank percentiles by narrowing histograms: counts of buckets, never an order of values.

A round counts the values of every open range in equal buckets, with each bucket's smallest and largest value, all sums that merge. The
bucket that holds the wanted place is the next range. As it runs from a value to a value, it is done when the two are one, and a
range that isn't done always splits. All groups and shares narrow in the same pass; two or three passes are usual.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.sources.saved import saved

#: Buckets of a range, and rounds that no 64-bit values can need.
BUCKETS, MAX_ROUNDS = 4096, 80


def nearest_rank(rows: DataFrame, value: str, shares: dict[str, float], by: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``by``, n and a column for each share: the value at place ceil(n * share) of the group's values, to 2 decimals.

    Null values don't count; NaN is above all others, as Spark orders it, and infinities are values. Null groups are groups. A group
    without a value gives no row. A share lies in (0, 1]: the place is 1 at least.
    """
    if any(not 0 < p <= 1 for p in shares.values()):
        raise ValueError("a share lies in (0, 1]")
    keys = [f"__g{k}" for k in range(len(by))]
    each = rows.filter(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("v"))
    finite = F.when(~F.isnan("v") & (F.abs("v") < math.inf), F.col("v"))
    n = each.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.min(finite), F.lit(0.0)).alias("low"), F.coalesce(F.max(finite), F.lit(0.0)).alias("high"))
    place = lambda p: F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p))).cast("long")
    wanted = F.array(*[F.struct(F.lit(name).alias("share"), place(p).alias("place")) for name, p in shares.items()])
    open_ = n.filter("n > 0").withColumn("w", F.explode(wanted)).select(*keys, "n", "w.*", "low", "high", F.lit(0).cast("long").alias("before"))
    same = lambda a, b, cs: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cs]
    done: list[DataFrame] = []
    for step in range(MAX_ROUNDS):
        ranges = open_.groupBy(*keys).agg(F.collect_set(F.struct("low", "high")).alias("ranges"))  # no more than there are shares
        inside = lambda r: F.lit(True) if step == 0 else F.col("v").between(r["low"], r["high"])  # noqa: B023, E731
        met = each.alias("a").join(ranges.alias("b"), same("a", "b", keys), "inner") if keys else each.alias("a").withColumn("__k", F.lit(1)).join(F.broadcast(ranges.withColumn("__k", F.lit(1)).alias("b")), "__k")
        met = met.select(*[F.col(f"a.{k}") for k in keys], F.col("a.v"), F.explode(F.filter("b.ranges", inside)).alias("r")).select(*keys, "v", "r.*")
        scale = F.when(F.col("high") - F.col("low") == math.inf, 0.5).otherwise(1.0)  # differences of halves don't overflow
        slot = F.floor(F.try_divide(F.col("v") * scale - F.col("low") * scale, F.col("high") * scale - F.col("low") * scale) * buckets)
        slot = F.when(F.isnan("v"), buckets + 1).when(F.col("v") == math.inf, buckets).when(F.col("v") == -math.inf, -1).when(F.col("high") <= F.col("low"), 0).otherwise(F.least(F.lit(buckets - 1), slot))
        counted = met.groupBy(*keys, "low", "high", slot.cast("int").alias("slot")).agg(F.count("*").alias("c"), F.min("v").alias("next_low"), F.max("v").alias("next_high"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "low", "high").orderBy("slot"))
        counted = counted.withColumn("upto", upto)
        ends = [*keys, "low", "high"]
        hit = open_.alias("a").join(counted.alias("b"), same("a", "b", ends)).filter((F.col("a.before") + F.col("b.upto") >= F.col("a.place")) & (F.col("a.before") + F.col("b.upto") - F.col("b.c") < F.col("a.place")))
        chosen = saved(hit.select(*[F.col(f"a.{k}") for k in keys], "a.n", "a.share", "a.place", F.col("b.next_low").alias("low"), F.col("b.next_high").alias("high"), (F.col("a.before") + F.col("b.upto") - F.col("b.c")).alias("before")), "ranges")
        settled = F.col("low").eqNullSafe(F.col("high"))
        done.append(chosen.filter(settled))
        open_ = chosen.filter(~settled)
        if open_.isEmpty():
            break
    else:
        raise RuntimeError("percentiles did not settle")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    out = found.groupBy(*keys, "n").agg(*[F.round(F.max(F.when(F.col("share") == name, F.col("low"))), 2).alias(name) for name in shares])
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "n", *shares)
