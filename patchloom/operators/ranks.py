"""Places in a total order without one task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchloom.sources.saved import saved


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "place", ranges: int | None = None) -> DataFrame:
    """``rows`` with their place, from 0 on, in ``order`` within each group of ``by``; rows that tie in ``order`` are numbered in any way.

    Rows are dealt into ranges of (by, order) and sorted there, and saved with their place in their range, so that numbers don't hang
    on a second reading. The ranges' sizes are added up (a row a range and group), and a row's place is what lies before its range
    and before it. Rows are dealt once and sorted once. Nulls come first.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, part, first, before = "__at", "__range", "__first", "__before"
    columns = [F.col(c) for c in by + order]
    sorted_rows = rows.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    marked = sorted_rows.withColumn(at, F.monotonically_increasing_id())  # the partition above 33 bits, the place in it below
    dealt = saved(marked.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    sizes = dealt.groupBy(*by, part).agg(F.count("*").alias("__size"), F.min(at).alias(first))
    earlier = Window.partitionBy(*[F.col(c) for c in by], F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum("__size").over(earlier), F.lit(0))).drop("__size")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, part)]
    joined = dealt.alias("a").join(F.broadcast(sizes.alias("b")) if not by else sizes.alias("b"), same).select("a.*", f"b.{first}", f"b.{before}")
    return joined.withColumn(name, (F.col(before) + F.col(at) - F.col(first)).cast("long")).drop(at, part, first, before)
