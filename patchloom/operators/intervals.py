"""Spans of lines without a row for every line: each as the fewest dyadic blocks, some two for each doubling of its length.

A block (level, number) is the lines from number * 2**level on, 2**level of them. A line lies in one block of each level, so a line meets the
spans that hold it by keys alone, and two spans that share a line meet where a block of one lies in a block of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of blocks: lines below 2**31.
LEVELS = 31


def _width(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def blocks(start: Column, end: Column) -> Column:
    """The blocks (level, number) that make up the lines from ``start`` to ``end``, both included; none if the span is empty or begins below 0."""

    def at(level: Column) -> Column:
        width = _width(level)
        low, high = F.ceil(start / width).cast("long"), F.floor((end + F.lit(1).cast("long")) / width).cast("long")
        left = F.when((low < high) & (low % 2 == 1), F.struct(level.alias("level"), low.alias("number")))
        right = F.when((F.when(low % 2 == 1, low + 1).otherwise(low) < high) & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).alias("number")))
        return F.array(left, right)

    made = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at)))
    return F.when((start >= 0) & (start <= end), made).otherwise(F.slice(made, 1, 0))


def blocks_around(line: Column, levels: int = LEVELS) -> Column:
    """The blocks (level, number) that hold a line, one of each level."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(level.alias("level"), F.floor(line / _width(level)).cast("long").alias("number")))


def holding(points: DataFrame, line: str, spans: DataFrame, key: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """``points`` with the columns of each span of ``spans`` of the same ``key`` that holds their ``line``; spans of a key may overlap.

    A span is some two rows for each doubling of its length, a point one row for each level that any span has. Null lines and keys,
    and spans that end before they begin, meet nothing. The other columns of the two sides must differ.
    """
    each = spans.withColumn("__b", F.explode(blocks(F.col(start).cast("long"), F.col(end).cast("long")))).select(*spans.columns, "__b.level", "__b.number")
    asked = points.filter(F.col(line) >= 0).withColumn("__b", F.explode(blocks_around(F.col(line).cast("long")))).select(*points.columns, "__b.level", "__b.number")
    return asked.join(each, [*key, "level", "number"]).drop("level", "number")


def runs(rows: DataFrame, key: list[str], line: str) -> DataFrame:
    """``key``, first_line, last_line: the longest runs of lines that are all there. Repeated lines count once, null lines not."""
    each = rows.filter(F.col(line).isNotNull()).select(*key, F.col(line).cast("long").alias("__l")).distinct()
    place = F.row_number().over(Window.partitionBy(*key).orderBy("__l"))
    return each.withColumn("__r", F.col("__l") - place).groupBy(*key, "__r").agg(F.min("__l").alias("first_line"), F.max("__l").alias("last_line")).drop("__r")
