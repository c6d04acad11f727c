"""Windows over one long series, spread over tasks.

A window by key puts a key's whole series in one task. Here rows are sorted by ranges of key and time, numbered by what stands in
the ranges before, and cut into segments of equal numbers of rows; a segment also gets the few rows beside it that its windows
reach. What has no bound (the last value before) is carried from segment to segment by one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

#: Rows of a segment.
SEGMENT = 1 << 16


def _key(keys: list[str]) -> Column:
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("_one"))


def numbered_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with _at: the row's number from 0 within its key, in the order of ``order``; no task has more than a range of rows.

    Only the number of rows of each range and key is brought together, as many as there are ranges and keys.
    """
    keyed = df.withColumn("_key", _key(keys))
    parts = cut(keyed.repartitionByRange("_key", *order).sortWithinPartitions("_key", *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n")).select("_key", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_key", "_part").orderBy(*order)) - 1
    return parts.withColumn("_own_at", own).join(offsets, ["_key", "_part"]).withColumn("_at", F.col("_first") + F.col("_own_at")).drop("_part", "_own_at", "_first")


def segmented(df: DataFrame, keys: list[str], order: list[str], before: int, after: int, rows: int = SEGMENT) -> DataFrame:
    """``df`` with _key, _segment, _at and _inside: every segment with the ``before`` rows in front of it and the ``after`` behind it.

    A window over (_key, _segment) by _at that reaches no further is right for the rows that are _inside.
    """
    rows = max(rows, before, after, 1)
    place, segment = F.col("_at") % rows, F.floor(F.col("_at") / rows)
    beside = F.array_compact(F.array(segment, F.when(place >= rows - before, segment + 1) if before else F.lit(None).cast("long"), F.when(place < after, segment - 1) if after else F.lit(None).cast("long")))
    placed = numbered_rows(df, keys, order).withColumn("_segment", F.explode(beside))
    return placed.withColumn("_inside", F.col("_segment") == segment)


def rolling(df: DataFrame, keys: list[str], order: list[str], before: int, after: int, columns: dict[str, Column], rows: int = SEGMENT) -> DataFrame:
    """``df`` with aggregates over the ``before`` rows in front of each row to the ``after`` behind it; equal to the window over the whole key."""
    w = Window.partitionBy("_key", "_segment").orderBy("_at").rowsBetween(-before, after)
    found = segmented(df, keys, order, before, after, rows).withColumns({name: c.over(w) for name, c in columns.items()})
    return found.where("_inside").drop("_key", "_segment", "_at", "_inside")


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, rows: int = SEGMENT) -> DataFrame:
    """``df`` with _last and _next: the last value that isn't NULL at or before each row, and the first at or after it, however far they are."""
    placed = numbered_rows(df, keys, order).withColumn("_segment", F.floor(F.col("_at") / max(rows, 1))).withColumn("_value", value)
    ends = placed.groupBy("_key", "_segment").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("_z"), F.min_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("_a"))
    over = Window.partitionBy("_key").orderBy("_segment")
    ends = ends.select("_key", "_segment", F.last("_z", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_z"), F.first("_a", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_a"))
    w = Window.partitionBy("_key", "_segment").orderBy("_at")
    own = placed.withColumns({"_last": F.last("_value", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.first("_value", True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    found = own.join(ends, ["_key", "_segment"])
    return found.withColumns({"_last": F.coalesce("_last", "_z"), "_next": F.coalesce("_next", "_a")}).drop("_key", "_segment", "_at", "_value", "_z", "_a")
