"""Joins that Spark has no operator for: ranges, nearest in time, first and latest by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(windows: DataFrame, points: DataFrame, on: list[str], bucket: int, how: str = "inner") -> DataFrame:
    """Rows of ``windows`` (start, end, both inclusive) with the points (t) of the same key within.

    A window is copied to the time buckets it touches and met by equality of key and bucket, so a hot
    key is spread over its buckets. ``bucket`` should be about a window's length. Column names of
    both sides but for ``on`` must differ.
    """
    cells = F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))
    left = windows.withColumn("_cell", F.explode(F.when(F.col("start") <= F.col("end"), cells)))
    right = points.withColumn("_cell", F.floor(F.col("t") / bucket))
    inside = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in [*on, "_cell"]] + [F.col("r.t").between(F.col("l.start"), F.col("l.end"))]
    condition = inside[0]
    for c in inside[1:]:
        condition &= c
    keep = [F.col(f"l.{c}") for c in windows.columns] + [F.col(f"r.{c}") for c in points.columns if c not in on]
    # copies are more than Spark's estimate knows of: without the hint it may broadcast them, all through the driver
    return left.alias("l").hint("merge").join(right.alias("r"), condition, how).select(*keep)


def nearest(left: DataFrame, right: DataFrame, on: list[str], row: str, value: str, tolerance: int) -> DataFrame:
    """``left`` (at) with the value of the right row (t) that is nearest in time, on either side.

    Null beyond ``tolerance`` (inclusive). Of rows equally near the earlier wins, then the smaller value.
    ``row`` identifies a row of ``left``.
    """
    spans = left.select(*on, row, "at").withColumns({"start": F.col("at") - tolerance, "end": F.col("at") + tolerance})
    met = range_join(spans, right.select(*on, "t", value), on, 2 * tolerance)
    best = met.groupBy(row).agg(F.min(F.struct(F.abs(F.col("t") - F.col("at")).alias("gap"), "t", value)).alias("_b"))
    return left.join(best.select(row, F.col(f"_b.{value}").alias(value)), row, "left")


def latest_by(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Order and columns of each key's last row by ``order``; partially aggregated, so hot keys are no hot spot."""
    found = rows.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in columns if c not in order))).alias("_r"))
    return found.select(*keys, "_r.*")


def first_by(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """As ``latest_by``, the first row: insert-if-absent and DISTINCT ON."""
    found = rows.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in columns if c not in order))).alias("_r"))
    return found.select(*keys, "_r.*")


def top_by(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def overlapping(windows: DataFrame, spans: DataFrame, width: int, also: Column | None = None) -> DataFrame:
    """Windows (start, end) that a span (from_t, to_t; null bounds are open) meets where ``also`` holds, if given; a window may come more than once.

    Both sides go to the time buckets that they touch, ``width`` long, and meet by bucket: no nested loops. Spans
    are cut to the windows' extent first, so an open one touches no more buckets than there are.
    """
    extent = windows.agg(F.min("start").alias("_first"), F.max("end").alias("_last"))  # one row
    touched = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    cut = spans.crossJoin(F.broadcast(extent)).withColumns({"_lo": F.greatest("from_t", "_first"), "_hi": F.least("to_t", "_last")}).filter("_lo <= _hi").withColumn("_bucket", touched("_lo", "_hi"))
    met = (F.col("_lo") <= F.col("end")) & (F.col("_hi") >= F.col("start"))
    met = met if also is None else met & also
    left = windows.withColumn("_bucket", touched("start", "end")).alias("w")
    return left.join(cut.alias("s"), (F.col("w._bucket") == F.col("s._bucket")) & met, "left_semi").drop("_bucket")


def latest_before(left: DataFrame, right: DataFrame, on: list[str], columns: list[str], order: list[str], span: int) -> DataFrame:
    """``left`` (at) with ``columns`` of the right row (t) that is last at or before it, of equal times the greatest by ``order``; null without one.

    Both sides go to spans of time by key. A row takes the last one of its span, or else what the spans before it
    left, one row each, so that a key's history is never ordered in one task.
    """
    value = F.struct(*dict.fromkeys(["t", *order, *columns]))
    points = right.select(*on, F.col("t").alias("_at"), F.lit(0).alias("_side"), value.alias("_point"))
    rows = left.withColumns({"_at": F.col("at"), "_side": F.lit(1), "_row": F.struct(*left.columns)}).select(*on, "_at", "_side", "_row")
    both = rows.unionByName(points, allowMissingColumns=True).withColumn("_span", F.floor(F.col("_at") / span))
    key = [*on, "_span"]
    so_far = Window.partitionBy(*key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("_own", F.max("_point").over(so_far)).filter("_side = 1")
    before = Window.partitionBy(*on).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*key).agg(F.max("_point").alias("_last")).withColumn("_carried", F.max("_last").over(before)).select(*key, "_carried")
    found = local.join(carried, key).withColumn("_found", F.coalesce("_own", "_carried"))
    return found.select("_row.*", *(F.col(f"_found.{c}").alias(c) for c in columns))
