"""Numbers in order within a group, without putting a group of any size into one task.

A group is cut into stretches of a whole-number column; stretches are summed up, the sums added up
over the group (one row a stretch), and the rest happens within a stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def running_sum(df: DataFrame, keys: list[str], place: str, order: list[Column | str], value: Column, out: str, width: int = WIDTH, kind: str = "int") -> DataFrame:
    """``df`` with ``out``, of type ``kind``: the sum of ``value`` up to and with the row. ``place`` is the whole number
    that stretches are cut by; ``order`` starts with it. Null places come last."""
    stretch = F.coalesce(F.floor(F.col(place) / width), F.lit(2**40))
    cut = df.withColumns({"_stretch": stretch, "_value": value})
    sums = cut.groupBy(*keys, "_stretch").agg(F.sum("_value").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_stretch")) - F.col("_sum")).drop("_sum")
    inside = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    added = cut.withColumn("_inside", F.sum("_value").over(inside)).join(before, [*keys, "_stretch"])
    return added.withColumn(out, (F.col("_before") + F.col("_inside")).cast(kind)).drop("_stretch", "_value", "_before", "_inside")


def with_neighbours(df: DataFrame, keys: list[str], place: str, order: list[Column | str], first: Column, last: Column, before: str, after: str, width: int = WIDTH) -> DataFrame:
    """``df`` with ``before``, the ``last`` of the row before in its group, and ``after``, the ``first`` of
    the row behind it. Between stretches they come from a table of the stretches' edges."""
    cut = df.withColumns({"_stretch": F.floor(F.col(place) / width), "_first": first, "_last": last})
    within, across = Window.partitionBy(*keys, "_stretch").orderBy(*order), Window.partitionBy(*keys).orderBy("_stretch")
    at = F.struct(*order)
    edges = cut.groupBy(*keys, "_stretch").agg(F.min_by("_first", at).alias("_f"), F.max_by("_last", at).alias("_l"))
    edges = edges.select(*keys, "_stretch", F.lag("_l").over(across).alias("_earlier"), F.lead("_f").over(across).alias("_later"))
    near = cut.withColumns({before: F.lag("_last").over(within), after: F.lead("_first").over(within)}).join(edges, [*keys, "_stretch"])
    return near.withColumns({before: F.coalesce(before, "_earlier"), after: F.coalesce(after, "_later")}).drop("_stretch", "_first", "_last", "_earlier", "_later")


def numbered(df: DataFrame, keys: list[str], place: str, order: list[Column | str], out: str, width: int = WIDTH) -> DataFrame:
    """``df`` with ``out``: the row's number in its group, from 0."""
    return running_sum(df, keys, place, order, F.lit(1), out, width).withColumn(out, F.col(out) - 1)
