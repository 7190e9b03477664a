"""Numbers and running sums along an order of all rows, without a task that holds all rows or all of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.storage import materialize


def in_parts(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``_part``, written: parts are ranges of the order, of about equal size, numbered along it."""
    return materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "parts")


def _after(parted: DataFrame, by: list[str], order: tuple[str, ...], value: Column, name: str) -> DataFrame:
    """``parted`` with the sum of ``value`` up to each row, its own included: the sums of the parts first, then inside a part."""
    sums = parted.groupBy(*by, "_part").agg(F.sum(value).alias("_of_part"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_of_part").over(before), F.lit(0))
    keys = [F.col(k).alias(f"_at_{k}") for k in (*by, "_part")]
    offsets = sums.select(*keys, offset.alias("_offset"))
    same = F.lit(True)
    for k in (*by, "_part"):
        same = same & F.col(k).eqNullSafe(F.col(f"_at_{k}"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parted.withColumn("_inside", F.sum(value).over(inside)).join(offsets, same)
    return summed.withColumn(name, F.col("_inside") + F.col("_offset")).drop("_inside", "_part", "_offset", *[f"_at_{k}" for k in (*by, "_part")])


def running_sum(rows: DataFrame, value: str, *order: str, by: str | None = None, name: str = "run") -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row in the order, its own included, for all rows or per ``by`` (null is a value).

    Equal places in the order are summed one after the other. A key's rows are spread over parts by
    range, so neither a hot key nor equal places meet in one task.
    """
    keys = [] if by is None else [by]
    return _after(in_parts(rows, *keys, *order), keys, order, F.col(value), name)


def numbered(rows: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """``rows`` numbered from 1 along the order."""
    return _after(in_parts(rows, *order), [], order, F.lit(1), name)
