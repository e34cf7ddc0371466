"""Splitting whole slots over weighted groups. Groups here are vocabularies (cells, strata), never facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest_remainder(
    df: DataFrame, by: list[str], weight: str, total: Column, order: list[Column], name: str = "slots"
) -> DataFrame:
    """Integers that sum to ``total``: floors plus one for the largest fractions, ties by ``order``.

    Zero weight everywhere splits evenly.
    """
    group = Window.partitionBy(*by)
    whole = F.sum(F.col(weight)).over(group)
    even = F.lit(1.0) / F.count("*").over(group)
    share = F.when(whole > 0, F.col(weight) / whole).otherwise(even)
    # Rounded, so that the order in which a group's weights were summed cannot decide a tie.
    exact = df.withColumn("_exact", F.round(share * total, 9)).withColumn("_floor", F.floor("_exact"))
    left = total - F.sum("_floor").over(group)
    by_fraction = group.orderBy(F.round(F.col("_exact") - F.col("_floor"), 6).desc(), *order)
    ranked = exact.withColumn("_left", left).withColumn("_rk", F.row_number().over(by_fraction))
    slots = F.col("_floor") + F.when(F.col("_rk") <= F.col("_left"), 1).otherwise(0)
    return ranked.withColumn(name, slots.cast("int")).drop("_exact", "_floor", "_left", "_rk")


def with_floor_of_one(
    df: DataFrame, by: list[str], size: str, total: Column, order: list[Column], name: str = "slots"
) -> DataFrame:
    """Slots by size, at least one per non-empty group when there are enough, never more than the size."""
    group = Window.partitionBy(*by)
    base = F.when((F.col(size) > 0) & (total >= F.count("*").over(group)), 1).otherwise(0)
    d = df.withColumn("_base", base)
    d = d.withColumn("_pool", F.greatest(F.lit(0), F.col(size) - F.col("_base")))
    d = d.withColumn("_left", total - F.sum("_base").over(group)).withColumn("_sum", F.sum("_pool").over(group))
    open_ = (F.col("_sum") > 0) & (F.col("_left") > 0)
    d = d.withColumn("_exact", F.when(open_, F.col("_pool") * F.col("_left") / F.col("_sum")).otherwise(F.lit(0.0)))
    d = d.withColumn("_out", F.least(F.col("_pool"), F.floor("_exact")) + F.col("_base"))
    d = d.withColumn("_more", F.when(open_, total - F.sum("_out").over(group)).otherwise(0))
    roomy = (F.col("_out") < F.col(size)).cast("int")
    by_fraction = group.orderBy((F.col("_exact") - F.floor("_exact")).desc(), *order)
    # Only groups with room take one; count the roomy ones ahead in fraction order.
    d = d.withColumn("_turn", F.sum(roomy).over(by_fraction.rowsBetween(Window.unboundedPreceding, 0)))
    extra = F.when((roomy == 1) & (F.col("_turn") <= F.col("_more")), 1).otherwise(0)
    scratch = ["_base", "_pool", "_left", "_sum", "_exact", "_more", "_turn"]
    return d.withColumn(name, (F.col("_out") + extra).cast("int")).drop("_out", *scratch)
