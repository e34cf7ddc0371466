"""Ranks, quantiles and running totals that stay balanced when one group holds much of the data.

A plain window sends a whole group to one task. Here rows are range-partitioned on (group, order), so a
large group spreads over many pieces; each piece is ranked on its own and shifted by the totals of the
pieces before it. At most two groups straddle a piece boundary, so the offsets stay tiny.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewise.session import fixed, shuffle_width

_BEFORE = (Window.unboundedPreceding, -1)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def attach(df: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Add the columns of ``per_key`` (one row per key) to ``df``; null keys match each other."""
    named = {k: f"_key_{k}" for k in keys}
    other = per_key.withColumnsRenamed(named)
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()], F.lit(True))
    return df.join(other, match, "left").drop(*named.values())


def prefix_totals(
    df: DataFrame, by: list[str], order: list[Column], weight: str | None = None,
    before: str = "before", total: str = "total",
) -> DataFrame:
    """Sum of ``weight`` (row count without one) over the rows ahead in the group, and over the group.

    ``order`` must be total within a group.
    """
    width = shuffle_width(df.sparkSession)
    groups = [F.col(c) for c in by]
    amount = F.col(weight) if weight else F.lit(1)
    # Written out: range bounds come from a sample, so both readers below must see the same pieces.
    pieces = fixed(
        df.repartitionByRange(width, *groups, *order).withColumn("_piece", F.spark_partition_id())
    )
    inside = Window.partitionBy("_piece", *by).orderBy(*order)
    ahead = F.sum(amount).over(inside.rowsBetween(*_BEFORE)) if weight else F.row_number().over(inside) - 1
    sums = pieces.groupBy("_piece", *by).agg(F.sum(amount).alias("_sum"))
    # One row per (piece, group): a group has at most ``width`` of them.
    across = Window.partitionBy(*by)
    offsets = sums.select(
        "_piece", *by,
        F.coalesce(F.sum("_sum").over(across.orderBy("_piece").rowsBetween(*_BEFORE)), F.lit(0)).alias("_shift"),
        F.sum("_sum").over(across).alias(total),
    )
    local = pieces.withColumn("_ahead", F.coalesce(ahead, F.lit(0)))
    joined = attach(local, offsets, ["_piece", *by])
    return joined.withColumn(before, F.col("_ahead") + F.col("_shift")).drop("_piece", "_ahead", "_shift")


def row_numbers(df: DataFrame, by: list[str], order: list[Column], name: str = "rk", size: str = "n") -> DataFrame:
    """Row number and size of every group (the whole table when ``by`` is empty)."""
    ranked = prefix_totals(df, by, order, before="_before", total="_total")
    return (
        ranked.withColumn(name, (F.col("_before") + 1).cast("long"))
        .withColumn(size, F.col("_total").cast("long"))
        .drop("_before", "_total")
    )


def value_positions(df: DataFrame, by: list[str], value: str, descending: bool = False) -> DataFrame:
    """Per (group, distinct value): ``ties``, rows ``before`` it and group size ``n``.

    Counting distinct values first keeps repeated values from piling up in one piece.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("ties"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    return prefix_totals(counts, by, [order], weight="ties", before="before", total="n")


def percent_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``percent_rank`` with ties sharing the lowest rank; 0 in a group of one."""
    at = value_positions(df, by, value)
    share = F.when(F.col("n") > 1, F.col("before") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return attach(df, at.select(*by, value, share.alias(name)), [*by, value])


def percent_ranks_of(df: DataFrame, key: str, by: list[str], columns: list[str]) -> DataFrame:
    """``percent_rank`` of several columns within the group, in one ranking pass: key plus ``pr_<column>``."""
    long = df.select(key, *by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [key, *by], list(columns), "_dim", "_value"
    )
    at = value_positions(long, [*by, "_dim"], "_value")
    share = F.when(F.col("n") > 1, F.col("before") / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("_pr")
    ranks = attach(long, at.select(*by, "_dim", "_value", share), [*by, "_dim", "_value"])
    wide = ranks.groupBy(key).pivot("_dim", list(columns)).agg(F.first("_pr"))
    return wide.withColumnsRenamed({c: f"pr_{c}" for c in columns})


def average_rank_scale(df: DataFrame, key: str, columns: list[str], digits: int = 4) -> DataFrame:
    """Each column mapped to (−1, 1) by its average rank over the whole table; ties share a value."""
    long = df.select(key, *columns).unpivot([key], list(columns), "_dim", "_value")
    at = value_positions(long, ["_dim"], "_value")
    middle = F.col("before") + 1 + (F.col("ties") - 1) / 2.0 - 0.5
    scaled = at.select("_dim", "_value", F.round(2 * middle / F.col("n") - 1, digits).alias("_scaled"))
    return (
        attach(long, scaled, ["_dim", "_value"])
        .groupBy(key).pivot("_dim", list(columns)).agg(F.first("_scaled"))
    )


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """0-based rank where equal values share their mean rank."""
    at = value_positions(df, by, value)
    rank = F.col("before") + (F.col("ties") - 1) / 2.0
    return attach(df, at.select(*by, value, rank.alias(name)), [*by, value])


def exact_median(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group over value counts, without holding a group in memory."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    return median_of_counts(counts, by, value, "ties", name)


def median_of_counts(counts: DataFrame, by: list[str], value: str, ties: str, name: str = "median") -> DataFrame:
    """Median of values given how often each occurs (one row per group and value)."""
    at = prefix_totals(counts, by, [F.col(value).asc()], weight=ties, before="before", total="n")
    covers = lambda pos: (
        (F.col("before") <= pos) & (pos < F.col("before") + F.col(ties))
    ).cast("int")
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    part = F.col(value) * (covers(low) + covers(high)) / 2.0
    return at.groupBy(*by).agg(F.sum(part).alias(name))


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: the smallest value with at least p % of the group at or below it."""
    at = value_positions(df, by, value)
    needed = lambda p: F.ceil(F.lit(p) * F.col("n") / 100)
    picks = [
        F.min(F.when(F.col("before") + F.col("ties") >= needed(p), F.col(value))).alias(name)
        for name, p in percents.items()
    ]
    return at.groupBy(*by).agg(F.first("n").alias("n"), *picks)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rk") -> DataFrame:
    """The best ``k`` rows of every group. Spark cuts each map task to ``k`` before shuffling."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(name) <= k)


def top_by_limit(df: DataFrame, by: list[str], order: list[Column], limit: Column, spread: str, name: str = "rk", salts: int = 32) -> DataFrame:
    """The best ``limit`` rows per group, where the limit differs by group.

    Every group is first cut in ``salts`` parts by ``spread`` (the overall best are among the parts' best), so
    a group with much of the data is not ranked in one task.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    part = Window.partitionBy(*by, "_salt").orderBy(*order)
    cut = salted.withColumn(name, F.row_number().over(part)).where(F.col(name) <= limit).drop("_salt")
    return cut.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= limit)


def best_per_group(df: DataFrame, by: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The columns of the first row of every group, as a partial (map-side) aggregate."""
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*by).agg(first.alias("_best")).select(*by, *[F.col(f"_best.{c}").alias(c) for c in columns])


def totals_beside(df: DataFrame, by: list[str], aggregates: list[Column]) -> DataFrame:
    """Group aggregates next to every row, by partial aggregation and a join instead of a window."""
    return attach(df, df.groupBy(*by).agg(*aggregates), by)


def mass_cut(df: DataFrame, by: list[str], weight: str, order: list[Column], mass: float) -> DataFrame:
    """The smallest leading set of every group whose weight reaches ``mass`` of the total."""
    ranked = prefix_totals(df.where(F.col(weight) > 0), by, order, weight=weight)
    return ranked.where(F.col("before") < F.lit(mass) * F.col("total")).drop("before", "total")


def surrogate_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Dense ids 0.. over the distinct keys, in key order."""
    ranked = row_numbers(df.select(key).distinct(), [], [F.col(key).asc()], "_rk", "_n")
    return ranked.select(key, (F.col("_rk") - 1).alias(name))


def evenly_spread(df: DataFrame, rank: str, size: str, k: Column) -> DataFrame:
    """Keep ``k`` rows of a 0-based ranking: the best half outright, the rest evenly spaced."""
    top = F.ceil(k / 2)
    rest = k - top
    position = F.col(rank)
    # i-th spaced pick sits at top + floor((i + .5) * (size - top) / rest); invert it for this position.
    step = (F.col(size) - top) / rest
    slot = F.floor((position - top + 1) / step - 0.5)
    hits = lambda i: (i >= 0) & (i < rest) & (top + F.floor((i + 0.5) * step) == position)
    spaced = (rest > 0) & (position >= top) & (hits(slot) | hits(slot - 1) | hits(slot + 1))
    return df.where((k > 0) & ((k >= F.col(size)) | (position < top) | F.coalesce(spaced, F.lit(False))))


def lag_lead_smooth(df: DataFrame, by: list[str], order: str, value: str, k: Column, name: str) -> DataFrame:
    """x + k·(previous + next) inside a vocabulary-sized group."""
    w = Window.partitionBy(*by).orderBy(order)
    around = F.coalesce(F.lag(value).over(w), F.lit(0.0)) + F.coalesce(F.lead(value).over(w), F.lit(0.0))
    return df.withColumn(name, F.col(value) + k * around)
