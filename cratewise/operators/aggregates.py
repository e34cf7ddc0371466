"""Aggregates the catalog is built from. All of them combine on the map side before any shuffle."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.operators.ranking import average_ranks


def distinct_users(df: DataFrame, item: str, user: str, listens: str) -> DataFrame:
    """Unique users and total listens per item: one row per (item, user) first, so hot items stay spread."""
    pairs = df.groupBy(item, user).agg(F.sum(listens).alias("_l"))
    return pairs.groupBy(item).agg(F.count(user).alias("users"), F.sum("_l").alias("listens"))


def most_common(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Most frequent value per group, ties by value."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))


def sorted_distinct_list(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias(name))


def ordered_list(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    rows = df.select(*by, F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(value).alias("v")).alias("_r"))
    listed = rows.groupBy(*by).agg(F.array_sort(F.collect_list("_r")).alias("_l"))
    return listed.select(*by, F.transform("_l", lambda e: e["v"]).alias(name))


def ordered_map(df: DataFrame, by: list[str], order: str, key: str, value: str, name: str) -> DataFrame:
    """Map with keys in declaration order; groups hold a few vocabulary keys each."""
    entry = F.struct(F.col(order).alias("o"), F.col(key).alias("k"), F.col(value).alias("v"))
    listed = df.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    return listed.select(*by, F.map_from_entries(F.transform("_l", lambda e: F.struct(e["k"], e["v"]))).alias(name))


def hundred_thousandths(x: Column) -> Column:
    """``x`` as a whole number of 0.00001, rounded as a cast to decimal(12,5) rounds. Only what lies near a tie, or is no plain number, takes that cast."""
    scaled = x * 100_000
    whole = F.rint(scaled)
    plain = (F.abs(scaled - whole) < 0.49) & (F.abs(x) < 1_000)
    return F.when(plain, whole.cast("long")).otherwise(F.rint(x.cast("decimal(12,5)").cast("double") * 100_000).cast("long"))


def decimal_sums(df: DataFrame, by: list[str], columns: list[str], count: str = "n") -> DataFrame:
    """Row count and exact sums: whole numbers of 0.00001 give the same result in any order, and add up without decimal objects."""
    exact = lambda n: (n.cast("decimal(22,0)") * F.lit("0.00001").cast("decimal(5,5)")).cast("decimal(22,5)")
    sums = [exact(F.sum(hundred_thousandths(F.col(c)))).alias(c) for c in columns]
    return df.groupBy(*by).agg(F.count("*").alias(count), *sums)


def means_of_sums(sums: DataFrame, by: list[str], columns: list[str], count: str = "n") -> DataFrame:
    """Σ sums / Σ counts per group, divided as doubles."""
    total = sums.groupBy(*by).agg(F.sum(count).alias(count), *[F.sum(c).alias(c) for c in columns])
    return total.select(*by, count, *[(F.col(c).cast("double") / F.col(count)).alias(c) for c in columns])


def pivot_weights(df: DataFrame, key: str, name: str, names: list[str], value: str) -> DataFrame:
    return df.groupBy(key).pivot(name, names).agg(F.first(value))


def leave_one_out(
    df: DataFrame, group: str, labelled: str, ys: dict[str, str], held_out: str, centres: dict[str, float],
    prefix: str, shrink: float = 2.0,
) -> DataFrame:
    """Group means without the row's own label, shrunk toward the overall mean; masked for held-out rows.

    ``ys``: name → label column; adds ``<prefix>_<name>`` and one ``has_<prefix>``. Group sums take every
    label, those of validation and test rows too. One aggregate and one join serve all labels.
    """
    sums = [F.sum(F.col(y).cast("decimal(28,9)")).cast("double").alias(f"_s_{d}") for d, y in ys.items()]
    stats = df.where(F.col(labelled) & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"), *sums)
    own = F.col(labelled).cast("int")
    others = F.coalesce("_n", F.lit(0)) - own
    masked = F.col(held_out) | (others <= 0)
    joined = df.join(stats, group, "left")
    for d, y in ys.items():
        mu = F.lit(float(centres[d]))
        shrunk = (F.col(f"_s_{d}") - F.when(F.col(labelled), F.coalesce(y, F.lit(0.0))).otherwise(F.lit(0.0)) + shrink * mu) / (others + shrink)
        joined = joined.withColumn(f"{prefix}_{d}", F.when(masked, mu).otherwise(shrunk))
    joined = joined.withColumn(f"has_{prefix}", F.when(masked, 0.0).otherwise(1.0))
    return joined.drop("_n", *[f"_s_{d}" for d in ys])


def normal_equations(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """(i, j, value) of XᵀX and Xᵀy with an intercept first and the targets last, as one aggregate row unpivoted."""
    columns = [F.lit(1.0), *[F.col(f).cast("double") for f in (*features, *targets)]]
    cells = list(combinations_with_replacement(range(len(columns)), 2))
    row = df.agg(*[F.sum(columns[i] * columns[j]).alias(f"c{i}_{j}") for i, j in cells])
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("value")) for i, j in cells])
    return row.select(F.inline(entries))


def distribution(df: DataFrame, value: str, where: Column | None = None) -> DataFrame:
    """Value, count and share, largest first, nulls last. One pass over the rows; the rest is per value."""
    rows = df if where is None else df.where(where)
    counts = rows.groupBy(F.col(value).alias("key")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    # ``total`` is a single row, whatever the data.
    shares = counts.join(F.broadcast(total), F.lit(True)).select("key", "n", (F.col("n") / F.col("_total")).alias("share"))
    return shares.orderBy(F.col("n").desc(), F.col("key").asc_nulls_last())


def log_fame(counted: Column, comps: Column, listeners: Column) -> Column:
    """ln(1 + songs) + ln(1 + compilations) + ½ ln(1 + best song's listeners), over the counted rows."""
    return (
        F.log1p(F.count_if(counted)) + F.log1p(F.coalesce(F.sum(F.when(counted, comps)), F.lit(0)))
        + 0.5 * F.log1p(F.coalesce(F.max(F.when(counted, listeners)), F.lit(0)))
    )


def two_fold_error(df: DataFrame, by: list[str], fold: str, x: str, y: str) -> DataFrame:
    """Held-out error of a line fit on the other fold, next to that of the other fold's mean."""
    fits = df.groupBy(*by, (1 - F.col(fold)).alias(fold)).agg(
        F.count("*").alias("_n"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"),
        F.var_pop(x).alias("_vx"), F.avg(y).alias("_m"),
    )
    usable = (F.col("_n") >= 3) & (F.col("_vx") > 0)
    guess = F.when(usable, F.col("_a") + F.col("_b") * F.col(x)).otherwise(F.col("_m"))
    return df.join(fits, [*by, fold]).groupBy(*by).agg(
        F.avg(F.abs(guess - F.col(y))).alias("mae"), F.avg(F.abs(F.col("_m") - F.col(y))).alias("baseline")
    )


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks."""
    ranked = average_ranks(average_ranks(df, by, x, "_rx"), by, y, "_ry")
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"))


def unmapped_values(tags: DataFrame, known: list[DataFrame], limit: int) -> DataFrame:
    """Most frequent tags that no mapping names. ``tags``: song, tag, votes."""
    rows = tags
    for table in known:
        rows = rows.join(table.distinct(), "tag", "left_anti")
    per_song = rows.groupBy("tag", "song").agg(F.sum("votes").alias("_v"))
    counts = per_song.groupBy("tag").agg(F.count("song").alias("songs"), F.sum("_v").alias("votes"))
    return counts.orderBy(F.col("songs").desc(), "tag").limit(limit)
