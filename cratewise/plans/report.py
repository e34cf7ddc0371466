"""Catalog quality report and the curated-list draft."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cratewise.operators.aggregates import log_fame, most_common


def sections(catalog: DataFrame, columns: list[str]) -> DataFrame:
    """(section, key, n, share) over several columns in one pass: the columns are stacked before counting."""
    pairs = F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).cast("string").alias("key")) for c in columns])
    counts = catalog.select(F.inline(pairs)).groupBy("section", "key").agg(F.count("*").alias("n"))
    # Every section counts every row once, so any section's total is the table's.
    totals = counts.groupBy("section").agg(F.sum("n").alias("_total"))
    return counts.join(totals, "section").select("section", "key", "n", (F.col("n") / F.col("_total")).alias("share"))


def signature_rows(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """Top three songs of the artist most often credited exactly as each name. ``names``: name."""
    credited = catalog.join(names.withColumnRenamed("name", "artist_credit"), "artist_credit", "left_semi")
    artist = most_common(credited, ["artist_credit"], "artist", "artist").withColumnRenamed("artist_credit", "name")
    top = catalog.where("artist_rank <= 3").select("artist", "title", F.col("artist_rank").alias("rank"), "tier", "listeners")
    return artist.join(top, "artist").select("name", "title", "rank", "tier", "listeners")


def draft_curated_list(catalog: DataFrame, limit: int = 900, tier1: int = 150, tier2: int = 300) -> DataFrame:
    """(artist, name, songs, pos, tier, top) candidates for a curated list, by fame in the domestic market.

    ``catalog``: artist, artist_credit, title, comps, listeners, market, artist_country, artist_rank.
    """
    il = (F.col("market") == "il") | F.col("artist_country").eqNullSafe("IL")
    fame = catalog.groupBy("artist").agg(
        F.count_if(il).alias("songs"), log_fame(il, F.col("comps"), F.col("listeners")).alias("_fame")
    ).where("songs > 0")
    top = fame.withColumn("_f", F.round("_fame", 9)).orderBy(F.col("_f").desc(), "artist").limit(limit)
    # At most ``limit`` rows from here on.
    placed = top.withColumn("pos", F.row_number().over(Window.orderBy(F.col("_f").desc(), "artist")))
    names = most_common(catalog.join(placed.select("artist"), "artist", "left_semi"), ["artist"], "artist_credit", "name")
    best = catalog.where("artist_rank <= 3").join(placed.select("artist"), "artist", "left_semi")
    listed = best.groupBy("artist").agg(F.array_sort(F.collect_list(F.struct("artist_rank", "title"))).alias("_t"))
    tier = F.when(F.col("pos") <= tier1, 1).when(F.col("pos") <= tier1 + tier2, 2).otherwise(3)
    return placed.join(names, "artist").join(listed, "artist", "left").select(
        "artist", "name", "songs", "pos", tier.alias("tier"),
        F.coalesce(F.transform("_t", lambda e: e["title"]), F.array().cast("array<string>")).alias("top"),
    )


def to_markdown(title: str, sections_df: DataFrame, limit: int = 40) -> str:
    """Format report sections; at most ``limit`` rows per section reach the driver."""
    order = Window.partitionBy("section").orderBy(F.col("n").desc(), F.col("key").asc_nulls_last())
    rows = sections_df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).orderBy("section", "_r").collect()
    lines = [f"# {title}"]
    current = None
    for row in rows:
        if row["section"] != current:
            current = row["section"]
            lines += ["", f"| {current} | tracks | share |", "|---|---:|---:|"]
        lines.append(f"| {row['key'] or '_(none)_'} | {row['n']:,} | {100 * row['share']:.1f}% |")
    return "\n".join(lines) + "\n"


