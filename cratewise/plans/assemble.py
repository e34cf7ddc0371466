"""The finished catalog: merged feature tiers, scaled axes, map of clusters, index encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.functions.features import AUDIO_DIMS, SCALED_DIMS, clamp, feature_confidence
from cratewise.functions.text import is_holiday_title, norm_title
from cratewise.operators.aggregates import ordered_map
from cratewise.operators.ranking import average_rank_scale, surrogate_ids
from cratewise.session import bounded

SLOTS = 4
NONE_CODE, INSTRUMENTAL_CODE = 255, 254

CATALOG_COLUMNS = (
    "track_id", "title", "artist_credit", "artist_mbids", "release_title", "year", "decade", "isrcs", "language",
    "clusters", "primary_cluster", "energy", "valence", "dance", "acoustic", "intensity", "tempo", "mainstream",
    "vocal", "complexity", "feature_source", "feature_confidence", "listeners", "listens", "popularity_pct",
    "catalog_version", "artist_country", "language_iso", "length_ms", "version_type", "genre_source", "raw_energy",
    "raw_valence", "raw_dance", "raw_acoustic", "raw_intensity", "raw_tempo", "raw_vocal", "raw_complexity", "raw_bpm",
    "selected_via", "proxy_listeners", "release_groups", "comps", "va_comps", "market", "artist_rank", "hit_pct", "tier",
)


def merge_tiers(sel: DataFrame, own: DataFrame, sibling: DataFrame, model: DataFrame, nudges: DataFrame) -> DataFrame:
    """Raw axes of every selected song from its first available tier, with the source and confidence.

    The tiers are disjoint by song, so they are stacked and joined once instead of three times.
    """
    tier = lambda df, n, source: df.select(
        "song", F.lit(n).alias("_t"), F.lit(source).alias("feature_source"), *AUDIO_DIMS,
        *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in ("certainty", "bpm", "model_has_artist")],
    )
    stacked = tier(own, 1, "ab_direct").unionByName(tier(sibling, 2, "ab_sibling")).unionByName(tier(model, 3, "model"))
    columns = [c for c in stacked.columns if c not in ("song", "_t")]
    first = stacked.groupBy("song").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_t"))).alias(c) for c in AUDIO_DIMS],
                                        *[F.min_by(c, "_t").alias(c) for c in columns if c not in (*AUDIO_DIMS, "bpm")],
                                        F.min_by("bpm", F.when(F.col("bpm").isNotNull(), F.col("_t"))).alias("bpm"))
    lean = nudges.groupBy("song").pivot("dim", ["intensity", "complexity"]).agg(
        F.first("tag_mean").alias("tag"), F.first("prior").alias("prior")
    )
    wide = sel.select("song").join(first, "song", "left").join(lean, "song", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    source = F.coalesce("feature_source", F.lit("model"))
    untagged = zero("complexity_prior")
    complexity = F.when(F.col("complexity_tag").isNull(), untagged).otherwise(0.5 * F.col("complexity_tag") + 0.5 * untagged)
    plain = [d for d in AUDIO_DIMS if d not in ("intensity", "tempo")]
    intensity = F.col("intensity") + 0.5 * zero("intensity_tag") + zero("intensity_prior")
    return wide.select(
        "song", source.alias("feature_source"), *[F.col(d).alias(f"raw_{d}") for d in plain],
        zero("tempo").alias("raw_tempo"), clamp(intensity).alias("raw_intensity"), complexity.alias("raw_complexity"),
        F.col("bpm").alias("raw_bpm"), feature_confidence(source, F.col("certainty"), zero("model_has_artist")).alias("confidence"),
    )


def scaled_axes(raw: DataFrame) -> DataFrame:
    """song plus the eight quantile-scaled axes, ranked over narrow (song, axis, value) rows."""
    narrow = raw.select("song", *[F.col(f"raw_{d}").alias(d) for d in SCALED_DIMS])
    return average_rank_scale(narrow, "song", list(SCALED_DIMS))


def build_catalog(sel: DataFrame, raw: DataFrame, hits: DataFrame, genre: DataFrame, weights: DataFrame,
                  clusters: DataFrame, version: str) -> DataFrame:
    maps = ordered_map(
        weights.join(sel.select("song"), "song", "left_semi").join(bounded(clusters), "cluster"),
        ["song"], "ord", "cluster", "w", "clusters",
    )
    # Rounded twice: a value on a rounding edge must not depend on the order its parts were added in.
    tidy = lambda c, digits: F.round(F.round(c, 9), digits)
    rounded = [tidy(f"raw_{d}", 4).alias(f"raw_{d}") for d in SCALED_DIMS]
    measured = raw.select("song", "feature_source", *rounded, tidy("raw_bpm", 1).alias("raw_bpm"), tidy("confidence", 3).alias("feature_confidence"))
    hit = hits.withColumnRenamed("proxy_listeners", "_p")
    wide = (
        sel.join(measured, "song").join(scaled_axes(raw), "song").join(hit, "song")
        .join(genre, "song").join(maps, "song", "left")
    )
    empty = F.create_map().cast("map<string,double>")
    wide = wide.withColumns({
        "track_id": F.col("gid"), "clusters": F.coalesce("clusters", empty), "catalog_version": F.lit(version),
        "mainstream": F.round(2 * F.col("popularity_pct").cast("decimal(8,6)") - 1, 4).cast("double"), "selected_via": F.col("via"),
    })
    return wide.select(*CATALOG_COLUMNS)


def encode(catalog: DataFrame, genres: list[str], decades: list[str], languages: list[str]) -> DataFrame:
    """Index codes in declaration order: cluster slots heaviest first, decade, language, artist and title ids."""
    code = lambda keys, c: F.coalesce(
        F.nullif(F.array_position(F.lit(list(keys)), c), F.lit(0).cast("long")) - 1, F.lit(NONE_CODE)
    ).cast("int")
    slot = F.transform(F.map_entries("clusters"), lambda e: F.struct(
        (-e["value"]).alias("w"), (F.array_position(F.lit(list(genres)), e["key"]) - 1).alias("i")
    ))
    at = lambda k, f: F.get(F.col("_slots"), F.lit(k)).getField(f)
    rows = catalog.withColumns({
        "_slots": F.array_sort(slot), "artist": F.get("artist_mbids", F.lit(0)), "title_key": norm_title(F.col("title")),
    })
    language = F.when(F.col("language") == "none", INSTRUMENTAL_CODE).otherwise(code(languages, F.col("language")))
    coded = rows.select(
        "track_id", "artist", "title_key",
        *[F.coalesce(at(k, "i"), F.lit(NONE_CODE)).cast("int").alias(f"slot{k}") for k in range(SLOTS)],
        *[F.coalesce(-at(k, "w"), F.lit(0.0)).alias(f"weight{k}") for k in range(SLOTS)],
        code(genres, F.col("primary_cluster")).alias("primary"), code(decades, F.col("decade")).alias("decade"),
        language.alias("language"), F.coalesce("year", F.lit(0)).alias("year"), "tier", "market",
        "artist_rank", is_holiday_title(F.col("title")).cast("int").alias("holiday"),
    )
    artists, titles = surrogate_ids(coded, "artist", "artist_id"), surrogate_ids(coded, "title_key", "title_id")
    return coded.join(artists, "artist").join(titles, "title_key").drop("artist", "title_key")


