"""Canonical songs and their attributes from raw recordings, listens, releases and works."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.functions.text import decade_of, lang_bucket, norm_title, script_lang, version_type
from cratewise.operators.joins import resolve_redirects
from cratewise.operators.ranking import attach, best_per_group
from cratewise.session import fixed


@dataclass(frozen=True)
class Dedupe:
    """When a second version type of a song is kept beside the first."""

    min_listeners: int = 20
    min_share: float = 0.2


def heard_canonical(listens: DataFrame, recordings: DataFrame, redirects: DataFrame, canon: DataFrame) -> DataFrame:
    """Top-list rows on canonical recordings: user_id, canon, gid, listens."""
    ids = recordings.select("gid", "id").unionByName(redirects.select("gid", F.col("new_id").alias("id")))
    # Ids meet their canonical recordings first, so that listens are shuffled once.
    at = ids.withColumnRenamed("id", "recording").join(canon, "recording").select("gid", "canon")
    return listens.join(at, "gid").select("user_id", "canon", "gid", "listens")


def build_songs(
    recordings: DataFrame, redirects: DataFrame, canonical: DataFrame, listens: DataFrame, first_artist: DataFrame,
    seed_artists: DataFrame | None = None, seed_title: Column | None = None,
    dedupe: Dedupe = Dedupe(), min_length_ms: int = 0,
) -> dict[str, DataFrame]:
    """song, song_rec, unit (canon → representative), heard and info tables.

    ``first_artist``: artist_credit, first_artist. ``seed_artists``: first_artist whose songs are built even
    when nobody lists them; ``seed_title`` does the same by title.
    """
    canon = resolve_redirects(recordings, redirects, canonical)
    heard = fixed(heard_canonical(listens, recordings, redirects, canon))
    # One row per (canon, user) serves both the popularity of canons and that of units.
    by_user = fixed(heard.groupBy("canon", "user_id").agg(F.sum("listens").alias("listens"), F.count("*").alias("rows")))
    pop = by_user.groupBy("canon").agg(F.count("*").alias("users"), F.sum("listens").alias("listens"))

    heads = recordings.join(canon.select(F.col("canon").alias("id")).distinct(), "id", "left_semi").join(first_artist, "artist_credit")
    listened = (
        pop.select(F.col("canon").alias("id")).join(heads.select("id", "first_artist"), "id")
        .select("first_artist", F.lit(True).alias("_listened")).distinct()
    )
    seeded = F.lit(False) if seed_title is None else F.coalesce(seed_title, F.lit(False))
    if seed_artists is not None:
        marks = seed_artists.select("first_artist", F.lit(True).alias("_seed")).distinct()
        heads = heads.join(marks, "first_artist", "left")
        seeded = seeded | F.coalesce("_seed", F.lit(False))
    heads = heads.withColumn("seeded", seeded).join(listened, "first_artist", "left")
    info = fixed(heads.where(F.col("seeded") | F.col("_listened").isNotNull()).select(
        F.col("id").alias("canon"), "gid", "first_artist", "seeded", "length_ms",
        norm_title(F.col("name")).alias("norm_title"), version_type(F.col("name"), F.col("comment")).alias("version_type"),
    ))
    key = ["first_artist", "norm_title", "version_type"]
    ranked = info.join(pop, "canon", "left").na.fill(0, ["users", "listens"])
    order = [
        (F.coalesce("length_ms", F.lit(min_length_ms)) < min_length_ms).alias("short"),
        (-F.col("users")).alias("u"), (-F.col("listens")).alias("l"), F.col("gid").alias("g"),
    ]
    head_of = best_per_group(ranked.withColumn("unit", F.col("canon")), key, order, ["unit"])
    unit = info.join(head_of, key).select("canon", "unit", "seeded", *key, "gid")

    # Unique users of a unit: collapse to one row per (unit, user) before counting.
    pairs = by_user.join(unit.select("canon", "unit"), "canon").groupBy("unit", "user_id").agg(F.sum("listens").alias("listens"))
    unit_pop = pairs.groupBy("unit").agg(F.count("*").alias("listeners"), F.sum("listens").alias("listens"))
    seeds = unit.groupBy("unit").agg(F.bool_or("seeded").alias("_seeded"))
    known = seeds.join(unit_pop, "unit", "left").where(F.col("listeners").isNotNull() | F.col("_seeded"))
    units = known.na.fill(0, ["listeners", "listens"]).join(
        info.select(F.col("canon").alias("unit"), "gid", *key), "unit"
    )
    # At most two version types per title, so the best is an aggregate and the rest a comparison.
    title = ["first_artist", "norm_title"]
    first = F.struct((-F.col("listeners")).alias("l"), (-F.col("listens")).alias("n"), F.col("gid").alias("g"))
    tops = units.groupBy(*title).agg(F.min_by("unit", first).alias("_best"), F.max("listeners").alias("_top"))
    songs = attach(units, tops, title).withColumn("alt_version", F.col("unit") != F.col("_best"))
    popular = (F.col("listeners") >= dedupe.min_listeners) & (F.col("listeners") >= dedupe.min_share * F.col("_top"))
    song = songs.where(~F.col("alt_version") | popular).select(
        F.col("unit").alias("song"), "gid", *key, F.col("listeners").alias("proxy_listeners"),
        F.col("listens").alias("proxy_listens"), "alt_version",
    )
    song = fixed(song)
    song_rec = (
        unit.select("canon", F.col("unit").alias("song")).join(song.select("song"), "song", "left_semi")
        .join(canon, "canon").select("song", "recording")
    )
    return {"song": song, "song_rec": fixed(song_rec), "unit": unit, "heard": heard, "info": info}


def song_years(song_rec: DataFrame, first_year: DataFrame) -> DataFrame:
    """Earliest plausible year over a song's recordings. ``first_year``: recording, year."""
    years = song_rec.join(first_year.where(F.col("year").between(1800, 2100)), "recording")
    return years.groupBy("song").agg(F.min("year").alias("year"))


def song_isrcs(song_rec: DataFrame, isrc: DataFrame) -> DataFrame:
    return song_rec.join(isrc, "recording").groupBy("song").agg(F.array_sort(F.collect_set("isrc")).alias("isrcs"))


def song_languages(song_rec: DataFrame, rec_work: DataFrame, work_lang: DataFrame) -> DataFrame:
    """Most common language of the works a song performs, ties by code."""
    counts = (
        song_rec.join(rec_work, "recording").join(work_lang, "work").groupBy("song", "lang").agg(F.count("*").alias("_n"))
    )
    return counts.groupBy("song").agg(F.min_by("lang", F.struct(-F.col("_n"), F.col("lang"))).alias("lang"))


def song_releases(
    song: DataFrame, canonical_release: DataFrame, rec_release: DataFrame, release_year: DataFrame, release: DataFrame
) -> DataFrame:
    """The canonical release of a song, else its earliest; with title, group and language.

    ``canonical_release``: gid, release gid. ``rec_release``: recording, release.
    """
    by_gid = release.select(F.col("id").alias("release"), F.col("gid").alias("canonical_release"))
    named = song.select("song", "gid").join(canonical_release, "gid").join(by_gid, "canonical_release").select("song", "release")
    open_ = song.select("song").join(named, "song", "left_anti")
    found = rec_release.withColumnRenamed("recording", "song").join(open_, "song", "left_semi").join(release_year, "release", "left")
    order = [F.coalesce("year", F.lit(9999)).alias("y"), F.col("release").alias("r")]
    earliest = best_per_group(found, ["song"], order, ["release"])
    details = release.select(
        F.col("id").alias("release"), F.col("name").alias("release_title"), "release_group", F.col("lang").alias("release_lang")
    )
    return named.unionByName(earliest.select("song", "release")).join(details, "release")


def song_credits(song: DataFrame, recordings: DataFrame, credit_name: DataFrame, artist: DataFrame) -> DataFrame:
    """Title, length and the credited artists' ids in order."""
    ids = credit_name.join(artist.select(F.col("id").alias("artist"), "gid"), "artist").groupBy("artist_credit").agg(
        F.array_sort(F.collect_list(F.struct("position", "gid"))).alias("_a")
    )
    rec = recordings.select(F.col("id").alias("song"), F.col("name").alias("title"), "artist_credit", "length_ms")
    return song.select("song").join(rec, "song").join(ids, "artist_credit").select(
        "song", "title", "length_ms", "artist_credit", F.transform("_a", lambda e: e["gid"]).alias("artist_mbids")
    )


def song_attributes(
    song: DataFrame, credits: DataFrame, artist: DataFrame, years: DataFrame, languages: DataFrame,
    releases: DataFrame, countries: DataFrame, isrcs: DataFrame,
) -> DataFrame:
    """One wide row per song. ``countries``: area, country."""
    who = artist.select(F.col("id").alias("first_artist"), F.col("gid").alias("first_artist_gid"), F.col("name").alias("artist_name"), "area")
    wide = (
        song.join(credits, "song").join(who, "first_artist").join(countries, "area", "left").join(years, "song", "left")
        .join(languages, "song", "left").join(releases, "song", "left").join(isrcs, "song", "left")
    )
    iso = F.coalesce("lang", "release_lang", script_lang(F.col("title")))
    return wide.select(
        "song", "gid", "first_artist", "first_artist_gid", "artist_name", "version_type", "alt_version", "proxy_listeners",
        "proxy_listens", "title", "artist_credit", "artist_mbids", "length_ms", "year", decade_of(F.col("year")).alias("decade"),
        iso.alias("language_iso"), lang_bucket(iso).alias("language"), F.col("country").alias("artist_country"),
        F.coalesce("isrcs", F.array().cast("array<string>")).alias("isrcs"), "release_title", "release_group",
    )
