"""Audio features of songs: own recordings (tier 1), sibling recordings (tier 2), raw axes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.functions.features import AUDIO_DIMS, PROBABILITIES, certainty, raw_dims, tempo_axis
from cratewise.operators.aggregates import decimal_sums, means_of_sums
from cratewise.operators.joins import sibling_totals
from cratewise.operators.ranking import exact_median, median_of_counts
from cratewise.session import fixed


def recording_sums(submissions: DataFrame, ids: DataFrame) -> DataFrame:
    """Submission count and exact probability sums per recording. ``ids``: gid, id (merged ids included).

    Summed per gid first, so that wide rows of single submissions are not shuffled to meet their ids.
    """
    names = list(PROBABILITIES)
    per_gid = decimal_sums(submissions, ["mbid"], names).withColumnRenamed("mbid", "gid")
    at = per_gid.join(ids, "gid").withColumnRenamed("id", "recording")
    sums = [F.sum(p).cast("decimal(22,5)").alias(p) for p in names]
    return at.groupBy("recording").agg(F.sum("n").alias("n"), *sums)


def recording_bpm(rhythm: DataFrame, ids: DataFrame) -> DataFrame:
    at = rhythm.where("bpm > 0").withColumnRenamed("mbid", "gid").join(ids, "gid")
    return at.select(F.col("id").alias("recording"), "bpm")


def own_features(song_rec: DataFrame, sums: DataFrame, bpm: DataFrame) -> DataFrame:
    """Tier 1: mean probabilities over a song's own recordings, and its median bpm."""
    means = means_of_sums(song_rec.join(sums, "recording"), ["song"], list(PROBABILITIES))
    median = exact_median(song_rec.join(bpm, "recording"), ["song"], "bpm", "bpm")
    return means.join(median, "song", "left")


def sharing_keys(isrc: DataFrame, rec_work: DataFrame, recordings: DataFrame, credit_name: DataFrame) -> DataFrame:
    """(recording, key): its ISRCs, and its works together with each credited artist (covers stay apart)."""
    by_code = isrc.select("recording", F.concat(F.lit("i:"), "isrc").alias("key"))
    artists = recordings.select(F.col("id").alias("recording"), "artist_credit").join(credit_name, "artist_credit")
    by_work = rec_work.join(artists, "recording").select("recording", _work_key("artist"))
    return by_code.unionByName(by_work).distinct()


def _work_key(artist: str):
    return F.concat(F.lit("w:"), F.col("work").cast("string"), F.lit(":"), F.col(artist).cast("string")).alias("key")


def sibling_features(
    need: DataFrame, song_rec: DataFrame, isrc: DataFrame, rec_work: DataFrame, keys: DataFrame, sums: DataFrame, bpm: DataFrame
) -> DataFrame:
    """Tier 2: the same means over recordings that share an ISRC, or a work and the song's artist.

    ``need``: song, first_artist of songs without tier 1.
    """
    own = fixed(song_rec.join(need, "song"))
    of_own = lambda table: own.join(table.join(own.select("recording").distinct(), "recording", "left_semi"), "recording")
    code = of_own(isrc).select("song", F.concat(F.lit("i:"), "isrc").alias("key"))
    work = of_own(rec_work).select("song", _work_key("first_artist"))
    song_keys = fixed(code.unionByName(work).distinct())
    keys = fixed(keys.join(song_keys.select("key").distinct(), "key", "left_semi"))
    mine = own.select("song", "recording")
    measures = {"n": F.col("n"), **{p: F.col(p) for p in PROBABILITIES}}
    totals = sibling_totals(song_keys, mine, keys, sums, measures).where("n > 0")
    means = means_of_sums(totals, ["song"], list(PROBABILITIES))
    # Only recordings with classifier data count as siblings, for the bpm too.
    beats = bpm.join(sums.select("recording"), "recording", "left_semi")
    counted = sibling_totals(song_keys, mine, keys, beats, {"ties": F.lit(1)}, ("bpm",)).where("ties > 0")
    return means.join(median_of_counts(counted, ["song"], "bpm", "ties", "bpm"), "song", "left")


def raw_axes(features: DataFrame, genre: DataFrame, **tempo_genres) -> DataFrame:
    """Seven raw axes, certainty, bpm and submission count per song."""
    axes = raw_dims(F.col)
    axes["tempo"] = tempo_axis(F.col("bpm"), F.col("primary_cluster"), **tempo_genres)
    at = features.join(genre.select("song", "primary_cluster"), "song")
    return at.select("song", *[axes[d].alias(d) for d in AUDIO_DIMS], certainty(F.col).alias("certainty"), "bpm", "n")
