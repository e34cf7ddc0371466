"""Genre clusters, scalar nudges and drop reasons of candidates, from tags on three levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cratewise.functions.features import GENRE_CLASSES
from cratewise.functions.text import is_non_music_title
from cratewise.session import bounded

# --- fixed values -----------------------------------------------------------------------------------
LEVELS = {1: ("recording", "1.00"), 2: ("release_group", "0.50"), 3: ("artist", "0.25")}
PLACEHOLDER_ARTISTS = ("Various Artists", "[unknown]", "[anonymous]", "[no artist]", "[data]", "[dialogue]")
SPOKEN_RELEASE_TYPES = ("audiobook", "spokenword", "interview", "audio drama", "field recording")
NUDGED = ("complexity", "intensity")
# ----------------------------------------------------------------------------------------------------


def level_weight():
    level = F.when(F.lit(False), F.lit("0").cast("decimal(4,2)"))
    for n, (_, weight) in LEVELS.items():
        level = level.when(F.col("level") == n, F.lit(weight).cast("decimal(4,2)"))
    return level


def level_name(level):
    names = F.lit(None).cast("string")
    for n, (name, _) in LEVELS.items():
        names = F.when(level == n, F.lit(name)).otherwise(names)
    return names


def candidate_tags(cand: DataFrame, cand_rec: DataFrame, recording_tag: DataFrame, rg_tag: DataFrame, artist_tag: DataFrame) -> DataFrame:
    """(song, level, tag, votes) with level 1 = recording, 2 = release group, 3 = artist.

    Only the recording level needs summing; group and artist tags are joined once per song.
    """
    own = cand_rec.join(recording_tag.withColumnRenamed("entity", "recording"), "recording")
    one = own.groupBy("song", "tag").agg(F.sum("votes").alias("votes")).withColumn("level", F.lit(1))
    summed = lambda t, key: t.groupBy(F.col("entity").alias(key), "tag").agg(F.sum("votes").alias("votes"))
    two = cand.select("song", "release_group").join(summed(rg_tag, "release_group"), "release_group").withColumn("level", F.lit(2))
    three = cand.select("song", "first_artist").join(summed(artist_tag, "first_artist"), "first_artist").withColumn("level", F.lit(3))
    columns = ["song", "level", "tag", "votes"]
    return one.select(columns).unionByName(two.select(columns)).unionByName(three.select(columns))


def cluster_evidence(tags: DataFrame, tag_map: DataFrame, clusters: DataFrame) -> DataFrame:
    """(song, cluster, b): evidence normalised inside each level, then blended by level weight.

    Decimals keep the sums across levels exact. A (song, level) group holds at most one row per cluster.
    """
    mapped = tag_map.join(clusters.select(F.col("cluster").alias("key")), "key", "left_semi")
    v = F.sum(F.col("votes") * F.col("value").cast("decimal(9,4)")).cast("double")
    per_level = tags.join(bounded(mapped), "tag").groupBy("song", "level", F.col("key").alias("cluster")).agg(v.alias("v"))
    share = (F.col("v") / F.sum("v").over(Window.partitionBy("song", "level"))).cast("decimal(18,9)")
    return per_level.withColumn("w", share).groupBy("song", "cluster").agg(F.sum(F.col("w") * level_weight()).alias("b"))


def evidence_level(tags: DataFrame, tag_map: DataFrame, clusters: DataFrame) -> DataFrame:
    """(song, genre_source): the most specific level with a mapped tag."""
    mapped = tag_map.join(clusters.select(F.col("cluster").alias("key")), "key", "left_semi").select("tag").distinct()
    hit = tags.join(bounded(mapped), "tag", "left_semi")
    return hit.groupBy("song").agg(level_name(F.min("level")).alias("genre_source"))


def classifier_evidence(song_ab: DataFrame, tagged: DataFrame, classes: DataFrame, clusters: DataFrame, floor: float = 0.3) -> DataFrame:
    """(song, cluster, b) from genre classifiers, for songs without any mapped tag."""
    untagged = song_ab.join(tagged.select("song"), "song", "left_anti")
    used = [c for c in GENRE_CLASSES if c in song_ab.columns]
    long = untagged.select("song", *used).unpivot(["song"], used, "class", "p").where(F.col("p") >= floor)
    mapped = classes.join(clusters.select("cluster"), "cluster", "left_semi")
    b = F.sum(F.col("p").cast("decimal(12,6)") * F.col("value").cast("decimal(9,4)"))
    return long.join(bounded(mapped), "class").groupBy("song", "cluster").agg(b.alias("b"))


def cluster_weights(evidence: DataFrame, clusters: DataFrame, floor: float = 0.1, keep: int = 4) -> DataFrame:
    """(song, cluster, w, rk): shares ≥ ``floor``, best ``keep`` (ties by declaration order), renormalised.

    A song has at most one row per cluster, so the per-song windows are vocabulary-sized.
    """
    song = Window.partitionBy("song")
    b = evidence.withColumn("b", F.col("b").cast("double"))
    shares = b.withColumn("_w", F.col("b") / F.sum("b").over(song)).where(F.col("_w") >= floor)
    ranked = shares.join(bounded(clusters), "cluster").withColumn(
        "rk", F.row_number().over(song.orderBy(F.col("_w").desc(), "ord"))
    ).where(F.col("rk") <= keep)
    return ranked.select("song", "cluster", F.round(F.col("_w") / F.sum("_w").over(song), 3).alias("w"), "rk")


def genre_of(cand: DataFrame, weights: DataFrame, sources: DataFrame, from_classifier: DataFrame) -> DataFrame:
    """(song, genre_source, primary_cluster)."""
    first = weights.where("rk = 1").select("song", F.col("cluster").alias("primary_cluster"))
    by_ab = from_classifier.select("song", F.lit("ab").alias("_ab")).distinct()
    wide = cand.select("song").join(sources, "song", "left").join(by_ab, "song", "left").join(first, "song", "left")
    return wide.select("song", F.coalesce("genre_source", "_ab", F.lit("none")).alias("genre_source"), "primary_cluster")


def nudges(cand: DataFrame, tags: DataFrame, tag_map: DataFrame, weights: DataFrame, priors: DataFrame) -> DataFrame:
    """(song, dim, tag_mean, prior) for the tag-nudged axes."""
    effect = tag_map.where(F.col("key").isin(*NUDGED)).withColumnRenamed("key", "dim")
    weight = F.col("votes") * level_weight()
    parts = tags.join(bounded(effect), "tag").groupBy("song", "dim").agg(
        F.sum(weight * F.col("value").cast("decimal(9,4)")).cast("double").alias("_s"), F.sum(weight).cast("double").alias("_n")
    ).select("song", "dim", (F.col("_s") / F.col("_n")).alias("tag_mean"))
    lean = F.sum(F.col("w").cast("decimal(9,4)") * F.col("value").cast("decimal(9,4)")).cast("double")
    prior = weights.join(bounded(priors.withColumnRenamed("key", "dim")), "cluster").groupBy("song", "dim").agg(lean.alias("prior"))
    grid = cand.select("song", F.explode(F.array(*[F.lit(d) for d in NUDGED])).alias("dim"))
    wide = grid.join(parts, ["song", "dim"], "left").join(prior, ["song", "dim"], "left")
    return wide.select("song", "dim", "tag_mean", F.coalesce("prior", F.lit(0.0)).alias("prior"))


def non_music_votes(tags: DataFrame, tag_map: DataFrame, non_music: DataFrame) -> DataFrame:
    """(song, flag): whether non-music tags outvote genre tags at the most specific level with either."""
    spoken = non_music.select("tag", F.lit(1).alias("_nm")).distinct()
    genre = tag_map.select("tag", F.lit(1).alias("_gm")).distinct()
    marked = tags.join(bounded(spoken), "tag", "left").join(bounded(genre), "tag", "left")
    sums = marked.groupBy("song", "level").agg(
        F.sum(F.when(F.col("_nm") == 1, F.col("votes")).otherwise(0)).alias("nm"),
        F.sum(F.when(F.col("_gm") == 1, F.col("votes")).otherwise(0)).alias("gm"),
    )
    return sums.where("nm + gm > 0").groupBy("song").agg(F.min_by(F.col("nm") > F.col("gm"), "level").alias("flag"))


def drop_reasons(cand: DataFrame, votes: DataFrame, rg_secondary: DataFrame, min_length_ms: int) -> DataFrame:
    """(song, reason): the first rule that drops a candidate, or null."""
    spoken = rg_secondary.where(F.col("type").isin(*SPOKEN_RELEASE_TYPES)).select("release_group", F.lit(True).alias("_spoken")).distinct()
    wide = cand.join(spoken, "release_group", "left").join(votes, "song", "left")
    reason = (
        F.when(F.col("artist_name").isin(*PLACEHOLDER_ARTISTS), "placeholder_artist")
        .when(F.col("length_ms") < min_length_ms, "too_short")
        .when(is_non_music_title(F.col("title")), "title_pattern")
        .when(F.col("_spoken"), "release_type")
        .when(F.col("flag"), "non_music_tag")
    )
    return wide.select("song", reason.alias("reason"))
