"""Validation: row rules, vocabulary conformance, configuration checks, append-only snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.functions.features import SCALARS
from cratewise.operators.ranking import row_numbers


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key…, rule) for every rule a row breaks. A rule that is null counts as broken."""
    names = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]
    broken = F.filter(F.array(*names), lambda x: x.isNotNull())
    return df.select(*key, F.explode(broken).alias("rule"))


def catalog_rules() -> dict[str, Column]:
    """Row rules of the finished catalog."""
    c = F.col
    rules = {d: c(d).between(-1, 1) for d in SCALARS}
    rules |= {n: c(n).between(0, 1) for n in ("feature_confidence", "popularity_pct", "hit_pct")}
    rules |= {
        n: c(n) >= 0 for n in ("listeners", "listens", "proxy_listeners", "release_groups", "comps", "va_comps")
    }
    rules |= {
        "artist_rank": c("artist_rank") >= 1,
        "tier": c("tier").isin(0, 1, 2),
        "market": c("market").isin("il", "intl"),
        "feature_source": c("feature_source").isin("ab_direct", "ab_sibling", "model", "ai"),
        "artist_mbids": F.size("artist_mbids") >= 1,
        "clusters": F.forall(F.map_values("clusters"), lambda w: w.between(0, 1)),
    }
    required = ("track_id", "title", "artist_credit", "language", "version_type", "genre_source", "selected_via")
    return rules | {n: c(n).isNotNull() for n in required}


def unknown_keys(used: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Distinct values the data uses and the vocabulary lacks."""
    return used.select(column).where(F.col(column).isNotNull()).distinct().join(known, column, "left_anti")


def tag_map_issues(
    tags: DataFrame, priors: DataFrame, classes: DataFrame, non_music: DataFrame, clusters: DataFrame,
    nudges: tuple[str, ...] = ("complexity", "intensity"), min_tags: int = 5,
) -> DataFrame:
    """(place, message): unknown keys, out-of-range weights, duplicates, overlaps, thin clusters.

    ``tags``: tag, key, value. ``priors``: cluster, key, value. ``classes``: class, cluster, value.
    """
    named = clusters.select(F.col("cluster").alias("key"), F.lit(True).alias("_known"))
    nudge = F.col("key").isin(*nudges)
    known = F.coalesce("_known", F.lit(False))

    def issue(df: DataFrame, place: Column, message: Column) -> DataFrame:
        return df.select(place.alias("place"), message.alias("message"))

    effects = tags.join(named, "key", "left")
    bad_weight = known & ~((F.col("value") > 0) & (F.col("value") <= 1))
    bad_nudge = ~known & nudge & ~F.col("value").between(-1, 1)
    verdict = (
        F.when(bad_weight, F.lit("cluster weight out of range"))
        .when(bad_nudge, F.lit("nudge out of range")).when(~known & ~nudge, F.lit("unknown key"))
    )
    out = issue(effects.withColumn("m", verdict).where("m is not null"), F.concat(F.lit("tags."), "tag"), F.col("m"))
    untidy = tags.select("tag").distinct().where((F.lower("tag") != F.col("tag")) | (F.trim("tag") != F.col("tag")))
    out = out.unionByName(issue(untidy, F.concat(F.lit("tags."), "tag"), F.lit("not lower case and trimmed")))

    p = priors.join(clusters.select("cluster", F.lit(True).alias("_known")), "cluster", "left")
    prior_bad = (
        F.when(~known, F.lit("unknown cluster")).when(~nudge, F.lit("unknown scalar"))
        .when(~F.col("value").between(-1, 1), F.lit("prior out of range"))
    )
    out = out.unionByName(
        issue(p.withColumn("m", prior_bad).where("m is not null"), F.concat(F.lit("priors."), "cluster"), F.col("m"))
    )
    k = classes.join(clusters.select("cluster", F.lit(True).alias("_known")), "cluster", "left")
    class_bad = (
        F.when(~F.col("class").rlike("^genre_(dortmund|rosamerica)__[a-z]+$"), F.lit("unknown class"))
        .when(~known, F.lit("unknown key"))
        .when(~((F.col("value") > 0) & (F.col("value") <= 1)), F.lit("cluster weight out of range"))
    )
    out = out.unionByName(
        issue(k.withColumn("m", class_bad).where("m is not null"), F.concat(F.lit("classes."), "class"), F.col("m"))
    )
    twice = non_music.groupBy("tag").count().where("count > 1")
    out = out.unionByName(issue(twice, F.lit("non_music"), F.concat(F.lit("duplicate "), "tag")))
    both = non_music.select("tag").distinct().join(tags.select("tag").distinct(), "tag", "left_semi")
    out = out.unionByName(issue(both, F.lit("non_music"), F.concat(F.lit("also mapped "), "tag")))
    used = tags.groupBy(F.col("key").alias("cluster")).agg(F.count("*").alias("_n"))
    thin = clusters.select("cluster").join(used, "cluster", "left").where(F.coalesce("_n", F.lit(0)) < min_tags)
    return out.unionByName(issue(thin, F.lit("tags"), F.concat(F.lit("too few tags for "), "cluster")))


def best_snapshot(cache: DataFrame) -> DataFrame:
    """Append-only popularity rows: the most users per gid wins, nulls last, ties by listens."""
    rank = F.struct(
        F.coalesce("users", F.lit(-1)).alias("u"), F.coalesce("listens", F.lit(-1)).alias("l")
    )
    best = cache.where("gid is not null").groupBy("gid").agg(F.max_by(F.struct("users", "listens"), rank).alias("b"))
    return best.select("gid", "b.users", "b.listens")


def missing_batches(wanted: DataFrame, cache: DataFrame, size: int = 1000) -> DataFrame:
    """Wanted ids the cache lacks, in id order with a batch number."""
    todo = wanted.select("gid").distinct().join(cache.select("gid"), "gid", "left_anti")
    ranked = row_numbers(todo, [], [F.col("gid").asc()], "_rk", "_n")
    return ranked.select("gid", F.floor((F.col("_rk") - 1) / size).cast("long").alias("batch"))
