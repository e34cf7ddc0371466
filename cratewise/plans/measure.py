"""Measuring playlists: persona fit, spread, recognition, roll-ups and calibration."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewise.functions.features import SCALARS
from cratewise.operators.aggregates import spearman, two_fold_error
from cratewise.operators.ranking import prefix_totals, row_numbers
from cratewise.session import fixed

FIT2_MIN_SHARE = 0.25


def track_fit(track_clusters: DataFrame, tracks: DataFrame, personas: DataFrame) -> DataFrame:
    """(persona, track_id, cluster, decade, language, scalar, fit, fit2) where a track shares a cluster with a persona.

    Tracks and personas meet on clusters, so pairs whose fit is zero by cluster never appear; averages over
    all tracks only need the number of tracks. ``personas``: persona, clusters map, decades map?, languages
    map?, ranges map name → (lo, hi). A handful of rows.
    """
    wants = personas.select("persona", F.explode("clusters").alias("cluster", "_cw"))
    part = track_clusters.join(wants, "cluster")
    strong = F.max(F.when(F.col("w") >= FIT2_MIN_SHARE, F.col("_cw")))
    shared = part.groupBy("persona", "track_id").agg(F.sum(F.col("_cw") * F.col("w")).alias("cluster"), F.coalesce(strong, F.lit(0.0)).alias("_best"))
    rows = shared.join(tracks, "track_id").join(personas.drop("clusters"), "persona")
    weight = lambda m, k: F.when(F.col(m).isNull(), F.lit(1.0)).otherwise(F.coalesce(F.try_element_at(F.col(m), k), F.lit(0.0)))
    inside = lambda d: F.try_element_at(F.col("ranges"), F.lit(d))
    met = reduce(add, [F.coalesce(F.col(d).between(inside(d)["lo"], inside(d)["hi"]).cast("int"), F.lit(0)) for d in SCALARS])
    size = F.coalesce(F.size("ranges"), F.lit(0))
    rows = rows.withColumns({
        "_d": F.when(F.col("decades").isNotNull() & F.col("decade").isNull(), F.lit(0.0)).otherwise(weight("decades", F.col("decade"))),
        "_l": weight("languages", F.col("language")), "scalar": F.when(size > 0, met / size).otherwise(F.lit(1.0)),
    })
    rest = F.col("_d") * F.col("_l") * F.col("scalar")
    return rows.select(
        "persona", "track_id", "cluster", F.col("_d").alias("decade"), F.col("_l").alias("language"), "scalar",
        (F.col("cluster") * rest).alias("fit"), (F.col("_best") * rest).alias("fit2"),
    )


def catalog_baseline(fits: DataFrame, tracks: DataFrame, personas: DataFrame) -> DataFrame:
    """(persona, fit): expected fit of a random track; absent pairs count as zero."""
    n = tracks.agg(F.count("*").alias("_n"))
    total = fits.groupBy("persona").agg(F.sum("fit").alias("_s"))
    rows = personas.select("persona").join(total, "persona", "left").join(F.broadcast(n), F.lit(True))
    return rows.select("persona", (F.coalesce("_s", F.lit(0.0)) / F.col("_n")).alias("fit"))


def famous_artists(tracks: DataFrame, top: int = 5000) -> DataFrame:
    """Artists of the most listened best songs abroad, plus every artist with a domestic hit."""
    best = tracks.where("market <> 'il'").groupBy("artist").agg(F.max("proxy_listeners").alias("_b"))
    abroad = best.orderBy(F.col("_b").desc(), "artist").limit(top).select("artist")
    domestic = tracks.where("market = 'il' and tier = 0").select("artist")
    return abroad.unionByName(domestic).distinct()


def signature_flags(tracks: DataFrame, top: int = 5000) -> DataFrame:
    """(track_id, signature): one of a famous artist's top three songs."""
    famous = famous_artists(tracks, top).withColumn("_f", F.lit(True))
    rows = tracks.join(famous, "artist", "left")
    return rows.select("track_id", (F.coalesce("_f", F.lit(False)) & (F.col("artist_rank") <= 3)).alias("signature"))


def playlist_metrics(playlists: DataFrame, flags: DataFrame) -> DataFrame:
    """Per playlist: artist spread, upper-median popularity, mean year, hit / signature / canon / language shares.

    ``playlists``: playlist_id, pos, track_id, artist, mainstream, year, tier, language. ``flags``: track_id,
    signature, canon.
    """
    rows = playlists.join(flags, "track_id", "left")
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    main = rows.groupBy("playlist_id").agg(
        F.count("*").alias("n"), (F.count_distinct("artist") / F.count("*")).alias("artist_spread"),
        F.coalesce(F.avg(F.when(F.col("year") > 0, F.col("year"))), F.lit(0.0)).alias("year"), share(F.col("tier") == 0).alias("hits"),
        share(F.col("signature")).alias("signature"), (100 * share(F.col("canon"))).alias("canon"), share(F.col("language") == "lang_he").alias("hebrew"),
    )
    # Upper median: the value at position floor(n / 2) of the sorted popularities, found over value counts.
    counts = rows.groupBy("playlist_id", ((F.coalesce("mainstream", F.lit(0.0)) + 1) / 2).alias("_p")).agg(F.count("*").alias("_c"))
    at = prefix_totals(counts, ["playlist_id"], [F.col("_p").asc()], weight="_c", before="_b", total="_n")
    middle = F.floor(F.col("_n") / 2)
    median = at.where((F.col("_b") <= middle) & (middle < F.col("_b") + F.col("_c"))).select("playlist_id", F.col("_p").alias("popularity"))
    return main.join(median, "playlist_id")


#: Tracks of a playlist that one task ranks at most.
RANKED_WHOLE = 100_000


def mean_pairwise_distance(playlists: DataFrame) -> DataFrame:
    """(playlist_id, diversity): mean L1 distance over all pairs of tracks, in [0, 1], without forming pairs.

    On each axis the pairwise sum is Σ x·(rows below − rows above) over the sorted values. A playlist of up to RANKED_WHOLE tracks
    is ranked on all axes where its rows are; of a larger one value counts and their running totals are dealt out.
    """
    rows = fixed(playlists.select("playlist_id", *SCALARS))
    large = rows.groupBy("playlist_id").agg(F.count("*").alias("_n")).where(F.col("_n") > RANKED_WHOLE).select("playlist_id")
    sums = _sums_by_rank
    if not (large := fixed(large)).isEmpty():
        known, is_large = large.withColumnRenamed("playlist_id", "_large"), F.col("playlist_id").eqNullSafe(F.col("_large"))
        sums = lambda all_: _sums_by_rank(all_.join(known, is_large, "left_anti")).unionByName(_sums_by_value(all_.join(known, is_large, "left_semi")))
    pairs = F.col("_n") * (F.col("_n") - 1) / 2
    return sums(rows).select("playlist_id", F.when(pairs > 0, F.col("_s") / pairs / (2 * len(SCALARS))).otherwise(F.lit(0.0)).alias("diversity"))


def _sums_by_rank(rows: DataFrame) -> DataFrame:
    """(playlist_id, pairwise sum _s, tracks _n): one shuffle of the rows as they are, one local sort an axis."""
    # The value at rank r has r - 1 rows ahead and n - r behind: together Σ 2·r·x − (n + 1)·Σ x.
    whole = reduce(add, [F.coalesce(F.col(x), F.lit(0.0)) for x in SCALARS])
    there = F.coalesce(*[F.col(x) for x in SCALARS]).isNotNull()
    ranked = rows.withColumns({"_x": whole, "_there": there})
    for x in SCALARS:
        ranked = ranked.withColumn(x, F.col(x) * F.row_number().over(Window.partitionBy("playlist_id").orderBy(x)))
    by_rank = reduce(add, [F.coalesce(F.sum(x), F.lit(0.0)) for x in SCALARS])
    sums = ranked.groupBy("playlist_id").agg(by_rank.alias("_r"), F.sum("_x").alias("_x"), F.count("*").alias("_n"), F.bool_or("_there").alias("_there"))
    return sums.select("playlist_id", F.when(F.col("_there"), 2 * F.col("_r") - (F.col("_n") + 1) * F.col("_x")).alias("_s"), "_n")


def _sums_by_value(rows: DataFrame) -> DataFrame:
    """The same from value counts, for playlists that are too large for a task."""
    long = rows.unpivot(["playlist_id"], list(SCALARS), "dim", "x")
    counts = long.groupBy("playlist_id", "dim", "x").agg(F.count("*").alias("_c"))
    at = prefix_totals(counts, ["playlist_id", "dim"], [F.col("x").asc()], weight="_c", before="_b", total="_n")
    above = F.col("_n") - F.col("_b") - F.col("_c")
    return at.groupBy("playlist_id").agg(F.sum(F.col("x") * F.col("_c") * (F.col("_b") - above)).alias("_s"), F.max("_n").alias("_n"))


def roll_up(results: DataFrame) -> DataFrame:
    """(mode, fit, previous, last) mean fit per depth in order. ``results``: mode, fit. Few depths."""
    means = results.groupBy("mode").agg(F.avg("fit").alias("fit"), F.count("*").alias("n"))
    depth = Window.orderBy("mode")
    return means.withColumns({"previous": F.lag("fit").over(depth), "last": F.lead("fit").over(depth).isNull()})


def acceptance(results: DataFrame, margin: float = 0.3, dip: float = 0.05) -> DataFrame:
    """One row: whether fit rises with depth (the deepest step may dip), the margin, the mean and the verdict."""
    r = roll_up(results)
    rises = F.col("previous").isNull() | (F.col("fit") > F.col("previous")) | (F.col("last") & (F.col("fit") >= F.col("previous") - dip))
    row = r.agg(
        F.bool_and(rises).alias("monotone"), (F.max_by("fit", "mode") - F.min_by("fit", "mode")).alias("margin"), F.avg("fit").alias("mean_fit")
    )
    return row.withColumn("accepted", F.col("monotone") & (F.col("margin") >= margin))


def compare_variants(base: DataFrame, variant: DataFrame, keys: list[str]) -> DataFrame:
    """Paired means of two runs over the same keys. Both: keys plus fit."""
    both = base.withColumnRenamed("fit", "_a").join(variant.withColumnRenamed("fit", "_b"), keys)
    return both.groupBy(*keys).agg(F.avg("_a").alias("base"), F.avg("_b").alias("variant"), F.avg(F.col("_b") - F.col("_a")).alias("gain"))


def calibration_sample(tracks: DataFrame, n: int, band: int, least_inside: int | None = None) -> DataFrame:
    """Evenly spaced labelled tracks inside the popularity band of the ``band`` most popular unlabelled ones; of all
    labelled tracks where fewer than ``least_inside`` (n) lie in the band.

    ``tracks``: track_id, popularity, feature_source, year.
    """
    order = [F.col("popularity").desc(), F.col("track_id").asc()]
    low = tracks.where("feature_source = 'model'").select("popularity", "track_id").orderBy(*order).limit(band).agg(F.min("popularity").alias("_lo"))
    truth = tracks.where("feature_source = 'ab_direct' and year is not null").join(F.broadcast(low), F.lit(True))
    truth = truth.withColumn("_in", F.coalesce(F.col("popularity") >= F.col("_lo"), F.lit(False)))
    held = truth.agg(F.count_if("_in").alias("_held"))
    pool = truth.join(F.broadcast(held), F.lit(True)).where(F.col("_in") | (F.col("_held") < (n if least_inside is None else least_inside)))
    ranked = row_numbers(pool.select("track_id", "popularity"), [], order, "_rk", "_m")
    # The k-th pick sits at floor(k · m / n); a row is picked when some k lands on it.
    at = F.col("_rk") - 1
    k = F.ceil(at * n / F.col("_m"))
    return ranked.where((k < n) & (F.floor(k * F.col("_m") / n) == at)).select("track_id", "popularity")


def ratings_calibration(rows: DataFrame, dims: list[str], fold: Column) -> DataFrame:
    """(dim, mae, baseline, ratio, spearman) of ratings against measured values. ``rows``: key, r_<dim>, y_<dim>."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"r_{d}").cast("double").alias("x"), F.col(f"y_{d}").cast("double").alias("y")) for d in dims])
    long = rows.select(fold.alias("fold"), F.inline(pairs))
    errors = two_fold_error(long, ["dim"], "fold", "x", "y")
    rho = spearman(long, ["dim"], "x", "y")
    return errors.join(rho, "dim").select("dim", "mae", "baseline", (F.col("mae") / F.greatest("baseline", F.lit(1e-9))).alias("ratio"), F.col("rho").alias("spearman"))


def violation_tally(violations: DataFrame, exhausted: DataFrame) -> DataFrame:
    """(rule, n), leaving out the length of playlists the catalog could not fill."""
    short = exhausted.select("playlist_id").distinct().withColumn("_x", F.lit(True))
    rows = violations.join(short, "playlist_id", "left").where((F.col("rule") != "length") | F.col("_x").isNull())
    return rows.groupBy("rule").agg(F.count("*").alias("n"))


def match_coverage(tracks: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of coverage counts. ``tracks``: left_id, has_isrc, replaced. ``matches``: left_id, via."""
    rows = tracks.join(matches.select("left_id", "via"), "left_id", "left")
    found = F.col("via").isNotNull()
    return rows.agg(
        F.count("*").alias("requested"), F.count_if(found).alias("matched"), F.count_if(F.col("via") == "isrc").alias("by_isrc"),
        F.count_if("has_isrc").alias("with_isrc"), F.count_if(F.col("has_isrc") & found).alias("with_isrc_matched"),
        F.count_if(~found & F.col("replaced")).alias("replaced"), F.count_if(~found & ~F.col("replaced")).alias("missing"),
    )
