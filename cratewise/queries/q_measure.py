"""Measurement (L1–L12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratewise.functions.features import SCALARS
from cratewise.operators import joins
from cratewise.plans import measure
from cratewise.queries.registry import query
from cratewise.queries.roles import Roles, oracle_stage, stage

c = F.col


@stage("personas")
def _personas(r: Roles):
    as_map = lambda df, k, v, n: df.groupBy("persona").agg(F.map_from_entries(F.collect_list(F.struct(k, v))).alias(n))
    ranges = r.persona_range.groupBy("persona").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("lo", "hi")))).alias("ranges"))
    out = as_map(r.persona_cluster, "cluster", "cw", "clusters").join(as_map(r.persona_decade, "decade", "dw", "decades"), "persona", "left")
    return r.keep(out.join(as_map(r.persona_language, "language", "lw", "languages"), "persona", "left").join(ranges, "persona", "left"))


stage("fits")(lambda r: measure.track_fit(r.track_cluster.select("track_id", "cluster", "w"), r.tracks, r.personas))
_IN = " + ".join(f"(CASE WHEN EXISTS (SELECT 1 FROM persona_range g WHERE g.persona = s.persona AND g.k = '{d}' AND t.{d} BETWEEN g.lo AND g.hi) THEN 1 ELSE 0 END)" for d in ("energy", "valence", "tempo"))
oracle_stage("o_fit", f"""
    WITH s AS (SELECT p.persona, x.track_id, sum(p.cw * x.w) AS cluster, coalesce(max(CASE WHEN x.w >= 0.25 THEN p.cw END), 0) AS best FROM track_cluster x JOIN persona_cluster p ON p.cluster = x.cluster GROUP BY 1, 2),
    f AS (SELECT s.persona, s.track_id, s.cluster, s.best, CASE WHEN s.persona IN (SELECT persona FROM persona_decade) THEN coalesce((SELECT dw FROM persona_decade d WHERE d.persona = s.persona AND d.decade = t.decade), 0) ELSE 1 END AS decade,
        CASE WHEN s.persona IN (SELECT persona FROM persona_language) THEN coalesce((SELECT lw FROM persona_language l WHERE l.persona = s.persona AND l.language = t.language), 0) ELSE 1 END AS language,
        CASE WHEN s.persona IN (SELECT persona FROM persona_range) THEN CAST({_IN} AS DOUBLE) / (SELECT count(*) FROM persona_range g WHERE g.persona = s.persona) ELSE 1 END AS scalar FROM s JOIN tracks t ON t.track_id = s.track_id)
    SELECT persona, track_id, cluster, decade, language, scalar, cluster * (decade * language * scalar) AS fit, best * (decade * language * scalar) AS fit2 FROM f""")
_R = ("cluster", "scalar", "fit", "fit2")


@query("l1_track_fit", f"SELECT persona, track_id, decade, language, {', '.join(f'round({x}, 7) AS {x}' for x in _R)} FROM o_fit")
def l1(r: Roles):
    return r.fits.select("persona", "track_id", "decade", "language", *[F.round(x, 7).alias(x) for x in _R])


@stage("l_rows")
def _rows(r: Roles):
    t = r.tracks.select("track_id", "artist", "year", "tier", "language", *SCALARS)
    return r.mix_track.join(t, "track_id")


oracle_stage("o_sig", """
    SELECT track_id, artist_rank <= 3 AND artist IN (SELECT artist FROM (SELECT artist, row_number() OVER (ORDER BY max(listeners) DESC, artist) AS n FROM tracks WHERE market <> 'il' GROUP BY 1) WHERE n <= 12
      UNION SELECT artist FROM tracks WHERE market = 'il' AND tier = 0 AND listeners > 20) AS signature FROM tracks""")
stage("l_sig")(lambda r: measure.signature_flags(
    r.tracks.select("track_id", "artist", "artist_rank", "market", F.when((c("market") == "il") & (c("listeners") <= 20), 2).otherwise(c("tier")).alias("tier"), c("listeners").alias("proxy_listeners")), 12))


@query("l2_playlist_metrics", """
    WITH b AS (SELECT m.playlist_id, t.*, s.signature FROM mix_track m JOIN tracks t ON t.track_id = m.track_id JOIN o_sig s ON s.track_id = m.track_id)
    SELECT playlist_id, count(*) AS n, round(count(DISTINCT artist) / CAST(count(*) AS DOUBLE), 7) AS artist_spread, round(coalesce(avg(year), 0), 4) AS year, round(avg(CASE WHEN tier = 0 THEN 1.0 ELSE 0 END), 7) AS hits,
      round(avg(CASE WHEN signature THEN 1.0 ELSE 0 END), 7) AS signature, round(avg(CASE WHEN track_id % 10 = 0 THEN 100.0 ELSE 0 END), 5) AS canon, round(avg(CASE WHEN language = 'lang_he' THEN 1.0 ELSE 0 END), 7) AS hebrew,
      round((list_sort(list(mainstream))[count(*) // 2 + 1] + 1) / 2, 7) AS popularity FROM b GROUP BY 1""")
def l2(r: Roles):
    flags = r.l_sig.withColumn("canon", c("track_id") % 10 == 0)
    m = measure.playlist_metrics(r.l_rows, flags)
    return m.select("playlist_id", "n", F.round("year", 4).alias("year"), F.round("canon", 5).alias("canon"),
                    *[F.round(x, 7).alias(x) for x in ("artist_spread", "hits", "signature", "hebrew", "popularity")])


_L1 = " + ".join(f"abs(a.{d} - b.{d})" for d in SCALARS)


@query("l3_mean_pairwise_distance", f"""
    WITH m AS (SELECT m.playlist_id, m.pos, t.* FROM mix_track m JOIN tracks t ON t.track_id = m.track_id),
    d AS (SELECT a.playlist_id, avg(({_L1}) / 18) AS d FROM m a JOIN m b ON b.playlist_id = a.playlist_id AND b.pos > a.pos GROUP BY 1)
    SELECT p.playlist_id, round(coalesce(d.d, 0), 7) AS diversity FROM (SELECT DISTINCT playlist_id FROM m) p LEFT JOIN d ON d.playlist_id = p.playlist_id""")
def l3(r: Roles):
    return measure.mean_pairwise_distance(r.l_rows).withColumn("diversity", F.round("diversity", 7))


@query("l4_signature_tracks", "SELECT * FROM o_sig")
def l4(r: Roles):
    return r.l_sig


@query("l5_canon_found", """
    SELECT c_mktsegment AS canon, count(DISTINCT p.p_partkey) AS found FROM (SELECT c_mktsegment, 'Brand#' || c_custkey % 9 AS a, c_custkey % 50 AS k FROM customer) q
    JOIN part w ON w.p_partkey = q.k JOIN part p ON lower(replace(p.p_name, ' ', '')) = lower(replace(w.p_name, ' ', '')) AND contains(lower(replace(p.p_brand, '#', '')), lower(replace(q.a, '#', ''))) GROUP BY 1""")
def l5(r: Roles):
    names = r.part.select(c("p_partkey").alias("_k"), c("p_name").alias("title"))
    asked = r.customer.select(c("c_mktsegment").alias("query"), F.concat(F.lit("Brand#"), c("c_custkey") % 9).alias("artist"), (c("c_custkey") % 50).alias("_k")).join(names, "_k")
    tracks = r.part.select(c("p_partkey").alias("track_id"), c("p_brand").alias("artist"), c("p_name").alias("title_key"))
    found = joins.contains_match(asked.select("query", "artist", "title"), tracks)
    return found.groupBy(c("query").alias("canon")).agg(F.count("*").alias("found"))


@query("l6_catalog_baseline", "SELECT p.persona, round(coalesce(sum(f.fit), 0) / (SELECT count(*) FROM tracks), 6) AS fit FROM (SELECT DISTINCT persona FROM persona_cluster) p LEFT JOIN o_fit f ON f.persona = p.persona GROUP BY 1")
def l6(r: Roles):
    return measure.catalog_baseline(r.fits, r.tracks, r.personas).withColumn("fit", F.round("fit", 6))


oracle_stage("o_run", """
    SELECT f.persona, CAST(10 * (1 + m.pos % 4) AS INTEGER) AS mode, m.playlist_id, avg(f.fit) AS fit FROM mix_track m JOIN o_fit f ON f.track_id = m.track_id GROUP BY 1, 2, 3""")
stage("l_run")(lambda r: r.keep(r.mix_track.join(r.fits.select("persona", "track_id", "fit"), "track_id").groupBy(
    "persona", (10 * (1 + c("pos") % 4)).cast("int").alias("mode"), "playlist_id").agg(F.avg("fit").alias("fit"))))


@query("l7_depth_roll_up", """
    WITH m AS (SELECT mode, avg(fit) AS fit FROM o_run GROUP BY 1), w AS (SELECT *, lag(fit) OVER (ORDER BY mode) AS p, lead(fit) OVER (ORDER BY mode) IS NULL AS l FROM m)
    SELECT bool_and(p IS NULL OR fit > p OR (l AND fit >= p - 0.05)) AS monotone, round(arg_max(fit, mode) - arg_min(fit, mode), 6) AS margin, round(avg(fit), 6) AS mean_fit,
      bool_and(p IS NULL OR fit > p OR (l AND fit >= p - 0.05)) AND arg_max(fit, mode) - arg_min(fit, mode) >= 0.3 AS accepted FROM w""")
def l7(r: Roles):
    return measure.acceptance(r.l_run).withColumns({"margin": F.round("margin", 6), "mean_fit": F.round("mean_fit", 6)})


@query("l8_variant_comparison", """
    SELECT a.persona, a.mode, round(avg(a.fit), 6) AS base, round(avg(b.fit), 6) AS variant, round(avg(b.fit - a.fit), 6) AS gain FROM o_run a
    JOIN (SELECT persona, mode, playlist_id, fit * 2 AS fit FROM o_run WHERE playlist_id % 2 = 0) b ON b.persona = a.persona AND b.mode = a.mode AND b.playlist_id = a.playlist_id GROUP BY 1, 2""")
def l8(r: Roles):
    base = r.l_run
    variant = base.where("playlist_id % 2 = 0").withColumn("fit", c("fit") * 2)
    both = base.withColumnRenamed("fit", "_a").join(variant.withColumnRenamed("fit", "_b"), ["persona", "mode", "playlist_id"])
    paired = measure.compare_variants(both.select("persona", "mode", "playlist_id", c("_a").alias("fit")), variant, ["persona", "mode", "playlist_id"])
    return paired.groupBy("persona", "mode").agg(*[F.round(F.avg(x), 6).alias(x) for x in ("base", "variant", "gain")])


@query("l9_calibration_sample", """
    WITH lo AS (SELECT min(hit) AS lo FROM (SELECT hit FROM tracks WHERE feature_source = 'model' ORDER BY hit DESC, track_id LIMIT 60)),
    t AS (SELECT track_id, hit FROM tracks WHERE feature_source = 'ab_direct' AND year IS NOT NULL), b AS (SELECT t.* FROM t, lo WHERE hit >= lo),
    p AS (SELECT * FROM b WHERE (SELECT count(*) FROM b) >= 20 UNION ALL SELECT * FROM t WHERE (SELECT count(*) FROM b) < 20),
    r AS (SELECT *, row_number() OVER (ORDER BY hit DESC, track_id) - 1 AS i, count(*) OVER () AS m FROM p)
    SELECT track_id, hit AS popularity FROM r WHERE i IN (SELECT CAST(floor(k * (SELECT max(m) FROM r) / 20.0) AS BIGINT) FROM range(20) AS g(k))""")
def l9(r: Roles):
    return measure.calibration_sample(r.tracks.select("track_id", c("hit").alias("popularity"), "feature_source", "year"), 20, 60)


@query("l10_ratings_calibration", """
    WITH b AS (SELECT track_id % 2 AS fold, dim, x, y FROM (SELECT track_id, 'energy' AS dim, CAST(1 + artist_rank % 5 AS DOUBLE) AS x, energy AS y FROM tracks UNION ALL SELECT track_id, 'vocal', CAST(1 + track_id % 5 AS DOUBLE), vocal FROM tracks)),
    f AS (SELECT 1 - fold AS fold, dim, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, avg(y) AS m FROM b GROUP BY 1, 2),
    e AS (SELECT b.dim, avg(abs(f.i + f.s * b.x - b.y)) AS mae, avg(abs(f.m - b.y)) AS base FROM b JOIN f ON f.dim = b.dim AND f.fold = b.fold GROUP BY 1),
    k AS (SELECT dim, corr(rx, ry) AS rho FROM (SELECT dim, rank() OVER (PARTITION BY dim ORDER BY x) + (count(*) OVER (PARTITION BY dim, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY dim ORDER BY y) + (count(*) OVER (PARTITION BY dim, y) - 1) / 2.0 AS ry FROM b) GROUP BY 1)
    SELECT e.dim, round(mae, 6) AS mae, round(base, 6) AS baseline, round(mae / base, 5) AS ratio, round(rho, 5) AS spearman FROM e JOIN k ON k.dim = e.dim""")
def l10(r: Roles):
    rows = r.tracks.select("track_id", (1 + c("artist_rank") % 5).alias("r_energy"), c("energy").alias("y_energy"), (1 + c("track_id") % 5).alias("r_vocal"), c("vocal").alias("y_vocal"))
    out = measure.ratings_calibration(rows, ["energy", "vocal"], c("track_id") % 2)
    return out.select("dim", F.round("mae", 6).alias("mae"), F.round("baseline", 6).alias("baseline"), F.round("ratio", 5).alias("ratio"), F.round("spearman", 5).alias("spearman"))


@query("l11_violation_tally", "SELECT rule, count(*) AS n FROM o_viol WHERE rule <> 'length' OR playlist_id % 3 <> 0 GROUP BY 1")
def l11(r: Roles):
    return measure.violation_tally(r.k_viol, r.playlist_track.where("playlist_id % 3 = 0").select("playlist_id"))


@query("l12_match_coverage", """
    WITH m AS (SELECT o_orderkey AS id, o_orderkey % 4 <> 0 AS has, CASE o_orderkey % 5 WHEN 0 THEN 'isrc' WHEN 1 THEN 'search' WHEN 2 THEN 'isrc' END AS via, o_orderkey % 3 = 0 AS rep FROM orders)
    SELECT count(*) AS requested, count(via) AS matched, count(*) FILTER (WHERE via = 'isrc') AS by_isrc, count(*) FILTER (WHERE has) AS with_isrc, count(*) FILTER (WHERE has AND via IS NOT NULL) AS with_isrc_matched,
      count(*) FILTER (WHERE via IS NULL AND rep) AS replaced, count(*) FILTER (WHERE via IS NULL AND NOT rep) AS missing FROM m""")
def l12(r: Roles):
    k = c("o_orderkey")
    tracks = r.orders.select(k.alias("left_id"), (k % 4 != 0).alias("has_isrc"), (k % 3 == 0).alias("replaced"))
    found = r.orders.where(k % 5 < 3).select(k.alias("left_id"), F.when(k % 5 == 1, "search").otherwise("isrc").alias("via"))
    return measure.match_coverage(tracks, found)
