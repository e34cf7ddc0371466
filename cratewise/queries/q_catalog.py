"""Catalog building from raw tables to finished rows (I1–I27 and the B, C, D, F operators inside)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratewise.functions.features import AUDIO_DIMS, DECADES, SCALED_DIMS
from cratewise.operators import joins
from cratewise.operators.ranking import row_numbers
from cratewise.plans import assemble, audio, genres, hits, impute, report, sample, select, songs
from cratewise.queries import duck
from cratewise.queries.registry import query
from cratewise.queries.roles import Roles, oracle_stage, stage
from cratewise.session import lookup

c = F.col
MIN_LENGTH = 30_000
DEDUPE = songs.Dedupe(min_listeners=8, min_share=0.2)
POOLS = [select.Pool("he", ("IL",), ("heb",), 300), select.Pool("fr", (), ("fra",), 250)]
_EVERY = 1_000_000_000  # stages keep every song; the top-n operators have their own queries
TEMPO = {"fast": ("PROMO", "SMALL"), "slow": ("LARGE", "ECONOMY")}

# --- songs ------------------------------------------------------------------------------------------
oracle_stage("o_id", "SELECT gid, id FROM recording UNION ALL SELECT gid, new_id FROM redirect")
oracle_stage("o_canon", """
    SELECT r.id AS recording, coalesce(t.target, r.id) AS canon FROM recording r LEFT JOIN
      (SELECT k.recording, min(i.id) AS target FROM canonical k JOIN o_id i ON i.gid = k.canonical GROUP BY 1) t ON t.recording = r.gid""")
oracle_stage("o_heard", """
    SELECT l.user_id, k.canon, l.gid, l.listens FROM listen l JOIN o_id i ON i.gid = l.gid JOIN o_canon k ON k.recording = i.id""")
oracle_stage("o_info", f"""
    SELECT r.id AS canon, r.gid, r.artist_credit AS first_artist, {duck.title_key('r.name')} AS nt, {duck.version('r.name')} AS vt, r.length_ms,
           coalesce(a.area IN (3, 9), false) OR regexp_matches(r.name, 'widget') AS seeded
    FROM recording r JOIN artist a ON a.id = r.artist_credit WHERE r.id IN (SELECT canon FROM o_canon)
      AND (coalesce(a.area IN (3, 9), false) OR regexp_matches(r.name, 'widget') OR r.artist_credit IN
           (SELECT x.artist_credit FROM recording x JOIN o_heard h ON h.canon = x.id))""")
oracle_stage("o_unit", f"""
    SELECT i.*, arg_min(i.canon, (CASE WHEN coalesce(i.length_ms, {MIN_LENGTH}) < {MIN_LENGTH} THEN 1 ELSE 0 END, -coalesce(p.u, 0), -coalesce(p.l, 0), i.gid))
             OVER (PARTITION BY i.first_artist, i.nt, i.vt) AS unit
    FROM o_info i LEFT JOIN (SELECT canon, count(DISTINCT user_id) AS u, sum(listens) AS l FROM o_heard GROUP BY 1) p ON p.canon = i.canon""")
oracle_stage("o_unit_pop", """
    SELECT u.unit, count(DISTINCT h.user_id) AS listeners, CAST(coalesce(sum(h.listens), 0) AS BIGINT) AS listens
    FROM o_unit u LEFT JOIN o_heard h ON h.canon = u.canon GROUP BY 1 HAVING count(h.user_id) > 0 OR bool_or(u.seeded)""")
oracle_stage("st_song", f"""
    SELECT song, gid, first_artist, nt AS norm_title, vt AS version_type, listeners AS proxy_listeners, listens AS proxy_listens, rk > 1 AS alt_version FROM (
      SELECT p.unit AS song, i.gid, i.first_artist, i.nt, i.vt, p.listeners, p.listens,
             row_number() OVER (PARTITION BY i.first_artist, i.nt ORDER BY p.listeners DESC, p.listens DESC, i.gid) AS rk,
             max(p.listeners) OVER (PARTITION BY i.first_artist, i.nt) AS best
      FROM o_unit_pop p JOIN o_info i ON i.canon = p.unit)
    WHERE rk = 1 OR (listeners >= {DEDUPE.min_listeners} AND listeners >= {DEDUPE.min_share} * best)""")
oracle_stage("st_song_rec", "SELECT u.unit AS song, k.recording FROM o_unit u JOIN st_song s ON s.song = u.unit JOIN o_canon k ON k.canon = u.canon")


# --- role tables dealt out by the key that their readers join on: the rows of their SQL, one shuffle for both -----------------------
@stage("listen")
def _listen(r: Roles):
    merged = F.when((c("l_partkey") % 11 == 0) & (c("l_linenumber") < 3), "mr").otherwise("r")
    rows = r.lineitem.where("l_partkey % 17 <> 3").join(r.orders, c("o_orderkey") == c("l_orderkey")).select(
        "o_custkey", "l_partkey", F.concat(merged, F.lpad(c("l_partkey").cast("string"), 9, "0")).alias("gid"), "l_quantity")
    summed = rows.repartition("gid").groupBy("o_custkey", "l_partkey", "gid").agg(F.sum("l_quantity").cast("bigint").alias("listens"))
    return summed.select(c("o_custkey").cast("int").alias("user_id"), "gid", "listens")


@stage("rec_work")
def _rec_work(r: Roles):
    rows = r.lineitem.where("l_partkey % 8 <> 2").select(c("l_partkey").cast("int").alias("recording"), c("l_orderkey").cast("int").alias("work"))
    return rows.repartition("recording").distinct()


@stage("isrc")
def _isrc(r: Roles):
    code = F.concat(F.lit("USABC"), F.lpad(c("l_orderkey").cast("string"), 7, "0"))
    rows = r.lineitem.where("l_partkey % 4 <> 2").select(c("l_partkey").cast("int").alias("recording"), code.alias("isrc"))
    return rows.repartition("recording").distinct()


@stage("song_tables")
def _song_tables(r: Roles):
    first = r.credit_name.where("position = 0").select("artist_credit", c("artist").alias("first_artist"))
    seeds = r.artist.where(c("area").isin(3, 9)).select(c("id").alias("first_artist"))
    return songs.build_songs(r.recording, r.redirect, r.canonical, r.listen, first, seeds, c("name").rlike("widget"), DEDUPE, MIN_LENGTH)


stage("st_song")(lambda r: r.song_tables["song"])
stage("st_song_rec")(lambda r: r.song_tables["song_rec"])


@query("i1_canonical_songs", "SELECT * FROM st_song")
def i1(r: Roles):
    return r.st_song


@query("i1_song_recordings", "SELECT * FROM st_song_rec")
def i1b(r: Roles):
    return r.st_song_rec


# --- attributes -------------------------------------------------------------------------------------
oracle_stage("o_rec_release", "SELECT DISTINCT t.recording, m.release FROM dump_track t JOIN medium m ON m.id = t.medium")
oracle_stage("o_release_year", "SELECT release, min(year) AS year FROM release_event WHERE year IS NOT NULL GROUP BY 1")
oracle_stage("o_country", """
    SELECT a.area, arg_min(i.code, (u.d, i.code)) AS country FROM (SELECT DISTINCT area FROM artist WHERE area IS NOT NULL) a JOIN (
      SELECT n0 AS area, n0 AS at, 0 AS d FROM (SELECT n_nationkey AS n0 FROM nation)
      UNION SELECT p.child, p.parent, 1 FROM area_parent p WHERE p.child NOT IN (SELECT area FROM area_iso)
      UNION SELECT p.child, q.parent, 2 FROM area_parent p JOIN area_parent q ON q.child = p.parent
        WHERE p.child NOT IN (SELECT area FROM area_iso) AND p.parent NOT IN (SELECT area FROM area_iso)
      UNION SELECT p.child, s.parent, 3 FROM area_parent p JOIN area_parent q ON q.child = p.parent JOIN area_parent s ON s.child = q.parent
        WHERE p.child NOT IN (SELECT area FROM area_iso) AND p.parent NOT IN (SELECT area FROM area_iso) AND q.parent NOT IN (SELECT area FROM area_iso)
    ) u ON u.area = a.area JOIN area_iso i ON i.area = u.at GROUP BY 1""")
oracle_stage("o_lang", """
    SELECT song, arg_min(lang, (-n, lang)) AS lang FROM (SELECT s.song, w.lang, count(*) AS n FROM st_song_rec s JOIN rec_work k ON k.recording = s.recording
      JOIN work_lang w ON w.work = k.work GROUP BY 1, 2) GROUP BY 1""")
oracle_stage("o_release_of", """
    SELECT s.song, CASE WHEN s.song % 4 = 0 THEN s.song % (SELECT count(*) FROM supplier) ELSE e.release END AS release FROM st_song s
    LEFT JOIN (SELECT x.recording, arg_min(x.release, (coalesce(y.year, 9999), x.release)) AS release FROM o_rec_release x
               LEFT JOIN o_release_year y ON y.release = x.release GROUP BY 1) e ON e.recording = s.song""")
oracle_stage("st_attr", f"""
    SELECT s.song, s.gid, s.first_artist, a.gid AS first_artist_gid, a.name AS artist_name, s.version_type, s.alt_version, s.proxy_listeners, s.proxy_listens,
           r.name AS title, r.artist_credit, r.length_ms, y.year, {duck.decade('y.year')} AS decade, coalesce(l.lang, e.lang) AS language_iso,
           CASE coalesce(l.lang, e.lang) WHEN 'eng' THEN 'lang_en' WHEN 'heb' THEN 'lang_he' WHEN 'fra' THEN 'lang_fr' WHEN 'spa' THEN 'lang_es'
             WHEN 'zxx' THEN 'none' ELSE CASE WHEN coalesce(l.lang, e.lang) IS NULL THEN 'unknown' ELSE 'lang_other' END END AS language,
           k.country AS artist_country, coalesce(i.isrcs, '') AS isrcs, e.name AS release_title, e.release_group,
           (SELECT string_agg(b.gid, ',' ORDER BY n.position) FROM credit_name n JOIN artist b ON b.id = n.artist WHERE n.artist_credit = r.artist_credit) AS artist_mbids
    FROM st_song s JOIN recording r ON r.id = s.song JOIN artist a ON a.id = s.first_artist
    LEFT JOIN (SELECT q.song, min(w.year) AS year FROM st_song_rec q JOIN o_rec_release x ON x.recording = q.recording
               JOIN o_release_year w ON w.release = x.release GROUP BY 1) y ON y.song = s.song
    LEFT JOIN o_lang l ON l.song = s.song LEFT JOIN o_country k ON k.area = a.area
    LEFT JOIN o_release_of f ON f.song = s.song LEFT JOIN release e ON e.id = f.release
    LEFT JOIN (SELECT q.song, string_agg(DISTINCT z.isrc, ',' ORDER BY z.isrc) AS isrcs FROM st_song_rec q JOIN isrc z ON z.recording = q.recording GROUP BY 1) i ON i.song = s.song""")


@stage("rec_release")
def _rec_release(r: Roles):
    return r.dump_track.join(r.medium, c("medium") == c("id")).select("recording", "release").distinct()


@stage("st_attr")
def _attr(r: Roles):
    years = r.release_event.where("year is not null").groupBy("release").agg(F.min("year").alias("year"))
    # Years meet media, which are few, before they meet tracks.
    dated = r.medium.join(years, "release").groupBy("id").agg(F.min("year").alias("year"))
    first_year = r.dump_track.join(dated, c("medium") == c("id")).groupBy("recording").agg(F.min("year").alias("year"))
    countries = joins.nearest_label(
        r.artist.where("area is not null").select(c("area").alias("node")), r.area_parent,
        r.area_iso.select(c("area").alias("node"), c("code").alias("label")),
    ).select(c("node").alias("area"), c("label").alias("country"))
    suppliers = r.release.agg(F.count("*").alias("_n"))
    named = r.st_song.where("song % 4 = 0").join(F.broadcast(suppliers), F.lit(True)).select(
        "gid", F.concat(F.lit("e"), (c("song") % c("_n")).cast("string")).alias("canonical_release"))
    releases = songs.song_releases(r.st_song, named, r.rec_release, years, r.release).drop("release")
    attrs = songs.song_attributes(
        r.st_song, songs.song_credits(r.st_song, r.recording, r.credit_name, r.artist), r.artist,
        songs.song_years(r.st_song_rec, first_year), songs.song_languages(r.st_song_rec, r.rec_work, r.work_lang),
        releases, countries, songs.song_isrcs(r.st_song_rec, r.isrc),
    )
    return r.keep(attrs)


@query("i2_song_attributes", "SELECT * FROM st_attr")
def i2(r: Roles):
    return r.st_attr.withColumns({"isrcs": F.array_join("isrcs", ","), "artist_mbids": F.array_join("artist_mbids", ",")})


_POOL_SQL = "coalesce(artist_country = 'IL', false) OR coalesce(language_iso = 'heb', false) OR coalesce(language_iso = 'fra', false)"


@query("i3_candidates", f"""
    SELECT song, rk AS proxy_rank FROM (SELECT *, row_number() OVER (ORDER BY proxy_listeners DESC, proxy_listens DESC, gid) AS rk FROM st_attr)
    WHERE rk <= 90 OR {_POOL_SQL}""")
def i3(r: Roles):
    return select.candidates(r.st_attr, 90, POOLS).select("song", "proxy_rank")


# --- tags, genres, drops ----------------------------------------------------------------------------
oracle_stage("st_tag", """
    SELECT s.song, 1 AS level, t.tag, CAST(sum(t.votes) AS BIGINT) AS votes FROM st_song_rec s JOIN recording_tag t ON t.entity = s.recording GROUP BY 1, 3
    UNION ALL SELECT a.song, 2, t.tag, CAST(sum(t.votes) AS BIGINT) FROM st_attr a JOIN rg_tag t ON t.entity = a.release_group GROUP BY 1, 3
    UNION ALL SELECT a.song, 3, t.tag, CAST(sum(t.votes) AS BIGINT) FROM st_attr a JOIN artist_tag t ON t.entity = a.first_artist GROUP BY 1, 3""")
oracle_stage("o_dim", "SELECT k AS cluster, ord FROM dims WHERE grp = 'genres'")
oracle_stage("o_mapped", "SELECT t.song, t.level, m.key AS cluster, t.votes, m.value FROM st_tag t JOIN tag_map m ON m.tag = t.tag JOIN o_dim d ON d.cluster = m.key")
oracle_stage("st_evidence", """
    SELECT song, cluster, sum(CAST(v / CAST(lv AS DOUBLE) AS DECIMAL(18,9)) * CAST(CASE level WHEN 1 THEN 1 WHEN 2 THEN 0.5 ELSE 0.25 END AS DECIMAL(4,2))) AS b
    FROM (SELECT *, sum(v) OVER (PARTITION BY song, level) AS lv FROM
      (SELECT song, level, cluster, CAST(sum(votes * CAST(value AS DECIMAL(9,4))) AS DOUBLE) AS v FROM o_mapped GROUP BY 1, 2, 3)) GROUP BY 1, 2""")
oracle_stage("st_source", "SELECT song, list_extract(['recording', 'release_group', 'artist'], min(level)) AS genre_source FROM o_mapped GROUP BY 1")
oracle_stage("o_ab_rec", f"SELECT i.id AS recording, count(*) AS n, {duck.sum_columns()} FROM ab_hl h JOIN o_id i ON i.gid = h.mbid GROUP BY 1")
oracle_stage("o_bpm", "SELECT i.id AS recording, h.bpm FROM ab_rhythm h JOIN o_id i ON i.gid = h.mbid")
oracle_stage("st_ab1", f"""
    SELECT p.*, t.bpm FROM (SELECT s.song, CAST(sum(n) AS BIGINT) AS n, {duck.mean_columns()} FROM st_song_rec s JOIN o_ab_rec a ON a.recording = s.recording GROUP BY 1) p
    LEFT JOIN (SELECT s.song, median(b.bpm) AS bpm FROM st_song_rec s JOIN o_bpm b ON b.recording = s.recording GROUP BY 1) t ON t.song = p.song""")
oracle_stage("st_evidence_ab", f"""
    SELECT u.song, m.cluster, sum(CAST(u.p AS DECIMAL(12,6)) * CAST(m.value AS DECIMAL(9,4))) AS b FROM
      (SELECT * FROM (SELECT song, {duck.GENRE_LIST} FROM st_ab1) UNPIVOT (p FOR class IN ({duck.GENRE_LIST}))) u
    JOIN tag_class m ON m.class = u.class JOIN o_dim d ON d.cluster = m.cluster WHERE u.p >= 0.3 AND u.song NOT IN (SELECT song FROM st_source) GROUP BY 1, 2""")
oracle_stage("st_cluster", """
    SELECT song, cluster, round(w / sum(w) OVER (PARTITION BY song), 3) AS w, rk FROM (
      SELECT x.song, x.cluster, x.w, row_number() OVER (PARTITION BY x.song ORDER BY x.w DESC, d.ord) AS rk FROM (
        SELECT song, cluster, CAST(b AS DOUBLE) / sum(CAST(b AS DOUBLE)) OVER (PARTITION BY song) AS w FROM
          (SELECT song, cluster, b FROM st_evidence UNION ALL SELECT song, cluster, b FROM st_evidence_ab)) x
      JOIN o_dim d ON d.cluster = x.cluster WHERE x.w >= 0.1) WHERE rk <= 4""")
oracle_stage("st_genre", """
    SELECT a.song, coalesce(s.genre_source, CASE WHEN a.song IN (SELECT song FROM st_evidence_ab) THEN 'ab' ELSE 'none' END) AS genre_source, k.cluster AS primary_cluster
    FROM st_attr a LEFT JOIN st_source s ON s.song = a.song LEFT JOIN st_cluster k ON k.song = a.song AND k.rk = 1""")
oracle_stage("st_nudge", """
    SELECT a.song, d.dim, t.tm AS tag_mean, coalesce(p.pr, 0) AS prior FROM st_attr a CROSS JOIN (VALUES ('complexity'), ('intensity')) AS d(dim)
    LEFT JOIN (SELECT g.song, m.key, CAST(sum(g.votes * g.lw * CAST(m.value AS DECIMAL(9,4))) AS DOUBLE) / CAST(sum(g.votes * g.lw) AS DOUBLE) AS tm FROM
        (SELECT *, CAST(CASE level WHEN 1 THEN 1 WHEN 2 THEN 0.5 ELSE 0.25 END AS DECIMAL(4,2)) AS lw FROM st_tag) g JOIN tag_map m ON m.tag = g.tag
        WHERE m.key IN ('complexity', 'intensity') GROUP BY 1, 2) t ON t.song = a.song AND t.key = d.dim
    LEFT JOIN (SELECT k.song, q.key, CAST(sum(CAST(k.w AS DECIMAL(9,4)) * CAST(q.value AS DECIMAL(9,4))) AS DOUBLE) AS pr FROM st_cluster k
        JOIN tag_prior q ON q.cluster = k.cluster GROUP BY 1, 2) p ON p.song = a.song AND p.key = d.dim""")
oracle_stage("o_vote", """
    SELECT song, arg_min(nm > gm, level) AS flag FROM (SELECT song, level, sum(CASE WHEN tag IN (SELECT tag FROM tag_nonmusic) THEN votes ELSE 0 END) AS nm,
        sum(CASE WHEN tag IN (SELECT tag FROM tag_map) THEN votes ELSE 0 END) AS gm FROM st_tag GROUP BY 1, 2) WHERE nm + gm > 0 GROUP BY 1""")
oracle_stage("st_drop", f"""
    SELECT a.song, CASE WHEN a.artist_name = 'Various Artists' THEN 'placeholder_artist' WHEN a.length_ms < {MIN_LENGTH} THEN 'too_short'
      WHEN regexp_matches(lower(a.title), '\\bkaraoke\\b|backing track') THEN 'title_pattern'
      WHEN a.release_group IN (SELECT release_group FROM rg_secondary WHERE type = 'interview') THEN 'release_type'
      WHEN v.flag THEN 'non_music_tag' END AS reason FROM st_attr a LEFT JOIN o_vote v ON v.song = a.song""")


@stage("clusters")
def _clusters(r: Roles):
    return lookup(r.spark, [tuple(x) for x in r.dims.where("grp = 'genres'").select("k", "ord").collect()], "cluster string, ord int")


stage("st_tag")(lambda r: r.keep(genres.candidate_tags(r.st_attr, r.st_song_rec, r.recording_tag, r.rg_tag, r.artist_tag)))
stage("st_evidence")(lambda r: genres.cluster_evidence(r.st_tag, r.tag_map, r.clusters))
stage("st_source")(lambda r: genres.evidence_level(r.st_tag, r.tag_map, r.clusters))
stage("ids")(lambda r: r.recording.select("gid", "id").unionByName(r.redirect.select("gid", c("new_id").alias("id"))))
stage("ab_sums")(lambda r: r.keep(audio.recording_sums(r.ab_hl, r.ids)))
stage("ab_bpm")(lambda r: audio.recording_bpm(r.ab_rhythm, r.ids))
stage("st_ab1")(lambda r: r.keep(audio.own_features(r.st_song_rec, r.ab_sums, r.ab_bpm)))
stage("st_evidence_ab")(lambda r: genres.classifier_evidence(r.st_ab1, r.st_source, r.tag_class, r.clusters))
stage("st_cluster")(lambda r: r.keep(genres.cluster_weights(r.st_evidence.unionByName(r.st_evidence_ab), r.clusters)))
stage("st_genre")(lambda r: r.keep(genres.genre_of(r.st_attr, r.st_cluster, r.st_source, r.st_evidence_ab)))
stage("st_nudge")(lambda r: genres.nudges(r.st_attr, r.st_tag, r.tag_map, r.st_cluster, r.tag_prior))
stage("votes")(lambda r: genres.non_music_votes(r.st_tag, r.tag_map, r.tag_nonmusic))
stage("st_drop")(lambda r: r.keep(genres.drop_reasons(r.st_attr, r.votes, r.rg_secondary, MIN_LENGTH)))


@query("i4_tag_evidence", "SELECT song, cluster, round(CAST(b AS DOUBLE), 6) AS b FROM st_evidence")
def i4(r: Roles):
    return r.st_evidence.withColumn("b", F.round(c("b").cast("double"), 6))


@query("i5_evidence_level", "SELECT * FROM st_source")
def i5(r: Roles):
    return r.st_source


@query("i6_classifier_evidence", "SELECT song, cluster, CAST(round(CAST(b AS DECIMAL(24, 10)), 5) AS DOUBLE) AS b FROM st_evidence_ab")
def i6(r: Roles):
    return r.st_evidence_ab.withColumn("b", F.round(c("b").cast("decimal(24,10)"), 5).cast("double"))


@query("i7_cluster_weights", "SELECT * FROM st_cluster")
def i7(r: Roles):
    return r.st_cluster


@query("e5_keep_top_shares", "SELECT song, count(*) AS n, round(sum(w), 2) AS total FROM st_cluster GROUP BY 1")
def e5(r: Roles):
    return r.st_cluster.groupBy("song").agg(F.count("*").alias("n"), F.round(F.sum("w"), 2).alias("total"))


@query("i7_genre_of_song", "SELECT * FROM st_genre")
def i7b(r: Roles):
    return r.st_genre


@query("i8_scalar_nudges", "SELECT song, dim, round(tag_mean, 9) AS tag_mean, round(prior, 9) AS prior FROM st_nudge")
def i8(r: Roles):
    return r.st_nudge.withColumns({"tag_mean": F.round("tag_mean", 9), "prior": F.round("prior", 9)})


@query("d13_weighted_tag_mean", "SELECT song, round(tag_mean, 9) AS m FROM st_nudge WHERE dim = 'intensity' AND tag_mean IS NOT NULL")
def d13(r: Roles):
    return r.st_nudge.where("dim = 'intensity' and tag_mean is not null").select("song", F.round("tag_mean", 9).alias("m"))


@query("b5_drop_reason", "SELECT * FROM st_drop")
def b5(r: Roles):
    return r.st_drop


@query("b6_non_music_vote", "SELECT * FROM o_vote")
def b6(r: Roles):
    return r.votes


# --- popularity, selection --------------------------------------------------------------------------
oracle_stage("o_kept", "SELECT a.* FROM st_attr a JOIN st_drop d ON d.song = a.song WHERE d.reason IS NULL")
oracle_stage("o_ask", """
    SELECT u.unit AS song, h.gid FROM o_heard h JOIN o_unit u ON u.canon = h.canon WHERE u.unit IN (SELECT song FROM o_kept)
    UNION SELECT song, gid FROM o_kept
    UNION SELECT unit, gid FROM o_unit WHERE unit IN (SELECT song FROM o_kept WHERE proxy_listeners = 0)""")
oracle_stage("st_pop", """
    SELECT k.song, coalesce(p.u, k.proxy_listeners) AS listeners, CAST(coalesce(p.l, k.proxy_listens) AS BIGINT) AS listens, p.u IS NOT NULL AS from_api
    FROM o_kept k LEFT JOIN (SELECT a.song, max(b.users) AS u, sum(b.listens) AS l FROM o_ask a JOIN
        (SELECT gid, arg_max(users, coalesce(users, -1)) AS users, arg_max(listens, coalesce(users, -1)) AS listens FROM
           (SELECT DISTINCT ON (gid) gid, users, listens FROM pop_cache ORDER BY gid, users DESC NULLS LAST, listens DESC NULLS LAST) GROUP BY 1) b
      ON b.gid = a.gid GROUP BY 1) p ON p.song = k.song""")
oracle_stage("o_ranked", f"""
    SELECT k.song, p.listeners, p.listens, coalesce(artist_country = 'IL', false) OR coalesce(language_iso = 'heb', false) AS a,
           coalesce(language_iso = 'fra', false) AS b, row_number() OVER (ORDER BY p.listeners DESC, p.listens DESC, k.gid) AS rk
    FROM o_kept k JOIN st_pop p ON p.song = k.song""")
oracle_stage("st_sel", "SELECT k.*, r.listeners, r.listens, r.rk, 'rank' AS via FROM o_kept k JOIN o_ranked r ON r.song = k.song")


@stage("kept")
def _kept(r: Roles):
    return r.keep(r.st_attr.join(r.st_drop.where("reason is null").select("song"), "song", "left_semi"))


@stage("st_pop")
def _pop(r: Roles):
    from cratewise.sources.rules import best_snapshot

    t = r.song_tables
    unit = t["unit"].select("canon", c("unit").alias("song"), "gid")
    heard = t["heard"].select("canon", "gid").distinct().join(unit.select("canon", "song"), "canon").select("song", "gid")
    asked = select.ids_to_ask(r.kept.select("song", "gid", "proxy_listeners"), heard, unit.select("song", "gid"))
    return r.keep(select.final_popularity(r.kept.select("song", "proxy_listeners", "proxy_listens"), asked, best_snapshot(r.pop_cache)))


@stage("st_sel")
def _sel(r: Roles):
    picked, _ = select.select_with_quotas(r.kept, r.st_pop, _EVERY, POOLS)
    return r.keep(r.kept.join(picked, "song"))


@query("d25_popularity_merge", "SELECT * FROM st_pop")
def d25(r: Roles):
    return r.st_pop


@query("f2_quota_selection", """
    WITH s0 AS (SELECT song, rk, a, b, 'rank' AS via FROM o_ranked WHERE rk <= 40),
    n1 AS (SELECT greatest(0, 30 - count(*)) AS n FROM s0 WHERE a),
    add1 AS (SELECT song, rk, a, b, 'quota:he' AS via FROM (SELECT *, row_number() OVER (ORDER BY rk) AS i FROM o_ranked WHERE a AND listeners > 0 AND song NOT IN (SELECT song FROM s0)) WHERE i <= (SELECT n FROM n1)),
    out1 AS (SELECT song FROM (SELECT song, row_number() OVER (ORDER BY rk DESC) AS i FROM s0 WHERE NOT a AND NOT b) WHERE i <= (SELECT count(*) FROM add1)),
    s1 AS (SELECT * FROM s0 WHERE song NOT IN (SELECT song FROM out1) UNION ALL SELECT * FROM add1),
    n2 AS (SELECT greatest(0, 25 - count(*)) AS n FROM s1 WHERE b),
    add2 AS (SELECT song, rk, a, b, 'quota:fr' AS via FROM (SELECT *, row_number() OVER (ORDER BY rk) AS i FROM o_ranked WHERE b AND listeners > 0 AND song NOT IN (SELECT song FROM s1)) WHERE i <= (SELECT n FROM n2)),
    out2 AS (SELECT song FROM (SELECT song, row_number() OVER (ORDER BY rk DESC) AS i FROM s1 WHERE NOT a AND NOT b) WHERE i <= (SELECT count(*) FROM add2))
    SELECT song, rk, via FROM s1 WHERE song NOT IN (SELECT song FROM out2) UNION ALL SELECT song, rk, via FROM add2""")
def f2(r: Roles):
    pools = [select.Pool("he", ("IL",), ("heb",), 30), select.Pool("fr", (), ("fra",), 25)]
    picked, _ = select.select_with_quotas(r.kept, r.st_pop, 40, pools)
    return picked.select("song", "rk", "via")


# --- features ---------------------------------------------------------------------------------------
_AXES = """
    2 * (0.4 * (1 - mood_relaxed__relaxed) + 0.3 * mood_party__party + 0.3 * mood_aggressive__aggressive) - 1 AS energy,
    mood_happy__happy - mood_sad__sad AS valence, 2 * danceability__danceable - 1 AS dance, mood_acoustic__acoustic - mood_electronic__electronic AS acoustic,
    2 * mood_aggressive__aggressive - 1 AS intensity, 2 * voice_instrumental__voice - 1 AS vocal"""
_TEMPO = """CASE WHEN bpm IS NOT NULL THEN greatest(-1, least(1, (CASE WHEN bpm < 70 AND primary_cluster IN ('PROMO', 'SMALL') THEN bpm * 2
    WHEN bpm > 165 AND primary_cluster IN ('LARGE', 'ECONOMY') THEN bpm / 2 ELSE bpm END - 120) / 60)) END AS tempo"""
for _n in (1, 2):
    oracle_stage(f"st_dims{_n}", f"SELECT f.song, {_AXES}, {_TEMPO}, {duck.CERTAINTY} AS certainty, bpm, n FROM st_ab{_n} f JOIN st_genre g ON g.song = f.song")
oracle_stage("o_own", "SELECT s.song, s.recording, a.first_artist FROM st_song_rec s JOIN st_sel a ON a.song = s.song WHERE s.song NOT IN (SELECT song FROM st_ab1)")
oracle_stage("o_sib", """
    SELECT song, recording FROM (
      SELECT o.song, y.recording FROM o_own o JOIN isrc x ON x.recording = o.recording JOIN isrc y ON y.isrc = x.isrc
      UNION SELECT o.song, y.recording FROM o_own o JOIN rec_work x ON x.recording = o.recording JOIN rec_work y ON y.work = x.work
        JOIN recording z ON z.id = y.recording JOIN credit_name n ON n.artist_credit = z.artist_credit AND n.artist = o.first_artist)
    WHERE recording IN (SELECT recording FROM o_ab_rec) EXCEPT SELECT song, recording FROM o_own""")
oracle_stage("st_ab2", f"""
    SELECT p.*, t.bpm FROM (SELECT s.song, CAST(sum(n) AS BIGINT) AS n, {duck.mean_columns()} FROM o_sib s JOIN o_ab_rec a ON a.recording = s.recording GROUP BY 1) p
    LEFT JOIN (SELECT s.song, median(b.bpm) AS bpm FROM o_sib s JOIN o_bpm b ON b.recording = s.recording GROUP BY 1) t ON t.song = p.song""")


@stage("st_ab2")
def _ab2(r: Roles):
    need = r.st_sel.select("song", "first_artist").join(r.st_ab1.select("song"), "song", "left_anti")
    keys = audio.sharing_keys(r.isrc, r.rec_work, r.recording, r.credit_name)
    return r.keep(audio.sibling_features(need, r.st_song_rec, r.isrc, r.rec_work, keys, r.ab_sums, r.ab_bpm))


stage("st_dims1")(lambda r: r.keep(audio.raw_axes(r.st_ab1, r.st_genre, **TEMPO)))
stage("st_dims2")(lambda r: audio.raw_axes(r.st_ab2, r.st_genre, **TEMPO))
_ROUND_AB = "song, n, round(mood_happy__happy, 8) AS happy, round(genre_rosamerica__spe, 8) AS spe, bpm"


def _rounded_ab(df):
    return df.select("song", "n", F.round("mood_happy__happy", 8).alias("happy"), F.round("genre_rosamerica__spe", 8).alias("spe"), "bpm")


@query("i9_own_features", f"SELECT {_ROUND_AB} FROM st_ab1")
def i9(r: Roles):
    return _rounded_ab(r.st_ab1)


@query("i10_sibling_features", f"SELECT {_ROUND_AB} FROM st_ab2")
def i10(r: Roles):
    return _rounded_ab(r.st_ab2)


_DIM_ROUND = ", ".join(f"round({d}, 8) AS {d}" for d in (*AUDIO_DIMS, "certainty"))


@query("i11_raw_axes", f"SELECT song, 1 AS tier, {_DIM_ROUND} FROM st_dims1 UNION ALL SELECT song, 2, {_DIM_ROUND} FROM st_dims2")
def i11(r: Roles):
    rows = lambda df, n: df.select("song", F.lit(n).alias("tier"), *[F.round(d, 8).alias(d) for d in (*AUDIO_DIMS, "certainty")])
    return rows(r.st_dims1, 1).unionByName(rows(r.st_dims2, 2))


# --- imputation -------------------------------------------------------------------------------------
_B20 = "CAST(('0x' || substr(md5({0}), 1, 7)) AS BIGINT) % 20"
oracle_stage("o_imp", f"""
    SELECT a.song, a.decade, a.language, a.first_artist, a.release_group, a.proxy_listeners, d.energy, d.song IS NOT NULL AS has_y, {_B20.format('a.first_artist_gid')} = 0 AS held,
      CASE WHEN d.song IS NULL AND a.song IN (SELECT song FROM st_sel) AND a.song NOT IN (SELECT song FROM st_ab2) THEN 4 WHEN d.song IS NULL THEN -1
        WHEN {_B20.format('a.first_artist_gid')} = 0 THEN 3 WHEN {_B20.format('a.gid')} = 0 THEN 2 WHEN {_B20.format('a.gid')} = 1 THEN 1 ELSE 0 END AS split
    FROM st_attr a LEFT JOIN st_dims1 d ON d.song = a.song
    WHERE d.song IS NOT NULL OR (a.song IN (SELECT song FROM st_sel) AND a.song NOT IN (SELECT song FROM st_ab2))""")


@stage("imp_base")
def _imp_base(r: Roles):
    known = r.st_dims1.select("song").unionByName(r.st_ab2.select("song"))
    targets = r.st_sel.select("song").join(known, "song", "left_anti")
    return impute.base_rows(r.st_attr, r.st_dims1, targets, list(AUDIO_DIMS))


@stage("imp_design")
def _imp_design(r: Roles):
    clusters = [x["k"] for x in r.dims.where("grp = 'genres'").orderBy("ord").select("k").collect()]
    rows, shared = impute.design_matrix(r.imp_base, r.st_cluster, clusters, list(DECADES), list(AUDIO_DIMS))
    return r.keep(rows), shared


stage("imp_model")(lambda r: impute.fit(*r.imp_design, list(AUDIO_DIMS)))
stage("st_model")(lambda r: r.keep(impute.predict(r.imp_design[0], r.imp_model)))


@query("i12_hash_split", "SELECT song, split FROM o_imp")
def i12(r: Roles):
    return r.imp_base.select("song", "split")


@query("i13_design_matrix", """
    WITH m AS (SELECT avg(energy) AS mu, avg(ln(1 + proxy_listeners)) AS ll, stddev_pop(ln(1 + proxy_listeners)) AS sd FROM o_imp WHERE split = 0),
    g AS (SELECT first_artist, count(*) AS n, sum(CAST(energy AS DECIMAL(28,9))) AS s FROM o_imp WHERE has_y GROUP BY 1)
    SELECT b.song, round((ln(1 + proxy_listeners) - ll) / sd, 8) AS loglisten, coalesce(k.w, 0) AS w_promo, CAST(coalesce(decade = 'dec80', false) AS INTEGER) AS d80,
      CAST(decade IS NULL AS INTEGER) AS d_unknown, CAST(language = 'lang_he' AS INTEGER) AS he,
      CASE WHEN held OR coalesce(n, 0) - CAST(has_y AS INTEGER) <= 0 THEN 0 ELSE 1 END AS has_art,
      round(CASE WHEN held OR coalesce(n, 0) - CAST(has_y AS INTEGER) <= 0 THEN mu ELSE (CAST(s AS DOUBLE) - (CASE WHEN has_y THEN energy ELSE 0 END) + 2 * mu) / (n - CAST(has_y AS INTEGER) + 2) END, 8) AS art_energy
    FROM o_imp b CROSS JOIN m LEFT JOIN g ON g.first_artist = b.first_artist LEFT JOIN st_cluster k ON k.song = b.song AND k.cluster = 'PROMO'""")
def i13(r: Roles):
    rows, _ = r.imp_design
    return rows.select(
        "song", F.round("loglisten", 8).alias("loglisten"), c("w_PROMO").alias("w_promo"), c("d_dec80").cast("int").alias("d80"), c("d_unknown").cast("int").alias("d_unknown"),
        c("l_lang_he").cast("int").alias("he"), c("has_art").cast("int").alias("has_art"), F.round("art_energy", 8).alias("art_energy"))


@query("i14_ridge_predictions")
def i14(r: Roles):
    return r.st_model.select("song", "model_has_artist", *[F.round(d, 4).alias(d) for d in AUDIO_DIMS])


@query("i15_imputation_report")
def i15(r: Roles):
    out = impute.holdout_report(r.imp_design[0], r.imp_model)
    return out.select("dim", "split", "decade", "n", F.round("mae", 4).alias("mae"), F.round("baseline", 4).alias("baseline"))


@query("n3_training_by_partial_sums", "SELECT count(*) AS n, count(*) FILTER (WHERE decade = 'dec80') AS eighties FROM o_imp WHERE split = 0")
def n3(r: Roles):
    rows, shared = r.imp_design
    gram = impute.gram_sums(rows.where("split = 0"), shared, ["energy"])
    at = 1 + shared.index("d_dec80")
    cell = lambda i, j, n: F.max(F.when((c("i") == i) & (c("j") == j), c("value"))).cast("long").alias(n)
    return gram.agg(cell(0, 0, "n"), cell(0, at, "eighties"))


# --- hits -------------------------------------------------------------------------------------------
oracle_stage("st_signal", """
    SELECT s.song, count(h.release_group) AS release_groups, count(h.release_group) FILTER (WHERE h.comp) AS comps, count(h.release_group) FILTER (WHERE h.comp AND h.va) AS va_comps
    FROM st_sel s LEFT JOIN (SELECT DISTINCT q.song, e.release_group, e.release_group IN (SELECT release_group FROM rg_secondary WHERE type = 'compilation') AS comp,
        e.release_group IN (SELECT g.id FROM release_group g JOIN credit_name n ON n.artist_credit = g.artist_credit WHERE n.artist = 3) AS va
      FROM st_song_rec q JOIN o_rec_release x ON x.recording = q.recording JOIN release e ON e.id = x.release WHERE e.status IS NULL OR e.status IN (1, 2)) h ON h.song = s.song GROUP BY 1""")
oracle_stage("st_base", f"""
    SELECT s.song, s.gid, s.first_artist, s.first_artist_gid, s.decade, s.listeners, s.proxy_listeners, {duck.title_key('s.title')} AS nt, g.release_groups, g.comps, g.va_comps,
           k.tier AS cur_tier, k.mbid IS NOT NULL OR (s.language = 'lang_he' AND coalesce(s.artist_country, 'IL') = 'IL') AS il
    FROM st_sel s JOIN st_signal g ON g.song = s.song LEFT JOIN curated k ON k.mbid = s.first_artist_gid""")
oracle_stage("st_fame", """
    SELECT first_artist, il_fame, il_artist, CASE WHEN il_artist THEN row_number() OVER (PARTITION BY il_artist ORDER BY il_fame DESC, artist_gid) END AS il_fame_rank FROM (
      SELECT first_artist, max(first_artist_gid) AS artist_gid, max(cur_tier) IS NOT NULL OR (count(*) FILTER (WHERE il) > 0 AND count(*) FILTER (WHERE il) >= count(*) FILTER (WHERE NOT il)) AS il_artist,
        round(ln(1 + count(*) FILTER (WHERE il)) + ln(1 + coalesce(sum(comps) FILTER (WHERE il), 0)) + 0.5 * ln(1 + coalesce(max(listeners) FILTER (WHERE il), 0)), 6) AS il_fame
      FROM st_base GROUP BY 1)""")
oracle_stage("st_pin", f"SELECT b.song, min(p.k) AS pin FROM st_base b JOIN pins p ON p.mbid = b.first_artist_gid AND {duck.title_key('p.title')} = b.nt GROUP BY 1")
oracle_stage("st_rank", """
    SELECT *, row_number() OVER (PARTITION BY first_artist ORDER BY pin NULLS LAST, CASE WHEN il_artist THEN (pl + pg + pv) / 3 ELSE (pp + pv) / 2 END DESC, proxy_listeners DESC, listeners DESC, gid) AS artist_rank
    FROM (SELECT b.*, f.il_fame, f.il_artist, f.il_fame_rank, p.pin, percent_rank() OVER (PARTITION BY b.first_artist ORDER BY b.proxy_listeners) AS pp,
            percent_rank() OVER (PARTITION BY b.first_artist ORDER BY b.va_comps) AS pv, percent_rank() OVER (PARTITION BY b.first_artist ORDER BY b.listeners) AS pl,
            percent_rank() OVER (PARTITION BY b.first_artist ORDER BY b.release_groups) AS pg
          FROM st_base b JOIN st_fame f ON f.first_artist = b.first_artist LEFT JOIN st_pin p ON p.song = b.song)""")
oracle_stage("st_hits", """
    WITH k AS (SELECT *, CASE WHEN il THEN 'il' ELSE 'intl' END AS market,
        round(CASE WHEN il THEN 100 * coalesce(4 - cur_tier, 0) + il_fame - 2 * ln(artist_rank) ELSE ln(1 + proxy_listeners) + 0.5 * ln(1 + va_comps) END, 6) AS hk FROM st_rank),
    v AS (SELECT *, row_number() OVER (PARTITION BY decade, market ORDER BY hk DESC, gid) AS dr, count(*) OVER (PARTITION BY decade, market) AS dn,
        percent_rank() OVER (PARTITION BY decade, market ORDER BY hk, gid) AS hp, percent_rank() OVER (PARTITION BY market ORDER BY hk, gid) AS mp FROM k),
    h AS (SELECT *, artist_rank <= 3 AND CASE WHEN market = 'intl' THEN decade IS NOT NULL AND dr <= ceil(0.1 * dn) ELSE cur_tier IS NOT NULL END AS hit FROM v)
    SELECT song, proxy_listeners, release_groups, comps, va_comps, market, artist_rank, round(hp, 6) AS hit_pct, round(mp, 6) AS popularity_pct,
           CAST(CASE WHEN hit THEN 0 WHEN bool_or(hit) OVER (PARTITION BY first_artist) THEN 1 ELSE 2 END AS INTEGER) AS tier FROM h""")

stage("st_signal")(lambda r: hits.hit_signals(
    r.st_sel, r.st_song_rec, r.rec_release, r.release, r.release_group, r.rg_secondary,
    r.credit_name.join(r.artist.where("name = 'Various Artists'").select(c("id").alias("artist")), "artist", "left_semi").select("artist_credit"),
))
stage("st_base")(lambda r: r.keep(hits.hit_base(r.st_sel, r.st_signal, r.curated)))
stage("st_fame")(lambda r: hits.artist_fame(r.st_base))
stage("st_pin")(lambda r: hits.pinned_songs(r.st_base, r.pins))
stage("st_rank")(lambda r: r.keep(hits.artist_ranks(r.st_base, r.st_fame, r.st_pin)))
stage("st_hits")(lambda r: r.keep(hits.hit_tiers(r.st_rank)))


@query("i17_market_assignment", "SELECT song, CASE WHEN il THEN 'il' ELSE 'intl' END AS market FROM st_base")
def i17(r: Roles):
    return r.st_base.select("song", F.when(c("il"), "il").otherwise("intl").alias("market"))


@query("i18_hit_signals", "SELECT * FROM st_signal")
def i18(r: Roles):
    return r.st_signal


@query("i19_artist_fame", "SELECT * FROM st_fame")
def i19(r: Roles):
    return r.st_fame


@query("i20_pins", "SELECT * FROM st_pin")
def i20(r: Roles):
    return r.st_pin


@query("i20_unmatched_pins", f"SELECT mbid, k, title FROM pins p WHERE NOT EXISTS (SELECT 1 FROM st_base b WHERE b.first_artist_gid = p.mbid AND b.nt = {duck.title_key('p.title')})")
def i20b(r: Roles):
    return hits.unmatched_pins(r.st_base, r.pins)


@query("i21_artist_rank", "SELECT song, artist_rank FROM st_rank")
def i21(r: Roles):
    return r.st_rank.select("song", "artist_rank")


@query("i22_hit_tiers", "SELECT * FROM st_hits")
def i22(r: Roles):
    return r.st_hits


@query("i22_known_songs", """
    WITH k AS (SELECT track_id, artist, decade, market, listeners, row_number() OVER (PARTITION BY artist ORDER BY listeners DESC, track_id) AS rk,
                 round(percent_rank() OVER (PARTITION BY decade, market ORDER BY listeners, track_id), 6) AS pct FROM tracks)
    SELECT track_id, rk, pct, CAST(CASE WHEN rk <= 3 AND pct >= 0.9 THEN 0 WHEN bool_or(rk <= 3 AND pct >= 0.9) OVER (PARTITION BY artist) THEN 1 ELSE 2 END AS INTEGER) AS tier FROM k""")
def i22b(r: Roles):
    t = r.tracks.select("track_id", "artist", "decade", "market", "listeners")
    rank = row_numbers(t, ["artist"], [c("listeners").desc(), c("track_id").asc()]).select("track_id", "artist", "rk")
    up = row_numbers(t, ["decade", "market"], [c("listeners").asc(), c("track_id").asc()], "u", "m")
    pct = F.round(F.when(c("m") > 1, (c("u") - 1) / (c("m") - 1)).otherwise(F.lit(0.0)), 6)
    both = rank.join(up.select("track_id", pct.alias("pct")), "track_id").withColumn("hit", (c("rk") <= 3) & (c("pct") >= 0.9))
    known = both.groupBy("artist").agg(F.bool_or("hit").alias("any"))
    return both.join(known, "artist").select("track_id", "rk", "pct", F.when(c("hit"), 0).when(c("any"), 1).otherwise(2).alias("tier"))


# --- assembly, sample, report -----------------------------------------------------------------------
_T = {d: f"coalesce(a.{d}, b.{d})" for d in AUDIO_DIMS}
oracle_stage("o_raw", f"""
    SELECT s.song, CASE WHEN a.song IS NOT NULL THEN 'ab_direct' WHEN b.song IS NOT NULL THEN 'ab_sibling' ELSE 'model' END AS feature_source,
      {_T['energy']} AS raw_energy, {_T['valence']} AS raw_valence, coalesce({_T['tempo']}, 0) AS raw_tempo, coalesce(a.bpm, b.bpm) AS raw_bpm,
      greatest(-1, least(1, {_T['intensity']} + 0.5 * coalesce(i.tag_mean, 0) + i.prior)) AS raw_intensity,
      CASE WHEN x.tag_mean IS NULL THEN x.prior ELSE 0.5 * x.tag_mean + 0.5 * x.prior END AS raw_complexity,
      CASE WHEN a.song IS NOT NULL THEN 0.75 + 0.25 * a.certainty ELSE 0.8 * (0.75 + 0.25 * b.certainty) END AS confidence
    FROM st_sel s LEFT JOIN st_dims1 a ON a.song = s.song LEFT JOIN st_dims2 b ON b.song = s.song
    JOIN st_nudge i ON i.song = s.song AND i.dim = 'intensity' JOIN st_nudge x ON x.song = s.song AND x.dim = 'complexity'""")

stage("st_raw")(lambda r: r.keep(assemble.merge_tiers(r.st_sel, r.st_dims1, r.st_dims2, r.st_model, r.st_nudge)))
stage("st_catalog")(lambda r: r.keep(assemble.build_catalog(r.st_sel, r.st_raw, r.st_hits, r.st_genre, r.st_cluster, r.clusters, "v1")))


_TIER_AXES = ("raw_energy", "raw_intensity", "raw_complexity", "raw_tempo")


@query("i16_merged_tiers")
def i16(r: Roles):
    """All three tiers. SQL cannot express the model's predictions: see ``i16_tier_sources``, ``i16_measured_axes`` and tests/test_catalog_rules.py."""
    return r.st_raw.select("song", "feature_source", *[F.round(x, 8).alias(x) for x in _TIER_AXES], "raw_bpm", F.round("confidence", 8).alias("confidence"))


@query("i16_tier_sources", f"""
    WITH mu AS (SELECT song, CASE WHEN held OR coalesce(n, 0) - CAST(has_y AS INTEGER) <= 0 THEN 0 ELSE 1 END AS has_art FROM o_imp b LEFT JOIN (SELECT first_artist, count(*) AS n FROM o_imp WHERE has_y GROUP BY 1) g ON g.first_artist = b.first_artist)
    SELECT o.song, o.feature_source, round(o.raw_complexity, 8) AS raw_complexity, o.raw_bpm, round(CASE WHEN o.feature_source <> 'model' THEN o.confidence WHEN m.has_art = 1 THEN 0.6 ELSE 0.45 END, 8) AS confidence
    FROM o_raw o LEFT JOIN mu m ON m.song = o.song""")
def i16_sources(r: Roles):
    return r.st_raw.select("song", "feature_source", F.round("raw_complexity", 8).alias("raw_complexity"), "raw_bpm", F.round("confidence", 8).alias("confidence"))


@query("i16_measured_axes", """
    SELECT song, feature_source, round(raw_energy, 8) AS raw_energy, round(raw_intensity, 8) AS raw_intensity, round(raw_complexity, 8) AS raw_complexity,
           round(raw_tempo, 8) AS raw_tempo, raw_bpm, round(confidence, 8) AS confidence FROM o_raw WHERE feature_source <> 'model'""")
def i16_measured(r: Roles):
    measured = r.st_raw.join(r.st_dims1.select("song").union(r.st_dims2.select("song")), "song", "left_semi")
    return measured.select("song", "feature_source", *[F.round(x, 8).alias(x) for x in _TIER_AXES], "raw_bpm", F.round("confidence", 8).alias("confidence"))


@query("i23_catalog_assembly", """
    SELECT s.gid AS track_id, s.title, s.year, s.decade, s.language, g.primary_cluster, h.tier, h.artist_rank, h.market, CAST(round(2 * CAST(h.popularity_pct AS DECIMAL(8, 6)) - 1, 4) AS DOUBLE) AS mainstream,
           CASE WHEN d.song IS NOT NULL THEN 'ab_direct' WHEN b.song IS NOT NULL THEN 'ab_sibling' ELSE 'model' END AS feature_source, s.via AS selected_via,
           coalesce((SELECT string_agg(k.cluster || '=' || CAST(k.w AS VARCHAR), ',' ORDER BY o.ord) FROM st_cluster k JOIN o_dim o ON o.cluster = k.cluster WHERE k.song = s.song), '') AS clusters,
           CAST(round(CAST(round(CASE WHEN x.tag_mean IS NULL THEN x.prior ELSE 0.5 * x.tag_mean + 0.5 * x.prior END, 9) AS DECIMAL(18,9)), 4) AS DOUBLE) AS raw_complexity
    FROM st_sel s JOIN st_hits h ON h.song = s.song JOIN st_genre g ON g.song = s.song LEFT JOIN st_dims1 d ON d.song = s.song LEFT JOIN st_ab2 b ON b.song = s.song
    JOIN st_nudge x ON x.song = s.song AND x.dim = 'complexity'""")
def i23(r: Roles):
    text = F.transform(F.map_entries("clusters"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return r.st_catalog.select(
        "track_id", "title", "year", "decade", "language", "primary_cluster", "tier", "artist_rank", "market", "mainstream", "feature_source", "selected_via",
        F.array_join(text, ",").alias("clusters"), "raw_complexity")


@query("i23_scaled_axes")
def i23b(r: Roles):
    return r.st_catalog.select("track_id", *SCALED_DIMS)


@query("i24_index_encoding", """
    WITH a AS (SELECT first_artist_gid, row_number() OVER (ORDER BY first_artist_gid) - 1 AS artist_id FROM (SELECT DISTINCT first_artist_gid FROM st_sel)),
    t AS (SELECT nt, row_number() OVER (ORDER BY nt) - 1 AS title_id FROM (SELECT DISTINCT norm_title AS nt FROM st_song WHERE song IN (SELECT song FROM st_sel))),
    z AS (SELECT k.song, o.ord, k.w, row_number() OVER (PARTITION BY k.song ORDER BY k.w DESC, o.ord) AS i FROM st_cluster k JOIN o_dim o ON o.cluster = k.cluster)
    SELECT s.gid AS track_id, a.artist_id, t.title_id, CAST(coalesce(z1.ord, 255) AS INTEGER) AS slot0, CAST(coalesce(z2.ord, 255) AS INTEGER) AS slot1, coalesce(z1.w, 0.0) AS weight0,
           CAST(coalesce(d.ord, 255) AS INTEGER) AS decade, CAST(CASE WHEN s.language = 'none' THEN 254 ELSE coalesce(l.ord, 255) END AS INTEGER) AS language
    FROM st_sel s JOIN a ON a.first_artist_gid = s.first_artist_gid JOIN st_song q ON q.song = s.song JOIN t ON t.nt = q.norm_title
    LEFT JOIN z z1 ON z1.song = s.song AND z1.i = 1 LEFT JOIN z z2 ON z2.song = s.song AND z2.i = 2
    LEFT JOIN dims d ON d.grp = 'decades' AND d.k = s.decade LEFT JOIN dims l ON l.grp = 'languages' AND l.k = s.language""")
def i24(r: Roles):
    keys = {g: [x["k"] for x in r.dims.where(c("grp") == g).orderBy("ord").select("k").collect()] for g in ("genres", "decades", "languages")}
    coded = assemble.encode(r.st_catalog, keys["genres"], keys["decades"], keys["languages"])
    return coded.select("track_id", "artist_id", "title_id", "slot0", "slot1", "weight0", "decade", "language")


_CAT_VIEW = """
    SELECT artist, title AS artist_credit, title, artist_rank AS comps, listeners, market, country AS artist_country, artist_rank, track_id FROM tracks"""


@query("i25_curated_draft", """
    WITH f AS (SELECT artist, count(*) FILTER (WHERE il) AS songs, round(ln(1 + count(*) FILTER (WHERE il)) + ln(1 + coalesce(sum(artist_rank) FILTER (WHERE il), 0))
          + 0.5 * ln(1 + coalesce(max(listeners) FILTER (WHERE il), 0)), 9) AS fame FROM (SELECT *, market = 'il' OR coalesce(country = 'IL', false) AS il FROM tracks) GROUP BY 1),
    p AS (SELECT artist, songs, row_number() OVER (ORDER BY fame DESC, artist) AS pos FROM f WHERE songs > 0)
    SELECT p.artist, p.songs, p.pos, CAST(CASE WHEN pos <= 5 THEN 1 WHEN pos <= 12 THEN 2 ELSE 3 END AS INTEGER) AS tier,
      (SELECT title FROM tracks t WHERE t.artist = p.artist GROUP BY title ORDER BY count(*) DESC, title LIMIT 1) AS name,
      coalesce((SELECT string_agg(title, ',' ORDER BY artist_rank, title) FROM tracks t WHERE t.artist = p.artist AND artist_rank <= 3), '') AS top FROM p WHERE pos <= 20""")
def i25(r: Roles):
    cat = r.tracks.select("artist", c("title").alias("artist_credit"), "title", c("artist_rank").alias("comps"), "listeners", "market", c("country").alias("artist_country"), "artist_rank")
    draft = report.draft_curated_list(cat, limit=20, tier1=5, tier2=7)
    return draft.withColumns({"top": F.array_join("top", ","), "pos": c("pos").cast("long")})


@query("i26_stratified_sample")
def i26(r: Roles):
    n = r.tracks.count() // 10
    return sample.stratified_sample(
        r.tracks, n, n // 10, 0.5, (c("market") == "il") | (c("country") == "IL"), c("tier") == 0,
        F.concat(F.coalesce("genre", F.lit("none")), F.lit("|"), F.coalesce("decade", F.lit("unknown"))), [c("hit").desc(), c("track_id").asc()])


@query("i26_nested_samples")
def i26_nested(r: Roles):
    n = r.tracks.count()
    return sample.nested_samples(
        r.tracks, [(n // 4, n // 40, 0.8), (n // 20, n // 200, 0.6)], (c("market") == "il") | (c("country") == "IL"), c("tier") == 0,
        F.concat(F.coalesce("genre", F.lit("none")), F.lit("|"), F.coalesce("decade", F.lit("unknown"))), [c("hit").desc(), c("track_id").asc()])


@query("i27_quality_report", """
    SELECT section, key, n, round(n / CAST((SELECT count(*) FROM tracks) AS DOUBLE), 4) AS share FROM (
      SELECT 'decade' AS section, decade AS key, count(*) AS n FROM tracks GROUP BY 2 UNION ALL SELECT 'genre', genre, count(*) FROM tracks GROUP BY 2
      UNION ALL SELECT 'language', language, count(*) FROM tracks GROUP BY 2 UNION ALL SELECT 'tier', CAST(tier AS VARCHAR), count(*) FROM tracks GROUP BY 2)""")
def i27(r: Roles):
    return report.sections(r.tracks, ["decade", "genre", "language", "tier"]).withColumn("share", F.round("share", 4))


@query("i27_signature_rows", """
    WITH a AS (SELECT title AS name, artist FROM (SELECT title, artist, row_number() OVER (PARTITION BY title ORDER BY count(*) DESC, artist) AS i FROM tracks WHERE title LIKE 'red %' GROUP BY 1, 2) WHERE i = 1)
    SELECT a.name, t.title, t.artist_rank AS rank, t.tier, t.listeners FROM a JOIN tracks t ON t.artist = a.artist AND t.artist_rank <= 3""")
def i27b(r: Roles):
    cat = r.tracks.select("artist", c("title").alias("artist_credit"), "title", "artist_rank", "tier", "listeners")
    names = r.tracks.where("title like 'red %'").select(c("title").alias("name")).distinct()
    return report.signature_rows(cat, names)
