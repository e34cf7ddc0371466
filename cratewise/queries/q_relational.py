"""Queries over predicates, joins, aggregates, windows, sorts and set operations (B–G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratewise.functions import text as tx
from cratewise.operators import aggregates as ag
from cratewise.operators import apportion, joins, ranking
from cratewise.plans import select as sel
from cratewise.queries.registry import query
from cratewise.queries.roles import Roles
from cratewise.session import bounded, lookup

c = F.col


# --- B: projections, filters, predicates ------------------------------------------------------------
@query("b1_typed_projection", "SELECT CAST(l_orderkey AS INTEGER) AS id, CAST(l_quantity AS INTEGER) AS votes, "
       "CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem")
def b1(r: Roles):
    return r.lineitem.select(c("l_orderkey").cast("int").alias("id"), c("l_quantity").cast("int").alias("votes"), F.year("l_shipdate").alias("year"))


@query("b2_fixed_export_order", "SELECT track_id, title, artist, year, decade, language, genre FROM tracks")
def b2(r: Roles):
    return r.tracks.select(*["track_id", "title", "artist", "year", "decade", "language", "genre"])


@query("b3_pool_predicate", """
    SELECT track_id, coalesce(country IN ('IL', 'FR') OR language IN ('lang_es'), false) AS in_pool, false AS in_empty FROM tracks""")
def b3(r: Roles):
    pool = sel.Pool("p", ("IL", "FR"), ("lang_es",), 0)
    none = sel.Pool("none", (), (), 0)
    flag = lambda p: F.coalesce(sel.in_pool(p, c("country"), c("language")), F.lit(False))
    return r.tracks.select("track_id", flag(pool).alias("in_pool"), flag(none).alias("in_empty"))


@query("b4_seed_predicate", """
    SELECT r.id, artist_credit IN (SELECT id FROM artist WHERE area IN (3, 9)) OR regexp_matches(name, 'widget') AS seeded
    FROM recording r""")
def b4(r: Roles):
    seeds = r.artist.where(c("area").isin(3, 9)).select(c("id").alias("artist_credit"), F.lit(True).alias("_s")).distinct()
    rows = r.recording.join(seeds, "artist_credit", "left")
    return rows.select("id", (F.coalesce("_s", F.lit(False)) | c("name").rlike("widget")).alias("seeded"))


@query("b7_title_pattern_flag", r"""
    SELECT doc_id, regexp_matches(lower(title), '\bkaraoke\b|in the style of|originally performed by|made famous by|\btribute to\b|backing track') AS flag
    FROM doc_title""")
def b7(r: Roles):
    return r.doc_title.select("doc_id", tx.is_non_music_title(c("title")).alias("flag"))


@query("b8_holiday_flag", """
    SELECT doc_id, CAST(doc_id % 3 = 0 OR doc_id % 3 = 1 AS INTEGER) AS holiday FROM doc_title""")
def b8(r: Roles):
    extra = F.when(c("doc_id") % 3 == 0, " Silent NIGHT x").when(c("doc_id") % 3 == 1, " (Noël)").otherwise(" xmass silently")
    return r.doc_title.select("doc_id", tx.is_holiday_title(F.concat("title", extra)).cast("int").alias("holiday"))


@query("b9_range_filter", "SELECT track_id, year FROM tracks WHERE year BETWEEN 1800 AND 1999 AND listens > 0")
def b9(r: Roles):
    return r.tracks.where(c("year").between(1800, 1999) & (c("listens") > 0)).select("track_id", "year")


@query("b10_status_or_missing", "SELECT id FROM release WHERE status IS NULL OR status IN (1, 2)")
def b10(r: Roles):
    return r.release.where(c("status").isNull() | c("status").isin(1, 2)).select("id")


@query("b11_null_safe_inequality", "SELECT count(*) AS n FROM tracks WHERE language = 'lang_he' AND country IS DISTINCT FROM 'IL'")
def b11(r: Roles):
    return r.tracks.where((c("language") == "lang_he") & ~c("country").eqNullSafe("IL")).agg(F.count("*").alias("n"))


@query("b14_visit_filter", """
    SELECT page_id, NOT regexp_matches(lower(url), 'bot\\b|crawl|spider|headless|preview|facebookexternalhit') AND page_id % 4 <> 0 AS visit
    FROM pages""")
def b14(r: Roles):
    mode = F.when(c("page_id") % 4 == 0, F.lit("cors")).otherwise(F.lit("navigate"))
    return r.pages.select("page_id", tx.looks_like_visit(F.lit("GET"), mode, c("url")).alias("visit"))


@query("b15_counted_events", """
    SELECT event_type, count(*) AS n FROM event_k WHERE event_type IN ('view', 'click') AND x > 10 GROUP BY 1""")
def b15(r: Roles):
    allowed = lookup(r.spark, [("view",), ("click",)], "event_type string")
    ok = r.event_k.where((c("x") > 10) & (c("x") == F.floor("x"))).join(allowed, "event_type", "left_semi")
    return ok.groupBy("event_type").agg(F.count("*").alias("n"))


# --- C: joins ---------------------------------------------------------------------------------------
@query("c1_equi_join_chain", """
    SELECT t.recording, min(e.year) AS year FROM (SELECT DISTINCT d.recording, m.release FROM dump_track d JOIN medium m ON m.id = d.medium) t
    JOIN (SELECT release, min(year) AS year FROM release_event WHERE year IS NOT NULL GROUP BY 1) e ON e.release = t.release GROUP BY 1""")
def c1(r: Roles):
    links = r.dump_track.join(r.medium, c("medium") == c("id")).select("recording", "release").distinct()
    years = r.release_event.where("year is not null").groupBy("release").agg(F.min("year").alias("year"))
    return links.join(years, "release").groupBy("recording").agg(F.min("year").alias("year"))


@query("c2_left_outer_assembly", """
    SELECT p.p_partkey AS id, i.listeners, y.n AS tags, w.w AS works FROM part p LEFT JOIN item_pop i ON i.track_id = p.p_partkey
    LEFT JOIN (SELECT entity, count(*) AS n FROM recording_tag GROUP BY 1) y ON y.entity = p.p_partkey
    LEFT JOIN (SELECT recording, count(*) AS w FROM rec_work GROUP BY 1) w ON w.recording = p.p_partkey""")
def c2(r: Roles):
    tags = r.recording_tag.groupBy(c("entity").cast("long").alias("id")).agg(F.count("*").alias("tags"))
    works = r.rec_work.groupBy(c("recording").cast("long").alias("id")).agg(F.count("*").alias("works"))
    pop = r.item_pop.select(c("track_id").alias("id"), "listeners")
    base = r.part.select(c("p_partkey").alias("id"))
    return base.join(pop, "id", "left").join(tags, "id", "left").join(works, "id", "left")


@query("c3_left_semi", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def c3(r: Roles):
    hot = r.lineitem.where("l_quantity > 49").select(c("l_partkey").alias("p_partkey"))
    return r.part.select("p_partkey").join(hot, "p_partkey", "left_semi")


@query("c4_left_anti_pairs", """
    SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN
      (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A')""")
def c4(r: Roles):
    pairs = r.lineitem.select("l_partkey", "l_suppkey", "l_returnflag")
    returned = pairs.where("l_returnflag = 'A'").select("l_partkey", "l_suppkey")
    return pairs.drop("l_returnflag").distinct().join(returned, ["l_partkey", "l_suppkey"], "left_anti")


@query("c5_not_exists", """
    SELECT p.mbid, p.title FROM pins p WHERE NOT EXISTS (SELECT 1 FROM recording r JOIN artist a ON a.id = r.artist_credit
      WHERE a.gid = p.mbid AND r.name = p.title AND r.id % 2 = 0)""")
def c5(r: Roles):
    have = r.recording.where("id % 2 = 0").select("artist_credit", c("name").alias("title"))
    have = have.join(r.artist.select(c("id").alias("artist_credit"), c("gid").alias("mbid")), "artist_credit")
    return r.pins.select("mbid", "title").join(have, ["mbid", "title"], "left_anti")


@query("c6_small_dimension_product", """
    SELECT p_partkey AS song, dim FROM part CROSS JOIN (VALUES ('complexity'), ('intensity')) AS d(dim)""")
def c6(r: Roles):
    # One row per dimension and song: exploding a literal array needs no join at all.
    return r.part.select(c("p_partkey").alias("song"), F.explode(F.array(F.lit("complexity"), F.lit("intensity"))).alias("dim"))


@query("c7_redirect_resolution", """
    SELECT r.id AS recording, coalesce(min(g.id), r.id) AS canon FROM recording r LEFT JOIN canonical c ON c.recording = r.gid
    LEFT JOIN (SELECT gid, id FROM recording UNION ALL SELECT gid, new_id FROM redirect) g ON g.gid = c.canonical GROUP BY r.id""")
def c7(r: Roles):
    return joins.resolve_redirects(r.recording, r.redirect, r.canonical)


_SIB_KEYS = "SELECT DISTINCT l_partkey AS recording, l_orderkey AS key FROM lineitem"


@query("c8_sibling_expansion", f"""
    WITH ks AS ({_SIB_KEYS}),
    pair AS (SELECT DISTINCT s.recording % 500 AS song, b.recording FROM ks s JOIN ks b ON b.key = s.key
             WHERE b.recording % 500 <> s.recording % 500)
    SELECT song, count(*) AS siblings, CAST(sum(p_size) AS BIGINT) AS size_sum FROM pair JOIN part ON p_partkey = recording
    GROUP BY song""")
def c8(r: Roles):
    keys = r.lineitem.select(c("l_partkey").alias("recording"), c("l_orderkey").alias("key")).distinct()
    # A song owns all recordings with its number modulo 500.
    own = keys.select((c("recording") % 500).alias("song"), "recording").distinct()
    asked = keys.select((c("recording") % 500).alias("song"), "key").distinct()
    sizes = r.part.select(c("p_partkey").alias("recording"), "p_size")
    out = joins.sibling_totals(asked, own, keys, sizes, {"siblings": F.lit(1), "size_sum": c("p_size")})
    return out.where("siblings > 0")


@query("c9_hierarchy_walk", """
    WITH RECURSIVE up(node, cur, depth) AS (
      SELECT DISTINCT area, area, 0 FROM artist WHERE area IS NOT NULL
      UNION ALL SELECT up.node, CAST(p.parent AS INTEGER), depth + 1 FROM up JOIN area_parent p ON p.child = up.cur
        WHERE depth < 8 AND up.cur NOT IN (SELECT area FROM area_iso))
    SELECT node, label FROM (SELECT node, code AS label, row_number() OVER (PARTITION BY node ORDER BY depth, code) AS rn
      FROM up JOIN area_iso i ON i.area = up.cur) WHERE rn = 1""")
def c9(r: Roles):
    nodes = r.artist.where("area is not null").select(c("area").alias("node"))
    return joins.nearest_label(nodes, r.area_parent, r.area_iso.select(c("area").alias("node"), c("code").alias("label")))


@query("c10_title_and_containment", """
    SELECT DISTINCT q.query, t.p_partkey AS track_id FROM
      (SELECT DISTINCT c_mktsegment AS query, 'Brand#' || c_custkey % 9 AS a, p_name AS ti FROM customer JOIN part ON p_partkey = c_custkey % 7) q
    JOIN part t ON lower(replace(t.p_name, ' ', '')) = lower(replace(q.ti, ' ', ''))
      AND contains(lower(replace(t.p_brand, '#', '')), lower(replace(q.a, '#', '')))""")
def c10(r: Roles):
    names = r.part.select(c("p_partkey").alias("_k"), c("p_name").alias("title"))
    asked = r.customer.select(c("c_mktsegment").alias("query"), F.concat(F.lit("Brand#"), c("c_custkey") % 9).alias("artist"), (c("c_custkey") % 7).alias("_k"))
    tracks = r.part.select(c("p_partkey").alias("track_id"), c("p_brand").alias("artist"), c("p_name").alias("title_key"))
    return joins.contains_match(asked.join(names, "_k").select("query", "artist", "title"), tracks)


@query("c11_rank_one_child", """
    SELECT t.track_id, (SELECT x.cluster FROM track_cluster x WHERE x.track_id = t.track_id AND x.w > 0.5) AS first FROM track_base t""")
def c11(r: Roles):
    main = r.track_cluster.where("w > 0.5").select("track_id", c("cluster").alias("first"))
    return r.track_base.select("track_id").join(main, "track_id", "left")


_MATCH_SIDES = """
    a AS (SELECT id AS doc_id, artist_credit AS artist, trim(regexp_replace(lower(strip_accents(name)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS k,
            id % 1100 AS code FROM recording WHERE id % 2 = 0),
    b AS (SELECT id AS other, artist_credit AS artist, trim(regexp_replace(lower(strip_accents(name)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS k,
            id % 1100 + (CASE WHEN id % 5 = 0 THEN 0 ELSE 100000 + id END) AS code FROM recording WHERE id % 2 = 1)"""


@query("c12_entity_match", f"""
    WITH {_MATCH_SIDES},
    i AS (SELECT a.doc_id, min(b.other) AS other FROM a JOIN b ON b.code = a.code GROUP BY 1),
    s AS (SELECT a.doc_id, b.other, 1 - levenshtein(a.k, b.k) / CAST(greatest(length(a.k), length(b.k)) AS DOUBLE) AS sim
          FROM a JOIN b ON a.k <> '' AND b.k <> ''
            AND a.artist = b.artist
            AND regexp_extract_all(a.k, '[\\p{{N}}]+') = regexp_extract_all(b.k, '[\\p{{N}}]+')
          WHERE a.doc_id NOT IN (SELECT doc_id FROM i)),
    t AS (SELECT doc_id, other, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, other) AS rn FROM s WHERE sim >= 0.85)
    SELECT doc_id, other, 'isrc' AS via FROM i UNION ALL SELECT doc_id, other, 'search' FROM t WHERE rn = 1""")
def c12(r: Roles):
    d = r.recording.select(c("id").alias("doc_id"), c("artist_credit").cast("string").alias("source"), tx.norm_text(c("name")).alias("k"))
    code = c("doc_id") % 1100
    left = d.where("doc_id % 2 = 0").select(c("doc_id").alias("left_id"), "k", F.array("source").alias("artists"), F.array(code).alias("codes"), F.lit(False).alias("live"))
    right = d.where("doc_id % 2 = 1").select(
        c("doc_id").alias("right_id"), "k", F.array("source").alias("artists"),
        F.array(code + F.when(c("doc_id") % 5 == 0, 0).otherwise(100000 + c("doc_id"))).alias("codes"), F.lit(False).alias("live"),
    )
    found = joins.match_entities(left, right, fuzzy_artists=False)
    return found.select(c("left_id").alias("doc_id"), c("right_id").alias("other"), "via")


@query("c13_star_lookup", """
    SELECT t.tag, m.key, count(*) AS n, CAST(sum(t.votes) AS BIGINT) AS votes FROM recording_tag t JOIN tag_map m ON m.tag = t.tag GROUP BY 1, 2""")
def c13(r: Roles):
    return r.recording_tag.join(bounded(r.tag_map.select("tag", "key")), "tag").groupBy("tag", "key").agg(F.count("*").alias("n"), F.sum("votes").alias("votes"))


@query("c14_display_in_request_order", """
    SELECT p.playlist_id, p.pos, t.title, t.artist FROM playlist_track p JOIN track_base t ON t.track_id = p.track_id""")
def c14(r: Roles):
    rows = r.playlist_track.join(r.track_base.select("track_id", "title", "artist"), "track_id")
    return rows.select("playlist_id", "pos", "title", "artist").orderBy("playlist_id", "pos")


# --- D: aggregations --------------------------------------------------------------------------------
@query("d1_group_aggregates", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty, min(l_quantity) AS lo, max(l_quantity) AS hi,
           round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1, 2""")
def d1(r: Roles):
    return r.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("qty"), F.min("l_quantity").alias("lo"),
        F.max("l_quantity").alias("hi"), F.round(F.avg("l_quantity"), 4).alias("mean"))


@query("d2_distinct_users", "SELECT track_id, count(DISTINCT user_id) AS users, CAST(sum(listens) AS BIGINT) AS listens FROM plays GROUP BY 1")
def d2(r: Roles):
    return ag.distinct_users(r.plays, "track_id", "user_id", "listens")


@query("d3_filtered_aggregates", """
    SELECT p_brand, count(*) FILTER (WHERE p_type = 'PROMO') AS promo, CAST(sum(p_size) FILTER (WHERE p_type <> 'PROMO') AS BIGINT) AS rest
    FROM part GROUP BY 1""")
def d3(r: Roles):
    promo = c("p_type") == "PROMO"
    return r.part.groupBy("p_brand").agg(F.count_if(promo).alias("promo"), F.sum(F.when(~promo, c("p_size"))).alias("rest"))


@query("d4_having_bool_or", """
    SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 32 OR bool_or(l_quantity = 50 AND l_returnflag = 'R')""")
def d4(r: Roles):
    g = r.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.bool_or((c("l_quantity") == 50) & (c("l_returnflag") == "R")).alias("_any"))
    return g.where("n > 32 or _any").drop("_any")


@query("d5_ordered_first", """
    SELECT recording, release FROM (SELECT d.recording, m.release, row_number() OVER (PARTITION BY d.recording ORDER BY y.year NULLS LAST, m.release) AS rn
      FROM dump_track d JOIN medium m ON m.id = d.medium LEFT JOIN (SELECT release, min(year) AS year FROM release_event GROUP BY 1) y
      ON y.release = m.release) WHERE rn = 1""")
def d5(r: Roles):
    years = r.release_event.groupBy("release").agg(F.min("year").alias("year"))
    rows = r.dump_track.join(r.medium, c("medium") == c("id")).join(years, "release", "left")
    last = F.coalesce("year", F.lit(9999)).alias("y")
    return ranking.best_per_group(rows, ["recording"], [last, c("release")], ["release"])


@query("d6_most_common_value", """
    SELECT l_suppkey, l_returnflag AS mode FROM (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS rn
      FROM lineitem GROUP BY 1, 2) WHERE rn = 1""")
def d6(r: Roles):
    return ag.most_common(r.lineitem, ["l_suppkey"], "l_returnflag", "mode")


@query("d7_sorted_lists", """
    SELECT artist_credit, string_agg(DISTINCT name, ',' ORDER BY name) AS names, string_agg(CAST(id AS VARCHAR), ',' ORDER BY length_ms, id) AS ids
    FROM recording GROUP BY 1""")
def d7(r: Roles):
    names = ag.sorted_distinct_list(r.recording, ["artist_credit"], "name", "names")
    ids = ag.ordered_list(r.recording, ["artist_credit"], ["length_ms", "id"], "id", "ids")
    both = names.join(ids, "artist_credit")
    return both.select("artist_credit", F.array_join("names", ",").alias("names"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("d8_ordered_map", """
    SELECT track_id, string_agg(cluster || '=' || CAST(w AS VARCHAR), ',' ORDER BY ord) AS clusters FROM track_cluster GROUP BY 1""")
def d8(r: Roles):
    maps = ag.ordered_map(r.track_cluster, ["track_id"], "ord", "cluster", "w", "m")
    text = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("track_id", F.array_join(text, ",").alias("clusters"))


@query("d9_exact_median", "SELECT l_returnflag, median(l_quantity) AS median FROM lineitem GROUP BY 1")
def d9(r: Roles):
    return ranking.exact_median(r.lineitem, ["l_returnflag"], "l_quantity")


@query("d10_decimal_weighted_means", """
    SELECT l_suppkey, round(CAST(sum(CAST(l_discount AS DECIMAL(12,5))) AS DOUBLE) / count(*), 9) AS discount,
           round(CAST(sum(CAST(l_tax AS DECIMAL(12,5))) AS DOUBLE) / count(*), 9) AS tax FROM lineitem GROUP BY 1""")
def d10(r: Roles):
    sums = ag.decimal_sums(r.lineitem, ["l_suppkey"], ["l_discount", "l_tax"])
    return ag.means_of_sums(sums, ["l_suppkey"], ["l_discount", "l_tax"]).select(
        "l_suppkey", F.round("l_discount", 9).alias("discount"), F.round("l_tax", 9).alias("tax"))


@query("d11_pivot_weights", """
    SELECT track_id, max(w) FILTER (WHERE cluster = 'PROMO') AS "PROMO", max(w) FILTER (WHERE cluster = 'LARGE') AS "LARGE" FROM track_cluster GROUP BY 1""")
def d11(r: Roles):
    return ag.pivot_weights(r.track_cluster, "track_id", "cluster", ["PROMO", "LARGE"], "w")


@query("d12_unpivot_probabilities", """
    SELECT l_orderkey, l_linenumber, l_partkey, class, p FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS d, l_tax AS t FROM lineitem) UNPIVOT (p FOR class IN (d, t))""")
def d12(r: Roles):
    wide = r.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", c("l_discount").alias("d"), c("l_tax").alias("t"))
    return wide.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["d", "t"], "class", "p")


@query("d14_training_mean_spread", """
    SELECT round(avg(l_quantity), 4) AS mean, round(stddev_pop(l_quantity), 4) AS spread FROM lineitem WHERE l_partkey % 20 > 1""")
def d14(r: Roles):
    return r.lineitem.where("l_partkey % 20 > 1").agg(F.round(F.avg("l_quantity"), 4).alias("mean"), F.round(F.stddev_pop("l_quantity"), 4).alias("spread"))


@query("d15_leave_one_out_mean", """
    WITH b AS (SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) AS y, p_partkey % 3 <> 0 AS has_y, p_partkey % 20 = 7 AS held FROM part),
    m AS (SELECT avg(y) AS mu FROM b WHERE has_y),
    g AS (SELECT p_brand, count(*) AS n, sum(y) AS s FROM b WHERE has_y GROUP BY 1)
    SELECT p_partkey, CASE WHEN held OR coalesce(n, 0) - CAST(has_y AS INTEGER) <= 0 THEN 0 ELSE 1 END AS known,
           round(CASE WHEN held OR coalesce(n, 0) - CAST(has_y AS INTEGER) <= 0 THEN mu
             ELSE (s - (CASE WHEN has_y THEN y ELSE 0 END) + 2 * mu) / (n - CAST(has_y AS INTEGER) + 2) END, 4) AS mean
    FROM b CROSS JOIN m LEFT JOIN g ON g.p_brand = b.p_brand""")
def d15(r: Roles):
    y = F.when(c("p_partkey") % 3 != 0, c("p_size").cast("double"))
    rows = r.part.select("p_partkey", "p_brand", y.alias("y"), y.isNotNull().alias("has_y"), (c("p_partkey") % 20 == 7).alias("held"))
    mu = rows.agg(F.avg("y")).first()[0] or 0.0
    out = ag.leave_one_out(rows, "p_brand", "has_y", {"y": "y"}, "held", {"y": mu}, "mean")
    return out.select("p_partkey", c("has_mean").cast("int").alias("known"), F.round("mean_y", 4).alias("mean"))


@query("d16_normal_equations", """
    SELECT CAST(sum(l_quantity * l_quantity) AS BIGINT) AS qq, CAST(sum(l_quantity * l_linenumber) AS BIGINT) AS ql,
           CAST(sum(l_linenumber * l_linenumber) AS BIGINT) AS ll, CAST(sum(l_quantity * l_suppkey) AS BIGINT) AS qy,
           CAST(sum(l_linenumber * l_suppkey) AS BIGINT) AS ly, count(*) AS n FROM lineitem""")
def d16(r: Roles):
    gram = ag.normal_equations(r.lineitem, ["l_quantity", "l_linenumber"], ["l_suppkey"])
    cell = lambda i, j, n: F.max(F.when((c("i") == i) & (c("j") == j), c("value"))).cast("long").alias(n)
    # Row order: intercept, quantity, line number, then the target.
    return gram.agg(cell(1, 1, "qq"), cell(1, 2, "ql"), cell(2, 2, "ll"), cell(1, 3, "qy"), cell(2, 3, "ly"), cell(0, 0, "n"))


@query("d17_distribution_table", """
    SELECT p_type AS key, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 4) AS share FROM part GROUP BY 1""")
def d17(r: Roles):
    return ag.distribution(r.part, "p_type").withColumn("share", F.round("share", 4))


@query("d18_quality_counts", """
    SELECT count(*) AS tracks, count(*) FILTER (WHERE language = 'lang_he') AS he, count(*) FILTER (WHERE country = 'IL') AS il,
           count(*) FILTER (WHERE language = 'lang_he' AND country IS DISTINCT FROM 'IL') AS he_not_il,
           count(*) FILTER (WHERE country = 'IL' AND language <> 'lang_he') AS il_not_he, count(*) FILTER (WHERE year >= 2015) AS recent,
           count(*) FILTER (WHERE genre IS NULL) AS no_genre, min(listeners) AS lo, max(listeners) AS hi, count(DISTINCT artist) AS artists FROM tracks""")
def d18(r: Roles):
    he, il = c("language") == "lang_he", c("country").eqNullSafe("IL")
    return r.tracks.agg(
        F.count("*").alias("tracks"), F.count_if(he).alias("he"), F.count_if(il).alias("il"), F.count_if(he & ~il).alias("he_not_il"),
        F.count_if(il & ~he).alias("il_not_he"), F.count_if(c("year") >= 2015).alias("recent"), F.count_if(c("genre").isNull()).alias("no_genre"),
        F.min("listeners").alias("lo"), F.max("listeners").alias("hi"), F.count_distinct("artist").alias("artists"))


@query("d19_most_used_name", """
    SELECT artist, title AS name FROM (SELECT artist, title, row_number() OVER (PARTITION BY artist ORDER BY count(*) DESC, title) AS rn
      FROM tracks GROUP BY 1, 2) WHERE rn = 1""")
def d19(r: Roles):
    return ag.most_common(r.tracks, ["artist"], "title", "name")


@query("d20_log_fame", """
    SELECT artist, round(ln(1 + count(*) FILTER (WHERE language = 'lang_he')) + ln(1 + coalesce(sum(artist_rank) FILTER (WHERE language = 'lang_he'), 0))
       + 0.5 * ln(1 + coalesce(max(listeners) FILTER (WHERE language = 'lang_he'), 0)), 4) AS fame FROM tracks GROUP BY 1""")
def d20(r: Roles):
    return r.tracks.groupBy("artist").agg(F.round(ag.log_fame(c("language") == "lang_he", c("artist_rank"), c("listeners")), 4).alias("fame"))


@query("d21_nearest_rank_percentiles", """
    SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def d21(r: Roles):
    return ranking.nearest_rank(r.events, ["event_type"], "value", {"p50": 50, "p95": 95})


@query("d22_two_fold_line", """
    WITH d AS (SELECT p_brand AS g, p_partkey % 2 AS fold, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
    f AS (SELECT a.g, a.fold, count(*) AS n, var_pop(b.x) AS vx, regr_slope(b.y, b.x) AS sl, regr_intercept(b.y, b.x) AS ic, avg(b.y) AS m
          FROM (SELECT DISTINCT g, fold FROM d) a JOIN d b ON b.g = a.g AND b.fold <> a.fold GROUP BY 1, 2)
    SELECT d.g, round(avg(abs(CASE WHEN f.n < 3 OR f.vx = 0 THEN f.m ELSE f.ic + f.sl * d.x END - d.y)), 3) AS mae,
           round(avg(abs(f.m - d.y)), 3) AS baseline FROM d JOIN f ON f.g = d.g AND f.fold = d.fold GROUP BY 1""")
def d22(r: Roles):
    d = r.part.select(c("p_brand").alias("g"), (c("p_partkey") % 2).alias("fold"), c("p_size").cast("double").alias("x"), c("p_retailprice").alias("y"))
    out = ag.two_fold_error(d, ["g"], "fold", "x", "y")
    return out.select("g", F.round("mae", 3).alias("mae"), F.round("baseline", 3).alias("baseline"))


@query("d23_spearman", """
    SELECT event_type AS g, round(corr(rx, ry), 6) AS rho FROM (
      SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY x) + (count(*) OVER (PARTITION BY event_type, x) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS ry FROM event_k) GROUP BY 1""")
def d23(r: Roles):
    return ag.spearman(r.event_k.withColumnRenamed("event_type", "g"), ["g"], "x", "value").select("g", F.round("rho", 6).alias("rho"))


@query("d24_natural_shares", "SELECT genre, round(count(*) / (SELECT count(*) FROM tracks), 6) AS share FROM tracks GROUP BY 1")
def d24(r: Roles):
    return ag.distribution(r.tracks, "genre").select(c("key").alias("genre"), F.round("share", 6).alias("share"))


@query("d26_unmapped_values", """
    SELECT t.tag, count(DISTINCT t.entity) AS songs, CAST(sum(t.votes) AS BIGINT) AS votes FROM artist_tag t
    WHERE t.tag NOT IN (SELECT tag FROM tag_map) AND t.tag NOT IN (SELECT tag FROM tag_nonmusic) GROUP BY 1 ORDER BY songs DESC, 1 LIMIT 50""")
def d26(r: Roles):
    tags = r.artist_tag.withColumnRenamed("entity", "song")
    return ag.unmapped_values(tags, [r.tag_map.select("tag"), r.tag_nonmusic], 50)


# --- E: windows -------------------------------------------------------------------------------------
@query("e1_global_rank", "SELECT track_id, row_number() OVER (ORDER BY listeners DESC, listens DESC, track_id) AS rk FROM tracks")
def e1(r: Roles):
    order = [c("listeners").desc(), c("listens").desc(), c("track_id").asc()]
    return ranking.row_numbers(r.tracks.select("track_id", "listeners", "listens"), [], order).select("track_id", "rk")


@query("e2_rank_in_group", """
    SELECT track_id, row_number() OVER (PARTITION BY artist ORDER BY listeners DESC, track_id) AS rk, count(*) OVER (PARTITION BY artist) AS n FROM tracks""")
def e2(r: Roles):
    rows = r.tracks.select("track_id", "artist", "listeners")
    return ranking.row_numbers(rows, ["artist"], [c("listeners").desc(), c("track_id").asc()]).select("track_id", "rk", "n")


@query("e3_representative", """
    SELECT track_id, first_value(track_id) OVER (PARTITION BY artist, title ORDER BY length_ms < 30000, listeners DESC, track_id) AS unit FROM tracks""")
def e3(r: Roles):
    order = [(c("length_ms") < 30000).alias("short"), (-c("listeners")).alias("pop"), c("track_id").alias("id")]
    unit = ranking.best_per_group(r.tracks.withColumn("unit", c("track_id")), ["artist", "title"], order, ["unit"])
    return r.tracks.select("track_id", "artist", "title").join(unit, ["artist", "title"]).select("track_id", "unit")


@query("e4_group_totals_beside", """
    SELECT track_id, max(listeners) OVER (PARTITION BY artist) AS top, count(*) OVER (PARTITION BY artist) AS n FROM tracks""")
def e4(r: Roles):
    rows = r.tracks.select("track_id", "artist", "listeners")
    return ranking.totals_beside(rows, ["artist"], [F.max("listeners").alias("top"), F.count("*").alias("n")]).select("track_id", "top", "n")


@query("e6_percent_rank", """
    SELECT track_id, round(percent_rank() OVER (PARTITION BY artist ORDER BY listeners), 6) AS pr,
           round(percent_rank() OVER (PARTITION BY decade, market ORDER BY hit, track_id), 6) AS hit_pct FROM tracks""")
def e6(r: Roles):
    rows = r.tracks.select("track_id", "artist", "listeners", "decade", "market", "hit")
    shared = ranking.percent_ranks(rows, ["artist"], "listeners", "pr").select("track_id", F.round("pr", 6).alias("pr"))
    own = ranking.row_numbers(rows, ["decade", "market"], [c("hit").asc(), c("track_id").asc()])
    own = own.select("track_id", F.round(F.when(c("n") > 1, (c("rk") - 1) / (c("n") - 1)).otherwise(F.lit(0.0)), 6).alias("hit_pct"))
    return shared.join(own, "track_id")


@query("e7_average_rank_quantile", """
    SELECT track_id, round(2 * ((rank() OVER (ORDER BY energy) + (count(*) OVER (PARTITION BY energy) - 1) / 2.0) - 0.5) / count(*) OVER () - 1, 4) AS energy,
           round(2 * ((rank() OVER (ORDER BY tempo) + (count(*) OVER (PARTITION BY tempo) - 1) / 2.0) - 0.5) / count(*) OVER () - 1, 4) AS tempo FROM tracks""")
def e7(r: Roles):
    return ranking.average_rank_scale(r.tracks, "track_id", ["energy", "tempo"])


@query("e8_any_in_group", "SELECT track_id, bool_or(tier = 0) OVER (PARTITION BY artist, decade) AS artist_hit FROM tracks")
def e8(r: Roles):
    rows = r.tracks.select("track_id", "artist", "decade", "tier")
    return ranking.totals_beside(rows, ["artist", "decade"], [F.bool_or(c("tier") == 0).alias("artist_hit")]).select("track_id", "artist_hit")


@query("e9_surrogate_ids", "SELECT DISTINCT title, dense_rank() OVER (ORDER BY title) - 1 AS id FROM tracks")
def e9(r: Roles):
    return ranking.surrogate_ids(r.tracks, "title", "id")


@query("e11_mass_cut", """
    SELECT l_returnflag, l_partkey FROM (SELECT l_returnflag, l_partkey, q, sum(q) OVER (PARTITION BY l_returnflag ORDER BY q DESC, l_partkey ROWS UNBOUNDED PRECEDING) - q AS before,
      sum(q) OVER (PARTITION BY l_returnflag) AS total FROM (SELECT l_returnflag, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2))
    WHERE before < 0.9 * total""")
def e11(r: Roles):
    q = r.lineitem.groupBy("l_returnflag", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    return ranking.mass_cut(q, ["l_returnflag"], "q", [c("q").desc(), c("l_partkey").asc()], 0.9).select("l_returnflag", "l_partkey")


_SIZES = "SELECT artist, genre, count(*) AS m FROM tracks WHERE genre IS NOT NULL GROUP BY 1, 2"


@query("e12_largest_remainder", f"""
    SELECT artist, genre, CAST(fl + (CASE WHEN row_number() OVER (PARTITION BY artist ORDER BY ex - fl DESC, genre) <= 50 - sum(fl) OVER (PARTITION BY artist) THEN 1 ELSE 0 END) AS INTEGER) AS slots
    FROM (SELECT *, floor(ex) AS fl FROM (SELECT artist, genre, m / CAST(sum(m) OVER (PARTITION BY artist) AS DOUBLE) * 50 AS ex FROM ({_SIZES})))""")
def e12(r: Roles):
    sizes = r.tracks.where("genre is not null").groupBy("artist", "genre").agg(F.count("*").alias("m"))
    return apportion.largest_remainder(sizes, ["artist"], "m", F.lit(50), [c("genre").asc()]).select("artist", "genre", "slots")


@query("e13_apportion_with_floor", f"""
    WITH s AS (SELECT artist, genre, m, CASE WHEN 9 >= count(*) OVER (PARTITION BY artist) THEN 1 ELSE 0 END AS b FROM ({_SIZES})),
    e AS (SELECT *, m - b AS pool, 9 - sum(b) OVER (PARTITION BY artist) AS rest, sum(m - b) OVER (PARTITION BY artist) AS ps FROM s),
    x AS (SELECT *, CASE WHEN ps > 0 AND rest > 0 THEN pool * rest / CAST(ps AS DOUBLE) ELSE 0 END AS ex FROM e),
    o AS (SELECT *, b + least(pool, floor(ex)) AS got FROM x),
    t AS (SELECT *, 9 - sum(got) OVER (PARTITION BY artist) AS more, sum(CASE WHEN got < m THEN 1 ELSE 0 END) OVER (PARTITION BY artist ORDER BY ex - floor(ex) DESC, genre) AS turn FROM o)
    SELECT artist, genre, CAST(got + (CASE WHEN ps > 0 AND rest > 0 AND got < m AND turn <= more THEN 1 ELSE 0 END) AS INTEGER) AS slots FROM t""")
def e13(r: Roles):
    sizes = r.tracks.where("genre is not null").groupBy("artist", "genre").agg(F.count("*").alias("m"))
    return apportion.with_floor_of_one(sizes, ["artist"], "m", F.lit(9), [c("genre").asc()]).select("artist", "genre", "slots")


@query("e14_spread_pick", """
    WITH k AS (SELECT artist, row_number() OVER (PARTITION BY artist ORDER BY listeners DESC, track_id) - 1 AS i, track_id, count(*) OVER (PARTITION BY artist) AS m FROM tracks),
    p AS (SELECT DISTINCT artist, m, CASE WHEN 7 >= m THEN j ELSE CASE WHEN j < 4 THEN j ELSE 4 + CAST(floor((j - 4 + 0.5) * (m - 4) / 3) AS BIGINT) END END AS i
          FROM k, range(0, 2000) AS g(j) WHERE j < least(7, m))
    SELECT k.artist, k.track_id FROM k JOIN p ON p.artist = k.artist AND p.i = k.i""")
def e14(r: Roles):
    ranked = ranking.row_numbers(r.tracks.select("artist", "track_id", "listeners"), ["artist"], [c("listeners").desc(), c("track_id").asc()])
    ranked = ranked.withColumn("i", c("rk") - 1)
    return ranking.evenly_spread(ranked, "i", "n", F.lit(7)).select("artist", "track_id")


@query("e15_neighbour_smoothing", """
    SELECT request, k, round(p + CAST(0.3 AS DOUBLE) * (coalesce(lag(p) OVER w, 0) + coalesce(lead(p) OVER w, 0)), 4) AS s FROM taste_group WHERE grp = 'decades'
    WINDOW w AS (PARTITION BY request ORDER BY ord)""")
def e15(r: Roles):
    rows = r.taste_group.where("grp = 'decades'").withColumn("p", c("p").cast("double"))
    return ranking.lag_lead_smooth(rows, ["request"], "ord", "p", F.lit(0.3), "s").select("request", "k", F.round("s", 4).alias("s"))


# --- F, G: sorts and sets ---------------------------------------------------------------------------
@query("f1_order_by_limit", "SELECT track_id, listeners FROM tracks ORDER BY listeners DESC, track_id LIMIT 15")
def f1(r: Roles):
    return r.tracks.select("track_id", "listeners").orderBy(c("listeners").desc(), "track_id").limit(15)


@query("f3_top_k_per_group", """
    SELECT genre, track_id FROM (SELECT genre, track_id, row_number() OVER (PARTITION BY genre, decade ORDER BY listeners DESC, track_id) AS rn FROM tracks WHERE tier < 2) WHERE rn <= 3""")
def f3(r: Roles):
    rows = r.tracks.where("tier < 2").select("genre", "decade", "track_id", "listeners")
    return ranking.top_per_group(rows, ["genre", "decade"], [c("listeners").desc(), c("track_id").asc()], 3).select("genre", "track_id")


@query("f4_global_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey")
def f4(r: Roles):
    return r.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey")


@query("g1_union_all", "SELECT gid, id FROM recording UNION ALL SELECT gid, new_id FROM redirect")
def g1(r: Roles):
    return r.recording.select("gid", "id").unionByName(r.redirect.withColumnRenamed("new_id", "id"))


@query("g2_union_distinct", "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 UNION SELECT l_suppkey FROM lineitem WHERE l_tax > 0.07")
def g2(r: Roles):
    part = lambda cond: r.lineitem.where(cond).select(c("l_suppkey").alias("k"))
    return part("l_quantity > 49").union(part("l_tax > 0.07")).distinct()


@query("g3_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def g3(r: Roles):
    return r.lineitem.select("l_partkey", "l_suppkey").distinct()


@query("g4_distinct_on", """
    SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
def g4(r: Roles):
    return ranking.best_per_group(r.lineitem, ["l_orderkey"], [(-c("l_quantity")).alias("q"), c("l_partkey").alias("k")], ["l_partkey"])


@query("g5_set_difference", """
    SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'""")
def g5(r: Roles):
    flag = lambda f: r.lineitem.where(c("l_returnflag") == f).select("l_partkey", "l_suppkey")
    return flag("N").subtract(flag("R"))
