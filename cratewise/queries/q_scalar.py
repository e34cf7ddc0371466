"""Queries over scalar functions (H1–H26) and the function surface (N1–N4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratewise.functions import features as ft
from cratewise.functions import text as tx
from cratewise.queries import duck
from cratewise.queries.registry import query
from cratewise.queries.roles import Roles

c = F.col
_N = "trim(regexp_replace(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_NOISE = "|".join(tx.VERSION_WORDS)
_S = (
    "regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\s*[(\\[][^)\\]]*\\b(?:" + _NOISE.replace("{", "{{").replace("}", "}}")
    + ")\\b[^)\\]]*[)\\]]', '', 'g'), '\\s+[-–—]\\s+[^-–—]*\\b(?:" + _NOISE.replace("{", "{{").replace("}", "}}")
    + ")\\b.*$', '', 'g'), '\\s+(?:feat\\.?|ft\\.|featuring)\\s.*$', '', 'g')"
)


@query("h1_norm_text", f"SELECT doc_id, {_N.format('text')} AS t FROM documents")
def h1(r: Roles):
    return r.documents.select("doc_id", tx.norm_text(c("text")).alias("t"))


@query("h2_strip_version", f"SELECT doc_id, {_S.format('title')} AS t FROM doc_title")
def h2(r: Roles):
    return r.doc_title.select("doc_id", tx.strip_version(c("title")).alias("t"))


@query("h3_norm_title", f"""
    SELECT doc_id, coalesce(nullif({_N.format('s')}, ''), nullif({_N.format('title')}, ''), lower(title)) AS t
    FROM (SELECT doc_id, title, {_S.format('title')} AS s FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '?' ELSE title END AS title FROM doc_title))""")
def h3(r: Roles):
    title = F.when(c("doc_id") % 9 == 0, F.lit("?")).otherwise(c("title"))
    return r.doc_title.select("doc_id", tx.norm_title(title).alias("t"))


@query("h4_version_type", r"""
    SELECT doc_id, CASE WHEN regexp_matches(lower(title), '[(\[][^)\]]*\blive\b|\s[-–—]\s[^-–—]*\blive\b') OR doc_id % 10 = 7 THEN 'live' ELSE 'studio' END AS v
    FROM doc_title""")
def h4(r: Roles):
    comment = F.when(c("doc_id") % 10 == 7, F.lit("Live, 1987")).when(c("doc_id") % 10 == 6, F.lit("alive"))
    return r.doc_title.select("doc_id", tx.version_type(c("title"), comment).alias("v"))


@query("h5_decade_of", """
    SELECT track_id, CASE WHEN y IS NULL THEN NULL WHEN y < 1960 THEN 'dec50' WHEN y < 1970 THEN 'dec60' WHEN y < 1980 THEN 'dec70' WHEN y < 1990 THEN 'dec80'
      WHEN y < 2000 THEN 'dec90' WHEN y < 2010 THEN 'dec00' WHEN y < 2020 THEN 'dec10' ELSE 'dec20' END AS decade
    FROM (SELECT track_id, year - 20 + track_id % 40 AS y FROM tracks)""")
def h5(r: Roles):
    return r.tracks.select("track_id", tx.decade_of(c("year") - 20 + c("track_id") % 40).alias("decade"))


@query("h6_script_language", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'heb' END AS lang FROM doc_title")
def h6(r: Roles):
    title = F.when(c("doc_id") % 10 == 0, F.concat("title", F.lit(" שיר"))).otherwise(F.concat("title", F.lit(" Кино")))
    return r.doc_title.select("doc_id", tx.script_lang(title).alias("lang"))


_ISO = "CASE doc_id % 8 WHEN 0 THEN 'eng' WHEN 1 THEN 'heb' WHEN 2 THEN 'fra' WHEN 3 THEN 'spa' WHEN 4 THEN 'zxx' WHEN 5 THEN 'und' WHEN 6 THEN 'deu' END"


@query("h7_language_bucket", f"""
    SELECT doc_id, CASE WHEN iso IS NULL OR iso = 'und' THEN 'unknown' WHEN iso = 'zxx' THEN 'none' WHEN iso IN ('eng', 'heb', 'fra', 'spa')
      THEN 'lang_' || replace(replace(replace(replace(iso, 'eng', 'en'), 'heb', 'he'), 'fra', 'fr'), 'spa', 'es') ELSE 'lang_other' END AS b
    FROM (SELECT doc_id, {_ISO} AS iso FROM documents)""")
def h7(r: Roles):
    return r.documents.select("doc_id", tx.lang_bucket(F.expr(_ISO)).alias("b"))


@query("h8_squash", f"SELECT doc_id, replace({_N.format('title')}, ' ', '') AS t FROM doc_title")
def h8(r: Roles):
    return r.doc_title.select("doc_id", tx.squash(c("title")).alias("t"))


@query("h9_first_known_language", f"""
    SELECT doc_id, coalesce({_ISO}, CASE WHEN source = 'src1' THEN 'rel' END, CASE WHEN doc_id % 7 = 0 THEN 'heb' END) AS iso FROM documents""")
def h9(r: Roles):
    release = F.when(c("source") == "src1", F.lit("rel"))
    script = tx.script_lang(F.when(c("doc_id") % 7 == 0, F.lit("שיר")).otherwise(F.lit("song")))
    return r.documents.select("doc_id", F.coalesce(F.expr(_ISO), release, script).alias("iso"))


@query("h10_tempo_axis", """
    SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(-1, least(1, (CASE WHEN b < 70 AND g = 'metal' THEN b * 2 WHEN b > 165 AND g = 'folk' THEN b / 2 ELSE b END - 120) / 60)), 4) AS tempo
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_orderkey % 180 + 40 AS DOUBLE) AS b, CASE l_partkey % 3 WHEN 0 THEN 'metal' WHEN 1 THEN 'folk' ELSE 'pop' END AS g FROM lineitem)""")
def h10(r: Roles):
    genre = F.expr("CASE l_partkey % 3 WHEN 0 THEN 'metal' WHEN 1 THEN 'folk' ELSE 'pop' END")
    axis = ft.tempo_axis((c("l_orderkey") % 180 + 40).cast("double"), genre)
    return r.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(axis, 4).alias("tempo"))


@query("h11_raw_dims_and_certainty", """
    SELECT mbid, CAST(round(sum(energy), 3) AS DOUBLE) AS energy, CAST(round(sum(valence), 3) AS DOUBLE) AS valence, CAST(round(sum(dance), 3) AS DOUBLE) AS dance,
           CAST(round(sum(certainty), 3) AS DOUBLE) AS certainty FROM (
      SELECT mbid, 2 * (0.4 * (1 - mood_relaxed__relaxed) + 0.3 * mood_party__party + 0.3 * mood_aggressive__aggressive) - 1 AS energy,
        mood_happy__happy - mood_sad__sad AS valence, 2 * danceability__danceable - 1 AS dance,
        (abs(2 * danceability__danceable - 1) + abs(2 * mood_happy__happy - 1) + abs(2 * mood_sad__sad - 1) + abs(2 * mood_relaxed__relaxed - 1)
         + abs(2 * mood_party__party - 1) + abs(2 * mood_aggressive__aggressive - 1) + abs(2 * mood_acoustic__acoustic - 1)
         + abs(2 * mood_electronic__electronic - 1) + abs(2 * voice_instrumental__voice - 1)) / 9 AS certainty FROM ab_hl) GROUP BY mbid""")
def h11(r: Roles):
    dims = ft.raw_dims(c)
    rows = r.ab_hl.select("mbid", *[dims[d].alias(d) for d in ("energy", "valence", "dance")], ft.certainty(c).alias("certainty"))
    return rows.groupBy("mbid").agg(*[F.round(F.sum(d), 3).alias(d) for d in ("energy", "valence", "dance", "certainty")])


@query("h12_feature_confidence", """
    SELECT track_id, round(CASE feature_source WHEN 'ab_direct' THEN 0.75 + 0.25 * hit WHEN 'ab_sibling' THEN 0.8 * (0.75 + 0.25 * hit)
      ELSE CASE WHEN track_id % 2 = 1 THEN 0.6 ELSE 0.45 END END, 6) AS conf FROM tracks""")
def h12(r: Roles):
    return r.tracks.select("track_id", F.round(ft.feature_confidence(c("feature_source"), c("hit"), c("track_id") % 2), 6).alias("conf"))


@query("h13_builtin_scalars", """
    SELECT track_id, greatest(energy, tempo) AS hi, least(energy, tempo) AS lo, round(ln(1 + listeners), 4) AS l, abs(energy) AS a,
           CAST(ceil(listeners / 7.0) AS BIGINT) AS up, coalesce(genre, 'none') || '|' || coalesce(decade, 'unknown') AS stratum, nullif(genre, 'PROMO') AS not_promo,
           CASE WHEN year BETWEEN 1980 AND 1999 THEN 'mid' ELSE 'other' END AS age FROM tracks""")
def h13(r: Roles):
    return r.tracks.select(
        "track_id", F.greatest("energy", "tempo").alias("hi"), F.least("energy", "tempo").alias("lo"), F.round(F.log(1 + c("listeners")), 4).alias("l"),
        F.abs("energy").alias("a"), F.ceil(c("listeners") / 7.0).alias("up"),
        F.concat(F.coalesce("genre", F.lit("none")), F.lit("|"), F.coalesce("decade", F.lit("unknown"))).alias("stratum"),
        F.nullif(c("genre"), F.lit("PROMO")).alias("not_promo"), F.when(c("year").between(1980, 1999), "mid").otherwise("other").alias("age"))


@query("h14_list_functions", """
    SELECT doc_id, len(w) AS n, list_position(w, 'the') AS the_at, w[2] AS second, array_to_string(list_sort(w)[1:3], ' ') AS first_sorted,
           array_to_string(list_transform(w[1:3], lambda x: '#' || x), ' ') AS shout FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents)""")
def h14(r: Roles):
    w = F.split(F.lower("text"), " ", -1)
    at = F.array_position(w, "the")
    return r.documents.select(
        "doc_id", F.size(w).cast("long").alias("n"), F.nullif(at, F.lit(0).cast("long")).alias("the_at"), F.get(w, F.lit(1)).alias("second"),
        F.array_join(F.slice(F.array_sort(w), 1, 3), " ").alias("first_sorted"), F.array_join(F.transform(F.slice(w, 1, 3), lambda x: F.concat(F.lit("#"), x)), " ").alias("shout"))


@query("h15_map_functions", """
    SELECT track_id, string_agg(cluster, ',' ORDER BY ord) AS keys, count(*) AS n, max(w) AS top FROM track_cluster GROUP BY 1""")
def h15(r: Roles):
    from cratewise.operators.aggregates import ordered_map

    m = ordered_map(r.track_cluster, ["track_id"], "ord", "cluster", "w", "m")
    return m.select("track_id", F.array_join(F.map_keys("m"), ",").alias("keys"), F.size("m").cast("long").alias("n"), F.array_max(F.map_values("m")).alias("top"))


@query("h16_hash_split", "SELECT gid, CAST(('0x' || substr(md5(gid), 1, 7)) AS BIGINT) % 20 AS bucket, sha256(gid) AS h FROM recording")
def h16(r: Roles):
    return r.recording.select("gid", tx.hash_bucket(c("gid"), 20).alias("bucket"), F.sha2("gid", 256).alias("h"))


@query("h17_seeds", """
    SELECT user_id, substr(sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, CAST(n AS VARCHAR))), 1, 16) AS seed,
           substr(sha256(substr(sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, CAST(n AS VARCHAR))), 1, 16) || ':more:' || n), 1, 16) AS next
    FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)""")
def h17(r: Roles):
    g = r.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    seed = tx.seed_of(c("user_id").cast("string"), c("event_type"), c("n").cast("string"))
    return g.select("user_id", seed.alias("seed"), tx.follow_up_seed(seed, "more", c("n")).alias("next"))


@query("h18_credit_names", """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a ' || o_custkey || ' b cc ' || o_orderkey || ';a ' || o_custkey || ';b;cc ' || o_orderkey
           WHEN 1 THEN 'beatles' ELSE 'x and1 with y;x and1;y' END AS names FROM orders""")
def h18(r: Roles):
    credit = (
        F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("The A "), c("o_custkey").cast("string"), F.lit(" & B, Cc "), c("o_orderkey").cast("string")))
        .when(c("o_orderkey") % 3 == 1, F.lit("The Beatles")).otherwise(F.lit("X And1 WITH y"))
    )
    return r.orders.select("o_orderkey", F.array_join(tx.credit_names(credit), ";").alias("names"))


@query("h19_title_similarity", """
    SELECT a.p_partkey, round(1 - levenshtein(a.p_name, b.p_name) / CAST(greatest(length(a.p_name), length(b.p_name)) AS DOUBLE), 6) AS sim,
           array_to_string(regexp_extract_all(a.p_brand || a.p_size, '[0-9]+'), ' ') AS numbers FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def h19(r: Roles):
    other = r.part.select((c("p_partkey") - 1).alias("p_partkey"), c("p_name").alias("o"))
    rows = r.part.join(other, "p_partkey")
    return rows.select("p_partkey", F.round(tx.similarity(c("p_name"), c("o")), 6).alias("sim"), tx.digits_of(F.concat("p_brand", c("p_size").cast("string"))).alias("numbers"))


@query("h20_valid_isrc", "SELECT isrc, regexp_full_match(upper(i), '[A-Z]{2}[A-Z0-9]{3}[0-9]{7}') AS ok FROM (SELECT isrc, CASE WHEN recording % 2 = 0 THEN lower(isrc) ELSE isrc || '9' END AS i FROM isrc)")
def h20(r: Roles):
    code = F.when(c("recording") % 2 == 0, F.lower("isrc")).otherwise(F.concat("isrc", F.lit("9")))
    return r.isrc.select("isrc", tx.valid_isrc(code).alias("ok"))


@query("h21_slug", """
    SELECT doc_id, coalesce(nullif(regexp_replace(substr(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), 1, 60), '^-+|-+$', '', 'g'), ''), 'playlist') AS s
    FROM (SELECT doc_id, CASE WHEN doc_id % 12 = 0 THEN '!?' ELSE title END AS title FROM doc_title)""")
def h21(r: Roles):
    return r.doc_title.select("doc_id", tx.slug(F.when(c("doc_id") % 12 == 0, F.lit("!?")).otherwise(c("title"))).alias("s"))


@query("h22_one_line_and_xml", """
    SELECT page_id, trim(regexp_replace(html, '[\\r\\n\\t]+', ' ', 'g')) AS l,
           replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS x FROM pages""")
def h22(r: Roles):
    return r.pages.select("page_id", tx.one_line(c("html")).alias("l"), tx.xml_text(c("html")).alias("x"))


@query("h22_word_boundary_cut", """
    SELECT doc_id, CASE WHEN length(t) > 40 THEN rtrim(CASE WHEN sp > 20 THEN substr(h, 1, sp) ELSE h END) || '…' ELSE nullif(t, '') END AS s FROM (
      SELECT doc_id, t, substr(t, 1, 39) AS h, length(substr(t, 1, 39)) - length(list_extract(string_split(substr(t, 1, 39), ' '), -1)) - 1 AS sp FROM (
        SELECT doc_id, trim(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^["''“”‘’«»]+|["''“”‘’«»]+$', '', 'g')) AS t FROM documents))""")
def h22b(r: Roles):
    return r.documents.select("doc_id", tx.clean_display(c("text"), 40).alias("s"))


@query("h23_client_key", """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN '10.0.' || x || '.7' WHEN 1 THEN '10.1.2.' || x WHEN 2 THEN '2001:db8:' || x || ':0::/64'
      WHEN 3 THEN '2001:0:0:0::/64' ELSE 'fe80:0:0:0::/64' END AS k FROM event_k""")
def h23(r: Roles):
    x = c("x").cast("string")
    address = (
        F.when(c("event_id") % 5 == 0, F.concat(F.lit("::FFFF:10.0."), x, F.lit(".7"))).when(c("event_id") % 5 == 1, F.concat(F.lit("10.1.2."), x))
        .when(c("event_id") % 5 == 2, F.concat(F.lit("2001:0db8:"), x, F.lit(":0:1:2:3:4"))).when(c("event_id") % 5 == 3, F.lit("2001::5"))
        .otherwise(F.lit("FE80::1%eth0"))
    )
    return r.event_k.select("event_id", tx.client_key(address).alias("k"))


@query("h24_utc_day_and_hour", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H') AS hour FROM events")
def h24(r: Roles):
    return r.events.select("event_id", tx.utc_day(c("ts")).alias("day"), tx.utc_hour(c("ts")).alias("hour"))


@query("h25_display_labels", """
    SELECT track_id, CASE WHEN decade IS NOT NULL THEN CASE WHEN year >= 2000 THEN CASE WHEN year >= 2020 THEN '2020s' WHEN year >= 2010 THEN '2010s' ELSE '2000s' END ELSE substr(decade, 4) || 's' END END AS d,
           CASE WHEN track_id % 2 = 0 THEN 'Hip-Hop' ELSE 'New Wave' END AS g, CASE language WHEN 'lang_en' THEN 'English' WHEN 'lang_he' THEN 'Hebrew' WHEN 'lang_fr' THEN 'French'
           WHEN 'lang_es' THEN 'Spanish' WHEN 'none' THEN 'None' ELSE 'Unknown' END AS l FROM tracks""")
def h25(r: Roles):
    genre = F.when(c("track_id") % 2 == 0, F.lit("hiphop")).otherwise(F.lit("new_wave"))
    return r.tracks.select("track_id", ft.decade_label(c("decade")).alias("d"), ft.label_of(genre, ft.CLUSTER_LABELS).alias("g"), ft.label_of(c("language"), ft.LANGUAGE_LABELS).alias("l"))


@query("h26_short_link_tag", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'ig' WHEN 2 THEN 'tt' END AS tag FROM pages")
def h26(r: Roles):
    path = F.expr("CASE page_id % 4 WHEN 0 THEN '/X' WHEN 1 THEN '/ig/' WHEN 2 THEN 'tt' ELSE '/ig/more' END")
    return r.pages.select("page_id", tx.short_link_tag(path).alias("tag"))


@query("n1_scalar_functions_together", f"""
    SELECT doc_id, title AS raw, {duck.norm('title')} AS norm, {duck.strip('title')} AS bare, {duck.title_key('title')} AS key, {duck.version('title')} AS version,
           {duck.decade('(1940 + doc_id % 90)')} AS decade, replace({duck.norm('title')}, ' ', '') AS squashed, 'lang_other' AS bucket FROM doc_title""")
def n1(r: Roles):
    t = c("title")
    return r.doc_title.select(
        "doc_id", tx.unescape_copy(tx.escape_copy(t)).alias("raw"), tx.norm_text(t).alias("norm"), tx.strip_version(t).alias("bare"), tx.norm_title(t).alias("key"),
        tx.version_type(t, F.lit("")).alias("version"), tx.decade_of(1940 + c("doc_id") % 90).alias("decade"), tx.squash(t).alias("squashed"),
        tx.lang_bucket(c("lang")).alias("bucket"))


@query("n2_generated_expressions", """
    SELECT track_id, round(greatest(-1, least(1, 0.5 * energy - 0.25 * tempo + 0.125 * vocal + 0.1)), 6) AS y FROM tracks""")
def n2(r: Roles):
    from cratewise.plans.impute import linear

    model = {"energy": 0.5, "tempo": -0.25, "vocal": 0.125}
    return r.tracks.select("track_id", F.round(ft.clamp(linear(0.1, model)), 6).alias("y"))


@query("n4_override_table", """
    SELECT session_id, seq, CASE WHEN choice = 'a' AND seq % 10 = 0 THEN 'skip' ELSE choice END AS choice FROM answers""")
def n4(r: Roles):
    over = r.answers.where("choice = 'a' and seq % 10 = 0").select("session_id", "seq", F.lit("skip").alias("_new"))
    return r.answers.join(over, ["session_id", "seq"], "left").select("session_id", "seq", F.coalesce("_new", "choice").alias("choice"))


