"""Queries over sources, sinks and validation (A1–A22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratewise.functions import text as tx
from cratewise.queries.registry import query
from cratewise.queries.roles import Roles
from cratewise.session import lookup, scratch_path
from cratewise.sources import rules, scan, sink


@query("a1_scan_copy_text", "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS brand, "
       "CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS INTEGER) END AS size FROM part")
def a1(r: Roles):
    null = F.lit(r"\N")
    lines = r.part.select(F.concat_ws(
        "\t", F.col("p_partkey").cast("string"), "p_name", F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).otherwise(null),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("string")).otherwise(null),
    ).alias("line"))
    cells = scan.parse_copy(lines, "line", ["id", "name", "brand", "size"])
    return cells.select(F.col("id").cast("long").alias("id"), "name", "brand", F.col("size").cast("int").alias("size"))


@query("a2_unescape_copy_text", "SELECT doc_id, text AS t FROM documents")
def a2(r: Roles):
    return r.documents.select("doc_id", tx.unescape_copy(tx.escape_copy(F.col("text"))).alias("t"))


@query("a3_scan_headed_csv", "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation FROM supplier")
def a3(r: Roles):
    path = scratch_path(r.spark, "csv")
    src = r.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    src.write.option("header", True).csv(path)
    got = scan.scan_headed_csv(r.spark, path, ["id", "name", "nation"])
    return got.select(F.col("id").cast("long").alias("id"), "name", F.col("nation").cast("int").alias("nation"))


@query("a4_scan_glob", "SELECT l_returnflag AS flag, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def a4(r: Roles):
    path = scratch_path(r.spark, "glob")
    for i, flag in enumerate(("A", "N", "R")):  # one folder per source, read back as one table
        rows = r.lineitem.where(F.col("l_returnflag") == flag).select("l_returnflag", F.col("l_partkey").cast("string"))
        rows.write.options(**scan.COPY_OPTIONS).csv(f"{path}/hl-{i}.tsv")
    got = scan.scan_copy(r.spark, f"{path}/hl-*.tsv", ["flag", "part"])
    return got.groupBy("flag").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"))


@query("a5_user_list_documents", """
    SELECT count(DISTINCT user_id) AS users, count(*) FILTER (WHERE track_id % 7 <> 0) AS "rows",
           count(*) FILTER (WHERE track_id % 7 = 0) AS unmapped FROM plays""")
def a5(r: Roles):
    gid = F.when(F.col("track_id") % 7 != 0, F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("track_id").cast("string"), 12, "0")))
    item = F.struct(F.coalesce(gid, F.lit("not an id")).alias("recording_mbid"), F.col("listens").alias("listen_count"))
    docs = r.plays.groupBy(F.col("user_id").cast("int").alias("user_id"), (F.col("track_id") % 16).alias("shard")).agg(F.collect_list(item).alias("data"))
    parsed = docs.select(F.from_json(F.to_json(F.struct("user_id", "data")), scan.USER_LIST).alias("d")).select("d.*")
    return scan.user_list_counts(scan.user_lists(parsed))


@query("a6_classifier_documents", """
    SELECT l_orderkey AS o, l_linenumber AS ln, round(least(1.0, l_quantity / 40), 5) AS mood_happy__happy,
           round(l_discount, 5) AS mood_sad__sad
    FROM lineitem WHERE l_partkey % 5 <> 0 AND l_partkey % 5 <> 1""")
def a6(r: Roles):
    happy = F.concat(F.lit('"mood_happy":{"all":{"happy":'), (F.col("l_quantity") / 40).cast("string"), F.lit("}}"))
    sad = F.concat(F.lit('"mood_sad":{"all":{"sad":'), F.col("l_discount").cast("string"), F.lit("}}"))
    body = F.when(F.col("l_partkey") % 5 == 0, happy).when(F.col("l_partkey") % 5 == 1, F.lit('"mood_happy":{}')).otherwise(F.concat_ws(",", happy, sad))
    docs = r.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit('{"highlevel":{'), body, F.lit("}}")).alias("json"))
    docs = docs.withColumnsRenamed({"l_orderkey": "o", "l_linenumber": "ln"})
    return scan.classifier_rows(docs, "json", ["o", "ln"], {"mood_happy": ("happy",), "mood_sad": ("sad",)})


@query("a7_tolerant_parse", """
    SELECT event_id, CASE WHEN x % 6 <> 0 THEN x END AS k FROM event_k WHERE x % 4 <> 1""")
def a7(r: Roles):
    x = F.col("x").cast("string")
    cell = F.when(F.col("x") % 6 == 0, F.concat(x, F.lit("?"))).otherwise(x)
    gate = F.when(F.col("x") % 4 == 1, F.lit("bad")).otherwise(F.lit("7"))
    raw = r.event_k.select("event_id", cell.alias("k"), gate.alias("g"))
    return scan.tolerant(raw, {"k": "int", "g": "int"}, F.col("g").isNotNull()).drop("g")


@query("a8_field_count_guard", """
    SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS fields FROM documents
    WHERE len(string_split(text, ' ')) <> 3""")
def a8(r: Roles):
    return scan.wrong_width(r.documents.select("doc_id", "text"), "text", 3, " ").select("doc_id", "fields")


@query("a9_sorted_parquet_export", "SELECT count(*) AS n, sum(listens) :: BIGINT AS listens, count(DISTINCT track_id) AS ids, "
       "true AS ranges_apart FROM tracks")
def a9(r: Roles):
    path = scratch_path(r.spark, "export")
    sink.write_catalog(r.tracks, path)
    files = r.spark.read.parquet(path).withColumn("_file", F.col("_metadata.file_name"))
    spans = files.groupBy("_file").agg(F.min("track_id").alias("lo"), F.max("track_id").alias("hi"), F.count("*").alias("n"),
                                       F.sum("listens").alias("listens"), F.count_distinct("track_id").alias("ids"))
    # File ranges lie apart exactly when the sum of spans fits inside the whole span.
    apart = F.sum(F.col("hi") - F.col("lo")) + F.count("*") - 1 <= F.max("hi") - F.min("lo")
    return spans.agg(F.sum("n").alias("n"), F.sum("listens").alias("listens"), F.sum("ids").alias("ids"), apart.alias("ranges_apart"))


@query("a10_read_catalog_either_format", "SELECT track_id, title, genre, year, energy FROM tracks WHERE track_id % 2 = 0 "
       "UNION ALL SELECT track_id, title, genre, year, energy FROM tracks WHERE track_id % 2 = 1")
def a10(r: Roles):
    cols = r.tracks.select("track_id", "title", "genre", "year", "energy")
    first, second = scratch_path(r.spark, "cat"), scratch_path(r.spark, "cat")
    sink.write_catalog(cols.where("track_id % 2 = 0"), f"{first}/tracks.parquet")
    sink.write_json_lines(cols.where("track_id % 2 = 1"), f"{second}/tracks.jsonl", "track_id")
    return scan.scan_catalog(r.spark, first, cols.schema).unionByName(scan.scan_catalog(r.spark, second, cols.schema))


@query("a11_inline_lookup", """
    SELECT p_type, v.tier, count(*) AS n FROM part JOIN (VALUES ('PROMO', 1), ('LARGE', 2)) AS v(t, tier) ON v.t = p_type
    GROUP BY 1, 2""")
def a11(r: Roles):
    table = lookup(r.spark, [("PROMO", 1), ("LARGE", 2)], "p_type string, tier int")
    return r.part.join(table, "p_type").groupBy("p_type", "tier").agg(F.count("*").alias("n"))


@query("a12_config_map_to_rows", """
    SELECT p_brand AS brand, p_type AS type, count(*) AS n FROM part GROUP BY 1, 2""")
def a12(r: Roles):
    counts = r.part.groupBy("p_brand", "p_type").count()
    pairs = F.map_from_entries(F.collect_list(F.struct("p_type", "count")))
    config = counts.groupBy("p_brand").agg(pairs.alias("effects"))
    return scan.long_rows(config, "p_brand", "effects", ("brand", "type", "n"))


@query("a13_commented_alternatives", """
    SELECT p_partkey AS song, 'intl' AS market, a AS artist, t AS title
    FROM part, unnest([p_brand, p_type]) AS x(a), unnest([p_name, 'The ' || p_name]) AS y(t) WHERE p_partkey % 5 <> 0""")
def a13(r: Roles):
    body = F.concat(F.lit("intl\t"), "p_brand", F.lit(" , "), "p_type", F.lit("\t"), "p_name", F.lit(",The "), "p_name", F.lit(",\r"))
    line = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("# "), body)).otherwise(body)
    return scan.alternatives(r.part.select(F.col("p_partkey").alias("song"), line.alias("line")), "line")


@query("a14_canonical_json_lines", """
    SELECT c_custkey, '{"c_acctbal":' || CAST(c_acctbal AS VARCHAR) || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"'
           || c_mktsegment || '"}' AS line FROM customer""")
def a14(r: Roles):
    rows = r.customer.select("c_mktsegment", "c_custkey", "c_acctbal")
    return sink.canonical_json(rows, {"c_acctbal": 2}).select("c_custkey", "line")


_ROW = "concat_ws('|', track_id, title, genre, year, listeners)"
_LANE_SQL = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {8 * i + 1}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query("a15_content_digest", f"""
    SELECT sha256(concat_ws('-', CAST(count(*) AS VARCHAR), {_LANE_SQL})) AS digest
    FROM (SELECT sha256(CAST(to_json({{'track_id': track_id, 'title': title, 'genre': genre, 'year': year, 'listeners': listeners}}) AS VARCHAR)) AS h FROM tracks)""")
def a15(r: Roles):
    return sink.content_digest(r.tracks, ["track_id", "title", "genre", "year", "listeners"])


_TREE_ROWS = ["track_id", "title", "genre", "year", "listeners"]


def _tree_sql(rows: str) -> str:
    """(node, n, digest) of a hash tree of two levels below its root."""
    row = "to_json({" + ", ".join(f"'{c}': {c}" for c in _TREE_ROWS) + "})"
    return f"""
      l2 AS (SELECT substr(sha256(CAST(track_id AS VARCHAR)), 1, 2) AS node, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM (SELECT track_id, sha256(CAST({row} AS VARCHAR)) AS h FROM {rows}) GROUP BY 1),
      l1 AS (SELECT substr(node, 1, 1) AS node, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(node || ':' || digest, '' ORDER BY node)) AS digest FROM l2 GROUP BY 1),
      l0 AS (SELECT '' AS node, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(node || ':' || digest, '' ORDER BY node)) AS digest FROM l1)"""


_CHANGED = "(SELECT track_id, CASE WHEN track_id % 997 = 0 THEN title || '!' ELSE title END AS title, genre, year, listeners FROM tracks WHERE track_id % 1009 <> 5)"


@query("a15_hash_tree", f"WITH {_tree_sql('tracks')} SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2")
def a15_tree(r: Roles):
    return sink.hash_tree(r.tracks, "track_id", 2, _TREE_ROWS)


@query("a22_differing_ranges", f"""
    SELECT coalesce(a.node, b.node) AS node, coalesce(a.n, 0) AS n, coalesce(b.n, 0) AS n_other FROM (WITH {_tree_sql('tracks')} SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) a
    FULL JOIN (WITH {_tree_sql(_CHANGED)} SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) b ON a.node = b.node WHERE a.digest IS DISTINCT FROM b.digest""")
def a22_ranges(r: Roles):
    """Where a catalog differs from one with some titles changed and some tracks gone."""
    other = r.tracks.where("track_id % 1009 <> 5").withColumn("title", F.when(F.col("track_id") % 997 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return sink.differing_ranges(sink.hash_tree(r.tracks, "track_id", 2, _TREE_ROWS), sink.hash_tree(other, "track_id", 2, _TREE_ROWS))


@query("a16_csv_rows", """
    SELECT doc_id, CASE WHEN regexp_matches(c, '[",\\r\\n]|^\\s|\\s$') THEN '"' || replace(c, '"', '""') || '"' ELSE c END
           || ',' || source || ',,,US' || doc_id || ',' || doc_id AS line
    FROM (SELECT doc_id, source, CASE WHEN regexp_matches(t, '^[=+\\-@\\t\\r]') THEN '''' || t ELSE t END AS c
          FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN '=' ELSE '' END || text AS t FROM documents))""")
def a16(r: Roles):
    title = F.concat(F.when(F.col("doc_id") % 3 == 0, "=").otherwise(""), "text")
    rows = r.documents.select(
        "doc_id", title.alias("title"), F.col("source").alias("artist"), F.lit(None).cast("string").alias("album"),
        F.lit(None).cast("int").alias("year"), F.col("doc_id").alias("track_id"),
        F.array(F.concat(F.lit("US"), F.col("doc_id").cast("string")), F.lit("second")).alias("isrcs"),
    )
    return sink.csv_lines(rows).select("doc_id", "line")


def _playlist_rows(r: Roles):
    t = r.track_base.select("track_id", "title", "artist", "genre", "year", "length_ms")
    return r.playlist_track.join(t, "track_id").select(
        "playlist_id", "pos", "track_id", "title", "artist", F.col("genre").alias("album"), "year", "length_ms",
        F.array(F.concat(F.lit("US"), F.col("track_id").cast("string"))).alias("isrcs"),
    )


_LINES = "SELECT p.playlist_id, p.pos, t.* FROM playlist_track p JOIN track_base t ON t.track_id = p.track_id"


@query("a17_export_m3u", f"""
    SELECT playlist_id, '#EXTM3U' || chr(10) || '#PLAYLIST:Mix ' || playlist_id || chr(10)
      || string_agg('#EXTINF:' || length_ms // 1000 || ',' || artist || ' - ' || title || chr(10)
         || 'https://musicbrainz.org/recording/' || track_id, chr(10) ORDER BY pos) || chr(10) AS body
    FROM ({_LINES}) GROUP BY playlist_id""")
def a17(r: Roles):
    return sink.playlist_documents(_playlist_rows(r), "m3u", F.concat(F.lit("Mix "), F.col("playlist_id").cast("string")))


@query("a17_export_song_list", f"""
    SELECT playlist_id, string_agg(artist || ' - ' || title, chr(10) ORDER BY pos) || chr(10) AS body
    FROM ({_LINES}) GROUP BY playlist_id""")
def a17b(r: Roles):
    return sink.playlist_documents(_playlist_rows(r), "songlist", F.lit("x"))


@query("a17_export_xspf", f"""
    SELECT playlist_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10)
      || '<playlist version="1" xmlns="http://xspf.org/ns/0/">' || chr(10) || '  <title>A &amp; B</title>' || chr(10)
      || '  <annotation>List &lt;' || playlist_id || '&gt;</annotation>' || chr(10)
      || '  <trackList>' || chr(10) || string_agg('    <track>' || chr(10)
      || '      <identifier>https://musicbrainz.org/recording/' || track_id || '</identifier>' || chr(10)
      || '      <identifier>urn:isrc:US' || track_id || '</identifier>' || chr(10)
      || '      <title>' || title || '</title>' || chr(10) || '      <creator>' || artist || '</creator>' || chr(10)
      || coalesce('      <album>' || genre || '</album>' || chr(10), '')
      || '      <trackNum>' || pos || '</trackNum>' || chr(10)
      || '      <duration>' || length_ms || '</duration>' || chr(10) || '    </track>', chr(10) ORDER BY pos) || chr(10)
      || '  </trackList>' || chr(10) || '</playlist>' || chr(10) AS body
    FROM ({_LINES}) GROUP BY playlist_id""")
def a17c(r: Roles):
    return sink.playlist_documents(_playlist_rows(r), "xspf", F.lit("A & B"), {"description": F.concat(F.lit("List <"), F.col("playlist_id").cast("string"), F.lit(">"))})


@query("a17_export_json", f"""
    SELECT playlist_id, '{{"format":"cratewise.playlist","version":1,"title":"Mix ' || playlist_id || '","description":"By \\"request\\"","catalog_version":"2026.1",'
      || '"engine_version":"3","seed":"s' || playlist_id || '","length":' || count(*) || ',"taste":{{"target":[' || playlist_id % 100 || ',0],"genres":null}},"tweaks":[],"tracks":['
      || string_agg('{{"track_id":' || track_id || ',"title":"' || title || '","artist":"' || artist || '","album":' || coalesce('"' || genre || '"', 'null') || ',"year":'
      || coalesce(CAST(year AS VARCHAR), 'null') || ',"isrcs":["US' || track_id || '"],"length_ms":' || length_ms || '}}',
      ',' ORDER BY pos) || ']}}' || chr(10) AS body
    FROM ({_LINES}) GROUP BY playlist_id""")
def a17d(r: Roles):
    rows = _playlist_rows(r)
    key = F.col("playlist_id").cast("string")
    taste = F.struct(F.array(F.col("playlist_id") % 100, F.lit(0)).alias("target"), F.lit(None).cast("string").alias("genres"))
    details = {"description": F.lit('By "request"'), "catalog_version": F.lit("2026.1"), "engine_version": F.lit("3"), "seed": F.concat(F.lit("s"), key),
               "length": F.col("n"), "taste": taste, "tweaks": F.array().cast("array<string>")}
    sized = rows.join(rows.groupBy("playlist_id").agg(F.count("*").alias("n")), "playlist_id")
    return sink.playlist_documents(sized, "json", F.concat(F.lit("Mix "), key), details)


@query("a18_row_rules", """
    SELECT l_orderkey, l_linenumber, l_partkey, rule FROM lineitem, unnest(['discount', 'flag', 'quantity']) AS u(rule)
    WHERE (rule = 'discount' AND NOT l_discount BETWEEN 0 AND 0.08) OR (rule = 'flag' AND l_returnflag NOT IN ('A', 'R'))
       OR (rule = 'quantity' AND l_quantity < 3)""")
def a18(r: Roles):
    checks = {"discount": F.col("l_discount").between(0, 0.08), "flag": F.col("l_returnflag").isin("A", "R"),
              "quantity": F.col("l_quantity") >= 3}
    return rules.violations(r.lineitem, ["l_orderkey", "l_linenumber", "l_partkey"], checks)


@query("a19_vocabulary_conformance", """
    SELECT DISTINCT p_type AS key FROM part WHERE p_type NOT IN ('PROMO', 'LARGE', 'SMALL')""")
def a19(r: Roles):
    known = lookup(r.spark, [("PROMO",), ("LARGE",), ("SMALL",)], "key string")
    return rules.unknown_keys(r.part.select(F.col("p_type").alias("key")), known, "key")


@query("a20_tag_map_issues", """
    WITH tags AS (SELECT p_name AS tag, CASE WHEN p_partkey % 9 = 0 THEN 'nope' ELSE p_type END AS key,
                         (p_size - 10) / 30.0 AS value FROM part)
    SELECT 'tags.' || tag AS place, CASE WHEN key = 'nope' THEN 'unknown key' ELSE 'cluster weight out of range' END AS message
    FROM tags WHERE key = 'nope' OR value <= 0 OR value > 1
    UNION ALL SELECT 'priors.PROMO', 'prior out of range'
    UNION ALL SELECT 'priors.other', 'unknown cluster'
    UNION ALL SELECT 'classes.genre_x__a', 'unknown class'
    UNION ALL SELECT 'non_music', 'duplicate red bolt'
    UNION ALL SELECT 'non_music', 'also mapped ' || n FROM (VALUES ('red bolt'), ('zzz')) AS v(n) WHERE n IN (SELECT tag FROM tags)
    UNION ALL SELECT 'tags', 'too few tags for ' || k FROM dims d
      WHERE grp = 'genres' AND (SELECT count(*) FROM tags WHERE key = d.k) < 30""")
def a20(r: Roles):
    key = F.when(F.col("p_partkey") % 9 == 0, F.lit("nope")).otherwise(F.col("p_type"))
    tags = r.part.select(F.col("p_name").alias("tag"), key.alias("key"), ((F.col("p_size") - 10) / 30.0).alias("value"))
    priors = lookup(r.spark, [("PROMO", "complexity", 1.5), ("other", "intensity", 0.1)], "cluster string, key string, value double")
    classes = lookup(r.spark, [("genre_x__a", "PROMO", 0.5), ("genre_dortmund__pop", "PROMO", 0.5)], "class string, cluster string, value double")
    out = lookup(r.spark, [("red bolt",), ("red bolt",), ("zzz",)], "tag string")
    clusters = r.dims.where("grp = 'genres'").select(F.col("k").alias("cluster"))
    return rules.tag_map_issues(tags, priors, classes, out, clusters, min_tags=30)


@query("a21_best_snapshot", """
    SELECT gid, users, listens FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY users DESC NULLS LAST, listens DESC) AS rn
      FROM pop_cache) WHERE rn = 1""")
def a21(r: Roles):
    return rules.best_snapshot(r.pop_cache)


@query("a21_missing_batches", """
    SELECT gid, CAST(floor((row_number() OVER (ORDER BY gid) - 1) / 100) AS BIGINT) AS batch FROM
      (SELECT gid FROM recording EXCEPT SELECT gid FROM pop_cache)""")
def a21b(r: Roles):
    return rules.missing_batches(r.recording, r.pop_cache, 100)


@query("a22_manifest_check", """
    SELECT p_brand AS part, CAST(count(*) + (CASE WHEN p_brand < 'Brand#2' THEN 1 ELSE 0 END) AS BIGINT) AS expected, count(*) AS found
    FROM part GROUP BY p_brand HAVING p_brand < 'Brand#2'""")
def a22(r: Roles):
    rows = F.count("*") + F.when(F.col("part") < "Brand#2", 1).otherwise(0)
    data = r.part.withColumnRenamed("p_brand", "part")
    return sink.row_count_mismatch(data, data.groupBy("part").agg(F.count("*").alias("c")).select("part", (F.col("c") + F.when(F.col("part") < "Brand#2", 1).otherwise(0)).alias("rows")))


@query("a22_manifest", f"""
    SELECT '2026.1' AS catalog_version, count(*) AS tracks, sha256(concat_ws('-', CAST(count(*) AS VARCHAR), {_LANE_SQL})) AS digest
    FROM (SELECT sha256(CAST(to_json({{'track_id': track_id, 'title': title, 'genre': genre, 'year': year}}) AS VARCHAR)) AS h FROM tracks)""")
def a22b(r: Roles):
    return sink.manifest(r.tracks, "2026.1", ["track_id", "title", "genre", "year"])
