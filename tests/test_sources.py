"""Readers and sinks on real files."""

import pytest
from pyspark.sql import functions as F

from cratewise.sources import rules, scan, sink


def test_copy_text_files(spark, tmp_path):
    (tmp_path / "t-0.tsv").write_text('1\tsay "hi"\t\\N\n2\ta\\\\b\t5\n')
    (tmp_path / "t-1.tsv").write_text("3\tx\t7\n")
    got = scan.scan_copy(spark, str(tmp_path / "t-*.tsv"), ["id", "name", "n"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", 'say "hi"', None), ("2", "a\\\\b", "5"), ("3", "x", "7")]


def test_width_guard(spark):
    lines = spark.createDataFrame([("a\tb",), ("a\tb\tc",)], "line string")
    scan.require_width(lines.limit(1), "line", 2)
    with pytest.raises(ValueError, match="expected 2 fields, found 3"):
        scan.require_width(lines, "line", 2)


def test_user_lists_reject_bad_ids(spark, tmp_path):
    good = "0" * 8 + "-0000-0000-0000-" + "0" * 12
    (tmp_path / "u.jsonl").write_text(
        f'{{"user_id": 1, "data": [{{"recording_mbid": "{good}", "listen_count": 3}}, {{"recording_mbid": null, "listen_count": 1}}]}}\n{{"user_id": 2}}\n')
    row = scan.user_list_counts(scan.scan_user_lists(spark, str(tmp_path / "u.jsonl"))).first()
    assert tuple(row) == (1, 1, 1)


def test_digest_depends_on_content_only(spark):
    rows = [(i, f"t{i}") for i in range(500)]
    digest = lambda rs, n: sink.content_digest(spark.createDataFrame(rs, "id int, t string").repartition(n)).first()[0]
    assert digest(rows, 3) == digest(rows[::-1], 7) != digest(rows[:-1] + [(499, "other")], 3)


def test_catalog_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(3, "c", 0.123456), (1, "a", 1.0)], "track_id int, t string, x double")
    sink.write_json_lines(df, str(tmp_path / "c" / "tracks.jsonl"), "track_id")
    got = scan.scan_catalog(spark, str(tmp_path / "c"), df.schema).orderBy("track_id").collect()
    assert [tuple(r) for r in got] == [(1, "a", 1.0), (3, "c", 0.1235)]


def test_rules_name_every_broken_one(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, -1, None)], "id int, n int, s string")
    got = {tuple(r) for r in rules.violations(df, ["id"], {"n": F.col("n") >= 0, "s": F.col("s").isNotNull()}).collect()}
    assert got == {(2, "n"), (2, "s")}


def test_documents_are_written_whole_and_read_back(spark, tmp_path):
    from cratewise.sources import sink

    rows = spark.createDataFrame([(p, i, f"s{i}", "a", None, 2000, ["X"], 1000, i) for p in (1, 2) for i in range(1, 1_202)],
                                 "playlist_id long, pos long, title string, artist string, album string, year int, isrcs array<string>, length_ms int, track_id long")
    sink.write_documents(sink.playlist_documents(rows, "songlist", F.lit("t")), f"{tmp_path}/docs")
    back = {r.playlist_id: r.body for r in spark.read.parquet(f"{tmp_path}/docs").collect()}
    assert back[2].split("\n")[:-1] == [f"a - s{i}" for i in range(1, 1_202)] and set(back) == {1, 2}


def test_digest_tells_nulls_apart(spark):
    from cratewise.sources import sink

    digest = lambda rows: sink.content_digest(spark.createDataFrame(rows, "a string, b string")).first()[0]
    assert digest([(None, "1990")]) != digest([("1990", None)])


def test_hash_trees_tell_where_tables_differ(spark):
    rows = spark.range(5_000).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") % 5 > 0, F.lit("x")).alias("t"))
    depth = sink.tree_depth(5_000)
    assert depth == 2 and sink.tree_depth(0) == sink.tree_depth(256) == 0
    tree = sink.hash_tree(rows, "id", depth).cache()
    assert sink.differing_ranges(tree, sink.hash_tree(rows.repartition(5).orderBy(F.desc("v")), "id", depth)).count() == 0
    leaves = tree.where("length(node) = 2")
    assert tree.where("node = ''").first().n == 5_000 and leaves.agg(F.sum("n")).first()[0] == 5_000 and leaves.count() > 200
    # Two rows trade their values: a sum of row hashes over columns could not be told from the ids alone.
    other = rows.withColumn("v", F.when(F.col("id") == 3, 4).when(F.col("id") == 4, 3).otherwise(F.col("v"))).where("id <> 4999")
    found = {r.node: (r.n, r.n_other) for r in sink.differing_ranges(tree, sink.hash_tree(other, "id", depth)).collect()}
    import hashlib

    touched = {hashlib.sha256(str(i).encode()).hexdigest()[:2] for i in (3, 4, 4999)}
    assert {k for k in found if len(k) == 2} == touched and found[""] == (5_000, 4_999)
    assert sink.hash_tree(rows.limit(0), "id", 1).count() == 0
