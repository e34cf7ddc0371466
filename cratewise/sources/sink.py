"""Sinks: sorted Parquet, canonical JSON lines, digests, manifests and playlist documents."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cratewise.functions.text import csv_field, one_line, xml_text
from cratewise.session import fixed, shuffle_width

_LANES = 8  # 8 × 32 bits of each row hash


def write_catalog(df: DataFrame, path: str, key: str = "track_id", rows_per_file: int = 5_000_000) -> None:
    """Globally sorted by ``key``, zstd, bounded files; every file holds its own key range."""
    (
        df.repartitionByRange(shuffle_width(df.sparkSession), key).sortWithinPartitions(key)
        .write.mode("errorifexists").option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file).parquet(path)
    )


def canonical_json(df: DataFrame, digits: dict[str, int] | None = None, default_digits: int = 4) -> DataFrame:
    """One ``line`` per row: keys sorted, fractions rounded per column."""
    digits = digits or {}
    cols = []
    for field in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), digits.get(field.name, default_digits))
        cols.append(c.alias(field.name))
    return df.select(*[f.name for f in df.schema.fields], F.to_json(
        F.struct(*cols), {"ignoreNullFields": "false"}
    ).alias("line"))


def write_json_lines(df: DataFrame, path: str, key: str, **rounding) -> None:
    lines = canonical_json(df, **rounding)
    (
        lines.repartitionByRange(shuffle_width(df.sparkSession), key).sortWithinPartitions(key)
        .select("line").write.option("compression", "gzip").text(path)
    )


def content_digest(df: DataFrame, columns: list[str] | None = None, name: str = "digest") -> DataFrame:
    """One digest of the whole table: row hashes added lane by lane, then hashed once more.

    A row's text is its JSON with nulls, so rows that differ in any column, or in which column is null, differ.
    Addition does not depend on row order, so the table is neither sorted nor brought together; with a unique id
    among the columns equal content still means equal digest.
    """
    row_text = F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})
    rows = df.select(F.sha2(row_text, 256).alias("_h"))
    lane = lambda i: F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = rows.agg(F.count("*").alias("_n"), *[F.sum(lane(i)).alias(f"_l{i}") for i in range(_LANES)])
    parts = [F.coalesce(F.col(f"_l{i}"), F.lit(0)).cast("decimal(30,0)").cast("string") for i in range(_LANES)]
    return sums.select(F.sha2(F.concat_ws("-", F.col("_n").cast("string"), *parts), 256).alias(name))


#: Rows of a leaf of a hash tree, at most on average.
LEAF_ROWS = 256


def tree_depth(rows: int) -> int:
    """Levels below the root of a hash tree over so many rows: sixteen children a node."""
    return max(0, math.ceil(math.log(max(rows, 1) / LEAF_ROWS, 16)))


def hash_tree(df: DataFrame, key: str, depth: int, columns: list[str] | None = None) -> DataFrame:
    """(node, n, digest) of the nodes of a hash tree over ranges of the key's hash; the root is the node ''.

    A node is a prefix of the hash of the (unique) key, a leaf one of ``depth`` digits. A leaf hashes the sorted hashes of its
    rows, any other node those of its children with their names, so that equal content, in whatever order and files, and only
    that, gives equal digests; and two tables can be compared range by range. Rows are grouped once, never sorted as a whole;
    the levels above have a sixteenth of the rows each.
    """
    row_text = F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})
    rows = df.select(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, depth).alias("node"), F.sha2(row_text, 256).alias("h"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256).alias("digest")
    levels = [fixed(rows.groupBy("node").agg(F.count("*").alias("n"), joined(F.col("h"))))]
    for digits in range(depth - 1, -1, -1):
        parent = F.substring("node", 1, digits).alias("node")
        levels.append(levels[-1].groupBy(parent).agg(F.sum("n").alias("n"), joined(F.concat("node", F.lit(":"), "digest"))))
    return reduce(DataFrame.unionByName, levels)


def differing_ranges(one: DataFrame, other: DataFrame) -> DataFrame:
    """(node, n, n_other) of the nodes of two hash trees of one depth that differ; 0 rows where a table has none there."""
    both = one.join(other.select("node", F.col("n").alias("n_other"), F.col("digest").alias("_d")), "node", "full")
    differ = ~F.col("digest").eqNullSafe(F.col("_d"))
    return both.where(differ).select("node", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_other", F.lit(0)).alias("n_other"))


def manifest(df: DataFrame, version: str, columns: list[str] | None = None) -> DataFrame:
    """(catalog_version, tracks, digest): one row."""
    count = df.agg(F.count("*").alias("tracks")).withColumn("_one", F.lit(1))
    digest = content_digest(df, columns).withColumn("_one", F.lit(1))
    return count.join(digest, "_one").select(F.lit(version).alias("catalog_version"), "tracks", "digest")


def file_sizes(written: DataFrame) -> DataFrame:
    """(file, bytes, rows) of the files a read table consists of; names without folder."""
    files = written.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return files.groupBy("file", "bytes").agg(F.count("*").alias("rows"))


def row_count_mismatch(df: DataFrame, expected: DataFrame, key: str = "part") -> DataFrame:
    """Parts whose row count differs from the manifest's ``rows``."""
    have = df.groupBy(key).agg(F.count("*").alias("found"))
    both = expected.join(have, key, "full_outer")
    return both.select(
        key, F.coalesce("rows", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found")
    ).where("expected <> found")


def csv_lines(tracks: DataFrame) -> DataFrame:
    """Playlist rows as CSV text: title, artist, album, year, first ISRC, id."""
    cells = [
        F.col("title"), F.col("artist"), F.coalesce("album", F.lit("")),
        F.coalesce(F.col("year").cast("string"), F.lit("")),
        F.coalesce(F.get("isrcs", F.lit(0)), F.lit("")), F.col("track_id").cast("string"),
    ]
    return tracks.withColumn("line", F.concat_ws(",", *[csv_field(c) for c in cells]))


def song_line() -> Column:
    return F.concat(one_line(F.col("artist")), F.lit(" - "), one_line(F.col("title")))


def recording_url() -> Column:
    return F.concat(F.lit("https://musicbrainz.org/recording/"), F.col("track_id").cast("string"))


def m3u_entry() -> Column:
    seconds = F.coalesce(F.round(F.col("length_ms") / 1000), F.lit(-1)).cast("long").cast("string")
    return F.concat(F.lit("#EXTINF:"), seconds, F.lit(","), song_line(), F.lit("\n"), recording_url())


def xspf_entry() -> Column:
    element = lambda name, value: F.concat(
        F.lit(f"      <{name}>"), xml_text(value), F.lit(f"</{name}>")
    )
    codes = F.transform(F.coalesce("isrcs", F.array().cast("array<string>")), lambda c: element(
        "identifier", F.concat(F.lit("urn:isrc:"), c)
    ))
    lines = F.concat(
        F.array(F.lit("    <track>"), element("identifier", recording_url())), codes,
        F.array(
            element("title", one_line(F.col("title"))), element("creator", one_line(F.col("artist"))),
            element("album", one_line(F.col("album"))), element("trackNum", F.col("pos").cast("string")),
            element("duration", F.col("length_ms").cast("string")), F.lit("    </track>"),
        ),
    )
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def json_entry() -> Column:
    fields = ["track_id", "title", "artist", "album", "year", "isrcs", "length_ms"]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


ENTRIES = {"m3u": m3u_entry, "xspf": xspf_entry, "songlist": song_line, "json": json_entry}
#: Name and version of the JSON document's format.
JSON_FORMAT, JSON_VERSION = "cratewise.playlist", 1
_TAIL = {"m3u": "\n", "xspf": "\n  </trackList>\n</playlist>\n", "songlist": "\n", "json": "]}\n"}
_SEPARATOR = {"m3u": "\n", "xspf": "\n", "songlist": "\n", "json": ","}


def _head(kind: str, title: Column, details: dict[str, Column]) -> Column:
    if kind == "m3u":
        return F.concat(F.lit("#EXTM3U\n#PLAYLIST:"), one_line(title), F.lit("\n"))
    if kind == "xspf":
        note = F.concat(F.lit("  <annotation>"), xml_text(details["description"]), F.lit("</annotation>\n")) if "description" in details else F.lit("")
        return F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<playlist version="1" xmlns="http://xspf.org/ns/0/">\n  <title>'),
            xml_text(one_line(title)), F.lit("</title>\n"), F.coalesce(note, F.lit("")), F.lit("  <trackList>\n"),
        )
    if kind == "json":
        fields = F.struct(F.lit(JSON_FORMAT).alias("format"), F.lit(JSON_VERSION).alias("version"), title.alias("title"), *(c.alias(n) for n, c in details.items()))
        return F.concat(F.regexp_replace(F.to_json(fields, {"ignoreNullFields": "false"}), r"\}$", ""), F.lit(',"tracks":['))
    return F.lit("")


def playlist_documents(tracks: DataFrame, kind: str, title: Column, details: dict[str, Column] | None = None) -> DataFrame:
    """(playlist_id, body): one whole document a playlist, its lines in play order.

    ``details``: further columns of the playlist, same on all its rows. JSON writes them after the title in the order
    given (description, catalog_version, engine_version, seed, length, taste, tweaks); XSPF writes description.
    """
    rows = tracks.select("playlist_id", "pos", _head(kind, title, details or {}).alias("head"), ENTRIES[kind]().alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    whole = rows.groupBy("playlist_id").agg(F.first("head").alias("_h"), F.array_join(lines, _SEPARATOR[kind]).alias("_b"))
    return whole.select("playlist_id", F.concat("_h", "_b", F.lit(_TAIL[kind])).alias("body"))


def write_documents(documents: DataFrame, path: str, buckets: int = 64) -> None:
    """One row a playlist, in ``buckets`` folders by a hash of the id: a reader of one playlist opens one folder."""
    documents.withColumn("bucket", F.pmod(F.xxhash64("playlist_id"), F.lit(buckets))).repartition("bucket").write.mode("errorifexists").partitionBy("bucket").parquet(path)
