"""Readers. Schemas are always declared; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cratewise.functions.features import CLASSIFIERS

#: Dump text: tab-separated, ``\N`` for null, no quoting at all.
COPY_OPTIONS = {"sep": "\t", "nullValue": r"\N", "quote": "", "escape": "", "emptyValue": ""}
_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def scan_copy(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Headerless dump files (a path, list or glob) as string columns."""
    return spark.read.schema(text_schema(columns)).options(**COPY_OPTIONS).csv(path)


def parse_copy(lines: DataFrame, line: str, columns: list[str]) -> DataFrame:
    """The same text when it already is a column of lines."""
    cells = F.split(F.col(line), "\t", -1)
    value = lambda i: F.nullif(F.get(cells, F.lit(i)), F.lit(r"\N"))
    return lines.select(*[value(i).alias(c) for i, c in enumerate(columns)])


def scan_headed_csv(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """CSV files with a header line; the declared names must be the header's."""
    return spark.read.schema(text_schema(columns)).options(header=True, enforceSchema=False).csv(path)


def wrong_width(lines: DataFrame, line: str, expected: int, sep: str = "\t") -> DataFrame:
    """Lines whose number of fields is not the declared one."""
    width = F.size(F.split(F.col(line), sep, -1))
    return lines.withColumn("fields", width).where(width != expected)


def require_width(lines: DataFrame, line: str, expected: int, sep: str = "\t") -> None:
    first = wrong_width(lines, line, expected, sep).head(1)
    if first:
        raise ValueError(f"expected {expected} fields, found {first[0]['fields']}: {first[0][line][:200]!r}")


def tolerant(df: DataFrame, casts: dict[str, str], keep: Column | None = None) -> DataFrame:
    """Cast columns; a cell that does not parse is null, and ``keep`` then drops what must be present."""
    out = df.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items()})
    return out if keep is None else out.where(keep)


USER_LIST = "user_id int, data array<struct<recording_mbid: string, listen_count: int>>"


def user_lists(documents: DataFrame, valid_id: str = _UUID) -> DataFrame:
    """One row per list item of every user document, with ``ok`` saying whether it maps to a recording."""
    item = F.explode("data").alias("item")
    rows = documents.where("user_id is not null and data is not null").select("user_id", item)
    gid, listens = F.col("item.recording_mbid"), F.col("item.listen_count")
    ok = F.coalesce(gid.rlike(valid_id) & listens.isNotNull(), F.lit(False))
    return rows.select("user_id", gid.alias("gid"), listens.alias("listens"), ok.alias("ok"))


def scan_user_lists(spark: SparkSession, path: str) -> DataFrame:
    return user_lists(spark.read.schema(USER_LIST).json(path))


def user_list_counts(rows: DataFrame) -> DataFrame:
    """Users, mapped rows and rejected rows of a user-list extract."""
    return rows.agg(
        F.count_distinct("user_id").alias("users"),
        F.count_if("ok").alias("rows"),
        F.count_if(~F.col("ok")).alias("unmapped"),
    )


HIGHLEVEL = T.StructType([
    T.StructField("highlevel", T.MapType(
        T.StringType(), T.StructType([T.StructField("all", T.MapType(T.StringType(), T.DoubleType()))])
    ))
])


def classifier_rows(documents: DataFrame, json: str, keys: list[str], classifiers=CLASSIFIERS) -> DataFrame:
    """Classifier documents → one probability column per class; a document missing any class is dropped."""
    parsed = documents.withColumn("_doc", F.from_json(json, HIGHLEVEL))
    columns = {}
    for name, classes in classifiers.items():
        found = F.try_element_at(F.col("_doc.highlevel"), F.lit(name)).getField("all")
        for k in classes:
            p = F.try_element_at(found, F.lit(k))
            sane = F.when(p.isNotNull() & ~F.isnan(p), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)), 5))
            columns[f"{name}__{k}"] = sane
    rows = parsed.select(*keys, *[c.alias(n) for n, c in columns.items()])
    return rows.dropna(how="any", subset=list(columns))


def alternatives(lines: DataFrame, line: str) -> DataFrame:
    """(song, market, artist, title): commented three-column text with comma-separated alternatives.

    ``lines`` carries a ``song`` number next to the text.
    """
    real = lines.where((F.trim(line) != "") & ~F.col(line).startswith("#"))
    cells = F.split(F.regexp_replace(F.col(line), "\r$", ""), "\t")
    options = lambda i: F.filter(
        F.transform(F.split(F.get(cells, F.lit(i)), ","), lambda x: F.trim(x)), lambda x: x != ""
    )
    rows = real.select("song", F.get(cells, F.lit(0)).alias("market"), options(1).alias("_a"), options(2).alias("_t"))
    return rows.withColumn("artist", F.explode("_a")).withColumn("title", F.explode("_t")).drop("_a", "_t")


def long_rows(config: DataFrame, key: str, mapping: str, names: tuple[str, str, str]) -> DataFrame:
    """A map column as (key, subkey, value) rows."""
    return config.select(F.col(key).alias(names[0]), F.explode(mapping).alias(names[1], names[2]))


def scan_catalog(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The catalog in ``folder``: Parquet when there is any, else gzipped JSON lines, with one schema."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    table = jvm.org.apache.hadoop.fs.Path(base, "tracks.parquet")
    if fs.exists(table):
        return spark.read.schema(schema).parquet(table.toString())
    lines = next((name for name in ("tracks.jsonl.gz", "tracks.jsonl") if fs.exists(jvm.org.apache.hadoop.fs.Path(base, name))), "tracks.jsonl")
    return spark.read.schema(schema).json(f"{folder}/{lines}")
