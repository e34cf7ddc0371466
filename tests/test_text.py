"""Fixed vectors of the text functions."""

import pytest
from pyspark.sql import functions as F

from cratewise.functions import text as tx

TITLES = [
    ("Rivers Don't Wait", "", "rivers don t wait", "studio"),
    ("Rivers Don't Wait - 1998 Remaster", "", "rivers don t wait", "studio"),
    ("RIVERS DON'T WAIT (Remastered 1998)", "", "rivers don t wait", "studio"),
    ("Rivers Don't Wait (Live in Oslo 2003)", "", "rivers don t wait", "live"),
    ("Rivers Don't Wait", "live, 2003-06-11: Bergen", "rivers don t wait", "live"),
    ("Paper Lamp (feat. Ana Q)", "", "paper lamp", "studio"),
    ("Paper Lamp feat. Ana Q", "", "paper lamp", "studio"),
    ("North Road (Radio Edit)", "", "north road", "studio"),
    ("Second Shift '09 (Remix)", "", "second shift 09 remix", "studio"),
    ("Live Wires", "", "live wires", "studio"),
    ("Señor Árbol", "", "senor arbol", "studio"),
    ("שיר חדש", "", "שיר חדש", "studio"),
    ("Река", "", "река", "studio"),
    ("!", "", "!", "studio"),
]


def test_title_keys_and_versions(spark):
    df = spark.createDataFrame([t[:2] for t in TITLES], "title string, comment string")
    got = df.select(tx.norm_title(F.col("title")), tx.version_type(F.col("title"), F.col("comment"))).collect()
    assert [tuple(r) for r in got] == [t[2:] for t in TITLES]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("a", "b", "expected"), [("garden", "warden s", 1 - 3 / 8), ("same", "same", 1.0), ("", "x", 0.0)])
def test_similarity(spark, a, b, expected):
    assert one(spark, tx.similarity(F.lit(a), F.lit(b))) == pytest.approx(expected)


def test_credits(spark):
    assert one(spark, tx.credit_names(F.lit("The A & B feat. C"))) == ["a b feat c", "a", "b", "c"]


def test_copy_text_round_trip(spark):
    for s in ("a\tb", "back\\slash", "line\nbreak", "\\t literally"):
        assert one(spark, tx.unescape_copy(tx.escape_copy(F.lit(s)))) == s


@pytest.mark.parametrize(("address", "key"), [
    ("::ffff:10.1.2.3", "10.1.2.3"), ("10.1.2.3", "10.1.2.3"), ("2001:DB8:0:1:2:3:4:5", "2001:db8:0:1::/64"), ("2001::5", "2001:0:0:0::/64"),
])
def test_client_key(spark, address, key):
    assert one(spark, tx.client_key(F.lit(address))) == key


def test_csv_formula_guard(spark):
    assert one(spark, tx.csv_field(F.lit("=1+1"))) == "'=1+1"
    assert one(spark, tx.csv_field(F.lit('a "b", c'))) == '"a ""b"", c"'
