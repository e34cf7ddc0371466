"""A cross-section of registered queries against DuckDB; ``python -m tests.check`` runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from cratewise.queries.roles import BASE_TABLES
from tests.compare import difference

FOLDER = "/root/testdata/sf0.001"
NAMES = ["a15_content_digest", "b8_holiday_flag", "c7_redirect_resolution", "c8_sibling_expansion", "d23_spearman", "e7_average_rank_quantile",
         "e13_apportion_with_floor", "h3_norm_title", "i1_canonical_songs", "i22_known_songs", "j5_group_distribution", "j9_adjust_groups", "k4_cell_plan",
         "l3_mean_pairwise_distance", "m4_hourly_latency", "m8_last_touch_source"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    assert difference(entry.queries()[name](spark, FOLDER), duck.execute(entry.oracle_sql()[name])) is None


def test_every_text_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
