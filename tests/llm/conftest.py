import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table of (id, text) rows, with the other columns and one that clashes with operator columns."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string")

    return make


@pytest.fixture
def folder_of(spark, tmp_path):
    """A folder of parquet tables, as the queries read it."""

    def make(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
