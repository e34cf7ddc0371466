"""Vector tables as the search operators take them: usable rows, numpy matrices, blocks of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.llm.common import keyed


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding as array<double>) of the rows whose vector is there, without nulls and finite. Of rows that
    repeat an id the smallest vector counts."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return keyed(embeddings, "vec_id", embedding="array<double>").where(F.col("embedding").isNotNull() & finite)


def matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column; shorter vectors end in zeros, which changes no inner product."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return np.zeros((0, width))
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = max(width, int(lengths.max(initial=0)))
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the width of the wider."""
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(blocks))


def best(found: DataFrame, k: int) -> DataFrame:
    """Of (query_id, vec_id, score) each query's k largest scores, ties to the smaller vec_id, ranked from 1."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
