"""Nested stratified samples of a catalog: a floor group, a share of hits, then all strata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.operators.apportion import with_floor_of_one
from cratewise.operators.ranking import evenly_spread, row_numbers
from cratewise.session import fixed


def _fill(pool: DataFrame, n: int) -> DataFrame:
    """``n`` ids of the pool, spread over its strata and inside each over its ranking."""
    if n <= 0:
        return pool.select("track_id").limit(0)
    strata = pool.groupBy("stratum").agg(F.count("*").alias("m"))
    slots = with_floor_of_one(strata, [], "m", F.lit(n), [F.col("stratum").asc()]).select("stratum", "slots")
    ranked = row_numbers(pool.select("track_id", "stratum", "rank"), ["stratum"], [F.col("rank").asc()], "_rk", "_m")
    at = ranked.join(slots, "stratum").withColumn("_i", F.col("_rk") - 1)
    return evenly_spread(at, "_i", "_m", F.col("slots")).select("track_id")


def stratified_sample(
    tracks: DataFrame, size: int, floor: int, hits_share: float, in_floor: Column, is_hit: Column, stratum: Column, best_first: list[Column]
) -> DataFrame:
    """track_ids of a sample of ``size``: ``floor`` from one group, ``hits_share`` from hits, the rest stratified."""
    flags = tracks.withColumns({"_floor": F.coalesce(in_floor, F.lit(False)), "_hit": F.coalesce(is_hit, F.lit(False)), "stratum": stratum})
    ranked = fixed(row_numbers(flags, [], best_first, "rank", "_n").select("track_id", "_floor", "_hit", "stratum", "rank"))
    inside = row_numbers(ranked.where("_floor").select("track_id", "rank", "_hit"), [], [F.col("rank").asc()], "_rk", "_m")
    first = fixed(evenly_spread(inside.withColumn("_i", F.col("_rk") - 1), "_i", "_m", F.lit(min(floor, size))).select("track_id", "_hit"))
    got = first.agg(F.count("*"), F.count_if("_hit")).first()
    wanted = min(size, int(hits_share * size + 0.5))
    second = fixed(_fill(ranked.where("_hit").join(first, "track_id", "left_anti"), max(0, min(wanted - got[1], size - got[0]))))
    chosen = first.select("track_id").unionByName(second)
    third = _fill(ranked.join(chosen, "track_id", "left_anti"), size - got[0] - second.count())
    return chosen.unionByName(third)


def nested_samples(
    tracks: DataFrame, sizes: list[tuple[int, int, float]], in_floor: Column, is_hit: Column, stratum: Column, best_first: list[Column]
) -> DataFrame:
    """(track_id, level) of samples of several sizes, each of (size, floor, hits share), the largest first. A smaller one is
    drawn from the next larger one, so that it lies in it; level k is a sample of its own together with all levels above."""
    levels, pool = [], tracks
    for k, (size, floor, share) in enumerate(sizes):
        chosen = fixed(stratified_sample(pool, size, floor, share, in_floor, is_hit, stratum, best_first))
        levels.append(chosen.withColumn("level", F.lit(k)))
        pool = pool.join(chosen, "track_id", "left_semi")
    return reduce(DataFrame.unionByName, levels).groupBy("track_id").agg(F.max("level").alias("level"))
