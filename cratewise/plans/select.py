"""Candidates, final popularity and the top-N selection with coverage quotas."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.operators.ranking import row_numbers
from cratewise.session import fixed


@dataclass(frozen=True)
class Pool:
    """A part of the catalog with a guaranteed minimum of songs."""

    name: str
    countries: tuple[str, ...]
    languages: tuple[str, ...]
    min: int
    script: str | None = None


def in_pool(pool: Pool, country: Column, language: Column) -> Column:
    parts = [column.isin(*keys) for column, keys in ((country, pool.countries), (language, pool.languages)) if keys]
    return reduce(or_, parts) if parts else F.lit(False)


def _flag(pool: Pool) -> Column:
    return F.coalesce(in_pool(pool, F.col("artist_country"), F.col("language_iso")), F.lit(False))


def candidates(songs: DataFrame, limit: int, pools: list[Pool]) -> DataFrame:
    """The first ``limit`` songs by the listening proxy, plus every pool song."""
    order = [F.col("proxy_listeners").desc(), F.col("proxy_listens").desc(), F.col("gid").asc()]
    ranks = row_numbers(songs.select("song", "gid", "proxy_listeners", "proxy_listens"), [], order, "proxy_rank", "_n")
    ranked = songs.join(ranks.select("song", "proxy_rank"), "song")
    keep = reduce(or_, [_flag(p) for p in pools], F.col("proxy_rank") <= limit)
    return ranked.where(keep)


def ids_to_ask(kept: DataFrame, heard: DataFrame, members: DataFrame) -> DataFrame:
    """(song, gid) whose popularity is wanted: heard ids, the song's own, and all members of unheard songs.

    ``kept``: song, gid, proxy_listeners. ``heard``: song, gid. ``members``: song, gid.
    """
    silent = kept.where("proxy_listeners = 0").select("song")
    parts = [
        heard.join(kept.select("song"), "song", "left_semi"),
        kept.select("song", "gid"),
        members.join(silent, "song", "left_semi"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def final_popularity(kept: DataFrame, asked: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Listeners = most users of any id (unique users do not add up), listens = sum; else the proxy."""
    known = asked.join(snapshot, "gid").groupBy("song").agg(F.max("users").alias("_u"), F.sum("listens").alias("_l"))
    return kept.join(known, "song", "left").select(
        "song", F.coalesce("_u", "proxy_listeners").alias("listeners"),
        F.coalesce("_l", "proxy_listens").alias("listens"), F.col("_u").isNotNull().alias("from_api"),
    )


def select_with_quotas(cand: DataFrame, pop: DataFrame, target: int, pools: list[Pool]) -> tuple[DataFrame, DataFrame]:
    """(selected songs with ``rk`` and ``via``, ranking): top ``target``, each pool topped up to its minimum.

    A pool takes its next best songs with a known listener, and as many of the lowest songs outside all
    pools leave. Pools go one after another, because one pool's additions may belong to the next. Ranks
    make each step a rank threshold, so only counts and cut-offs reach the driver.
    """
    order = [F.col("listeners").desc(), F.col("listens").desc(), F.col("gid").asc()]
    flags = [_flag(p).alias(f"in_{i}") for i, p in enumerate(pools)]
    base = cand.select("song", "gid", *flags).join(pop.select("song", "listeners", "listens"), "song")
    ranked = row_numbers(base, [], order, "rk", "_n").drop("_n")
    ranked = fixed(ranked.withColumn("in_any", reduce(or_, [F.col(f"in_{i}") for i in range(len(pools))], F.lit(False))))
    state = ranked.withColumn("via", F.when(F.col("rk") <= target, F.lit("rank")))
    for i, pool in enumerate(pools):
        member, chosen = F.col(f"in_{i}"), F.col("via").isNotNull()
        have = state.where(member & chosen).count()
        need = max(0, pool.min - have)
        if need == 0:
            continue
        waiting = state.where(member & ~chosen & (F.col("listeners") > 0))
        last_in = waiting.select("rk").orderBy("rk").limit(need).agg(F.max("rk"), F.count("*")).first()
        added = last_in[1]
        if added == 0:
            continue
        joins = member & ~chosen & (F.col("listeners") > 0) & (F.col("rk") <= last_in[0])
        outside = state.where(chosen & ~F.col("in_any"))
        first_out = outside.select("rk").orderBy(F.col("rk").desc()).limit(added).agg(F.min("rk")).first()[0]
        leaves = chosen & ~F.col("in_any") & (F.col("rk") >= F.lit(first_out if first_out is not None else 1 << 62))
        via = F.when(leaves, F.lit(None)).when(joins, F.lit(f"quota:{pool.name}")).otherwise(F.col("via"))
        state = state.withColumn("via", via)
    picked = state.where("via is not null").select("song", "rk", "via", "listeners", "listens")
    return picked, ranked
