"""Which songs people know: hit signals, artist fame, artist rank, hit percentiles and tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.functions.text import norm_title
from cratewise.operators.aggregates import log_fame
from cratewise.operators.ranking import attach, percent_ranks_of, row_numbers
from cratewise.session import fixed


@dataclass(frozen=True)
class HitRules:
    top_songs: int = 3
    decade_share: float = 0.1
    va_weight: float = 0.5
    fallback_artists: int = 700


def hit_signals(sel: DataFrame, song_rec: DataFrame, rec_release: DataFrame, release: DataFrame, release_group: DataFrame,
                rg_secondary: DataFrame, various_credits: DataFrame) -> DataFrame:
    """(song, release_groups, comps, va_comps) over official releases.

    Group flags are settled first, so each (song, release group) pair is looked up once.
    """
    official = release.where(F.col("status").isNull() | F.col("status").isin(1, 2)).select(F.col("id").alias("release"), "release_group")
    comp = rg_secondary.where("type = 'compilation'").select("release_group", F.lit(True).alias("_comp")).distinct()
    various = various_credits.select("artist_credit", F.lit(True).alias("_va")).distinct()
    groups = (
        release_group.select(F.col("id").alias("release_group"), "artist_credit").join(various, "artist_credit", "left")
        .join(comp, "release_group", "left").select("release_group", "_comp", "_va")
    )
    held = (
        song_rec.join(sel.select("song"), "song", "left_semi").join(rec_release, "recording").join(official, "release")
        .select("song", "release_group").distinct().join(groups, "release_group", "left")
    )
    is_comp = F.coalesce("_comp", F.lit(False))
    counts = held.groupBy("song").agg(
        F.count("*").alias("release_groups"), F.count_if(is_comp).alias("comps"),
        F.count_if(is_comp & F.coalesce("_va", F.lit(False))).alias("va_comps"),
    )
    return sel.select("song").join(counts, "song", "left").na.fill(0)


def in_domestic_market(curated: Column, language: Column, country: Column) -> Column:
    """Curated artists, and songs in the market's language by domestic or unplaced artists."""
    return curated | ((language == "lang_he") & (country.eqNullSafe("IL") | country.isNull()))


def hit_base(sel: DataFrame, signals: DataFrame, curated: DataFrame) -> DataFrame:
    """``curated``: mbid, tier."""
    lists = curated.select(F.col("mbid").alias("first_artist_gid"), F.col("tier").alias("cur_tier"))
    wide = sel.join(signals, "song").join(lists, "first_artist_gid", "left")
    il = in_domestic_market(F.col("cur_tier").isNotNull(), F.col("language"), F.col("artist_country"))
    return wide.select(
        "song", "gid", "first_artist", "first_artist_gid", "decade", "listeners", "proxy_listeners", "release_groups",
        "comps", "va_comps", "cur_tier", norm_title(F.col("title")).alias("nt"), F.coalesce(il, F.lit(False)).alias("il"),
    )


def artist_fame(base: DataFrame) -> DataFrame:
    """Per artist: fame in the domestic market, whether it belongs there by majority, and its fame rank."""
    il = F.col("il")
    a = base.groupBy("first_artist").agg(
        F.max("first_artist_gid").alias("artist_gid"), F.max("cur_tier").alias("_tier"), F.count_if(il).alias("_il"),
        F.count_if(~il).alias("_intl"), F.round(log_fame(il, F.col("comps"), F.col("listeners")), 6).alias("il_fame"),
    )
    a = a.withColumn("il_artist", F.col("_tier").isNotNull() | ((F.col("_il") > 0) & (F.col("_il") >= F.col("_intl"))))
    ranked = row_numbers(
        a.where("il_artist").select("first_artist", "il_fame", "artist_gid"), [], [F.col("il_fame").desc(), F.col("artist_gid").asc()],
        "il_fame_rank", "_n",
    ).select("first_artist", "il_fame_rank")
    return a.select("first_artist", "il_fame", "il_artist").join(ranked, "first_artist", "left")


def pinned_songs(base: DataFrame, pins: DataFrame) -> DataFrame:
    """(song, pin): the best pin whose normalised title the song carries. ``pins``: mbid, k, title."""
    keyed = pins.select(F.col("mbid").alias("first_artist_gid"), norm_title(F.col("title")).alias("nt"), "k")
    return base.select("song", "first_artist_gid", "nt").join(keyed, ["first_artist_gid", "nt"]).groupBy("song").agg(F.min("k").alias("pin"))


def unmatched_pins(base: DataFrame, pins: DataFrame) -> DataFrame:
    keyed = pins.withColumn("nt", norm_title(F.col("title")))
    have = base.select(F.col("first_artist_gid").alias("mbid"), "nt").distinct()
    return keyed.join(have, ["mbid", "nt"], "left_anti").select("mbid", "k", "title")


def artist_ranks(base: DataFrame, fame: DataFrame, pins: DataFrame) -> DataFrame:
    """``base`` plus fame, pin and ``artist_rank``: pins first, then mean within-artist percentiles."""
    pr = percent_ranks_of(base, "song", ["first_artist"], ["proxy_listeners", "va_comps", "listeners", "release_groups"])
    wide = base.join(fame, "first_artist").join(pins, "song", "left").join(pr, "song")
    domestic = (F.col("pr_listeners") + F.col("pr_release_groups") + F.col("pr_va_comps")) / 3
    abroad = (F.col("pr_proxy_listeners") + F.col("pr_va_comps")) / 2
    wide = wide.withColumn("_lead", F.when(F.col("il_artist"), domestic).otherwise(abroad))
    order = [
        F.col("pin").asc_nulls_last(), F.col("_lead").desc(), F.col("proxy_listeners").desc(), F.col("listeners").desc(),
        F.col("gid").asc(),
    ]
    narrow = wide.select("song", "first_artist", "pin", "_lead", "proxy_listeners", "listeners", "gid")
    ranks = row_numbers(narrow, ["first_artist"], order, "artist_rank", "_n").select("song", "artist_rank")
    return wide.drop("_lead", *[c for c in wide.columns if c.startswith("pr_")]).join(ranks, "song")


def hit_tiers(ranked: DataFrame, rules: HitRules = HitRules(), curated_list: bool = True) -> DataFrame:
    """(song, market, artist_rank, hit_pct, popularity_pct, tier and the hit counts)."""
    domestic = 100 * F.coalesce(4 - F.col("cur_tier"), F.lit(0)) + F.col("il_fame") - 2 * F.log("artist_rank")
    abroad = F.log1p("proxy_listeners") + rules.va_weight * F.log1p("va_comps")
    keyed = ranked.withColumns({
        "market": F.when(F.col("il"), "il").otherwise("intl"), "hit_key": F.round(F.when(F.col("il"), domestic).otherwise(abroad), 6),
    })
    narrow = keyed.select("song", "gid", "decade", "market", "hit_key")
    rising = [F.col("hit_key").asc(), F.col("gid").asc()]
    share = lambda rank, n: F.when(F.col(n) > 1, (F.col(rank) - 1) / (F.col(n) - 1)).otherwise(F.lit(0.0))
    # One ranking of both kinds of group; the falling rank follows from the rising one and the ties.
    kinds = F.array(F.struct(F.lit("cell").alias("kind"), F.col("decade"), F.col("market")), F.struct(F.lit("market").alias("kind"), F.lit(None).cast("string").alias("decade"), F.col("market")))
    both = narrow.select("song", "gid", "hit_key", F.explode(kinds).alias("g")).select("song", "gid", "hit_key", "g.*")
    up = fixed(row_numbers(both, ["kind", "decade", "market"], rising, "_up", "_n").select("song", "hit_key", "kind", "decade", "market", "_up", "_n"))
    ties = up.where("kind = 'cell'").groupBy("decade", "market", "hit_key").agg(F.count("*").alias("_ties"), (F.min("_up") - 1).alias("_below"))
    cell = attach(up.where("kind = 'cell'"), ties, ["decade", "market", "hit_key"])
    cell = cell.select("song", share("_up", "_n").alias("hit_pct"), F.col("_n").alias("dec_n"), (F.col("_n") - F.col("_below") - F.col("_ties") + F.col("_up") - F.col("_below")).alias("dec_rank"))
    market = up.where("kind = 'market'").select("song", share("_up", "_n").alias("market_pct"))
    wide = keyed.join(cell, "song").join(market, "song")
    known = F.col("cur_tier").isNotNull() if curated_list else F.col("il_fame_rank") <= rules.fallback_artists
    best_of_decade = F.col("decade").isNotNull() & (F.col("dec_rank") <= F.ceil(rules.decade_share * F.col("dec_n")))
    is_hit = (F.col("artist_rank") <= rules.top_songs) & F.when(F.col("market") == "intl", best_of_decade).otherwise(known)
    wide = wide.withColumn("_hit", F.coalesce(is_hit, F.lit(False)))
    any_hit = wide.groupBy("first_artist").agg(F.bool_or("_hit").alias("_any"))
    tier = F.when(F.col("_hit"), 0).when(F.col("_any"), 1).otherwise(2)
    return attach(wide, any_hit, ["first_artist"]).select(
        "song", "proxy_listeners", "release_groups", "comps", "va_comps", "market",
        "artist_rank", F.round("hit_pct", 6).alias("hit_pct"),
        F.round("market_pct", 6).alias("popularity_pct"), tier.alias("tier"),
    )
