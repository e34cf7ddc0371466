"""Which question to ask next, for all sessions at once.

The bank (questions, effects, packs, unlock rules) is configuration of a few hundred rows; sessions are the
data. A session is scored against the whole bank through joins on dimension keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.functions.text import uniform_draw
from cratewise.plans.taste import PRIOR, top_categories
from cratewise.session import fixed

#: share of the best score within which a seeded draw may choose, per slot
VARIETY_BAND = {"hook": 0.0, "vibe": 0.6, "main": 0.1, "spicy": 0.0, "explore": 0.15, "lead": 0.0}
DUEL_WEIGHT, DUEL_MIN_SCORE, DUEL_FROM, EXPLORE_UNTIL, EXPLORE_MIN_DIFF = 3.0, 1.0, 6, 20, 0.5
UNLOCK_TOP_GENRES = 3


@dataclass(frozen=True)
class Bank:
    questions: DataFrame  # question_id, pack, pri, weight, family?
    effects: DataFrame  # question_id, side, grp, k, v
    packs: DataFrame  # pack, pack_weight
    genre_order: DataFrame  # k, ord
    unlock_answers: DataFrame | None = None  # question_id, ref_question, ref_side
    unlock_genres: DataFrame | None = None  # question_id, k: any of these in the top three
    unlock_all_genres: DataFrame | None = None  # question_id, k: all of these in the top three
    leads: DataFrame | None = None  # pack, lead_no (from 0), position

    def families(self) -> DataFrame:
        """(question_id, canonical): variants share their canonical question's id."""
        known = self.questions.select(F.col("question_id").alias("family"), F.lit(True).alias("_k"))
        rows = self.questions.select("question_id", "family").join(known, "family", "left")
        return rows.select("question_id", F.when(F.col("_k"), F.col("family")).otherwise(F.col("question_id")).alias("canonical"))

    def canonical_questions(self) -> DataFrame:
        heads = self.families().where("question_id = canonical").select("question_id")
        return self.questions.join(heads, "question_id", "left_semi").join(self.packs, "pack")

    def key_diffs(self) -> DataFrame:
        """(question_id, grp, k, d): signed difference of the sides on every key either names."""
        v = F.when(F.col("side") == "a", F.col("v")).otherwise(-F.col("v"))
        return self.effects.groupBy("question_id", "grp", "k").agg(F.sum(v).alias("d"))


#: Questions of a block, on average.
BLOCK_QUESTIONS = 1_024


def each_question(people: DataFrame, questions: DataFrame) -> DataFrame:
    """Every row of ``people`` with every question_id: the questions in blocks of bounded size, which rows meet by number."""
    blocks = -(-questions.count() // BLOCK_QUESTIONS)
    listed = questions.groupBy(F.pmod(F.xxhash64("question_id"), F.lit(max(1, blocks))).cast("int").alias("_block")).agg(F.collect_list("question_id").alias("_q"))
    asked = people.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1))))
    return asked.join(listed, "_block").select(*people.columns, F.explode("_q").alias("question_id"))


def eligible_questions(answers: DataFrame, sums: DataFrame, bank: Bank, enabled: list[str] | None = None) -> DataFrame:
    """(session_id, question_id): canonical questions whose family is unasked, pack enabled and lock open."""
    fam = bank.families()
    heads = bank.canonical_questions()
    if enabled is not None:
        heads = heads.where(F.col("pack").isin(*enabled))
    asked = answers.join(fam, "question_id").groupBy("session_id", "canonical").agg(F.max_by("choice", "seq").alias("choice"))
    locked = [t.select("question_id") for t in (bank.unlock_answers, bank.unlock_genres, bank.unlock_all_genres) if t is not None]
    free = heads.select("question_id")
    for t in locked:
        free = free.join(t, "question_id", "left_anti")
    sessions = answers.select("session_id").distinct()
    open_ = each_question(sessions, free)
    if bank.unlock_answers is not None:
        refs = bank.unlock_answers.join(fam.withColumnRenamed("question_id", "ref_question"), "ref_question")
        hit = asked.join(refs, "canonical").where((F.col("choice") == F.col("ref_side")) | (F.col("choice") == "both"))
        open_ = open_.unionByName(hit.select("session_id", "question_id"))
    if bank.unlock_genres is not None or bank.unlock_all_genres is not None:
        top = top_categories(sums, bank.genre_order, "genres", UNLOCK_TOP_GENRES).select("session_id", "k")
        if bank.unlock_genres is not None:
            open_ = open_.unionByName(top.join(bank.unlock_genres, "k").select("session_id", "question_id"))
        if bank.unlock_all_genres is not None:
            needed = bank.unlock_all_genres.groupBy("question_id").agg(F.count("*").alias("_need"))
            met = top.join(bank.unlock_all_genres, "k").groupBy("session_id", "question_id").agg(F.count("*").alias("_got"))
            open_ = open_.unionByName(met.join(needed, "question_id").where("_got = _need").select("session_id", "question_id"))
    done = asked.select("session_id", F.col("canonical").alias("question_id"))
    return open_.distinct().join(heads.select("question_id"), "question_id", "left_semi").join(done, ["session_id", "question_id"], "left_anti")


def uncertainty(sums: DataFrame) -> DataFrame:
    """(session_id, u_scalar map, per-group evidence) folded into one row per session: vocabulary-sized maps."""
    scalar = F.map_from_entries(F.collect_list(F.when(F.col("grp") == "scalar", F.struct("k", "w"))))
    e = lambda g: F.coalesce(F.sum(F.when(F.col("grp") == g, F.col("evidence"))), F.lit(0.0))
    groups = F.create_map(*[x for g in ("decades", "genres", "languages") for x in (F.lit(g), e(g))])
    return sums.groupBy("session_id").agg(scalar.alias("seen"), groups.alias("evidence"))


def gain_scores(pairs: DataFrame, sums: DataFrame, bank: Bank) -> DataFrame:
    """(session_id, question_id, raw, gain): Σ |Δ|·u·w × (0.5 + priority/100), and that per key of the card."""
    diffs = bank.key_diffs().groupBy("question_id").agg(F.collect_list(F.struct("grp", "k", F.abs("d").alias("d"))).alias("_d"))
    heads = bank.canonical_questions().select("question_id", (F.col("pack_weight") * F.col("weight")).alias("_w"), "pri").join(diffs, "question_id")
    rows = pairs.join(heads, "question_id").join(uncertainty(sums), "session_id", "left")
    seen = lambda k: F.coalesce(F.try_element_at(F.col("seen"), k), F.lit(0.0))
    known = lambda g: F.coalesce(F.try_element_at(F.col("evidence"), g), F.lit(0.0))
    u = lambda e: F.when(e["grp"] == "scalar", 1 / (PRIOR + seen(e["k"]))).otherwise(1 / (1 + known(e["grp"])))
    total = F.aggregate("_d", F.lit(0.0), lambda acc, e: acc + e["d"] * u(e) * F.col("_w"))
    raw = total * (0.5 + F.col("pri") / 100)
    return rows.select("session_id", "question_id", raw.alias("raw"), (raw / F.size("_d")).alias("gain"))


def duel_values(pairs: DataFrame, sums: DataFrame, bank: Bank) -> DataFrame:
    """(session_id, question_id, duel): the best pair of contending genres a card sets against each other.

    A card names a handful of genres, so its two sides are short arrays; no join lists the pairs.
    """
    genres = sums.where("grp = 'genres'")
    top = genres.groupBy("session_id").agg(F.max("s").alias("_top")).where("_top > 0")
    contenders = genres.where(F.col("s") >= DUEL_MIN_SCORE).join(top, "session_id").select("session_id", "k", (F.col("s") / F.col("_top")).alias("c"))
    moves = bank.key_diffs().where("grp = 'genres' and d <> 0").select("question_id", "k", "d")
    rows = contenders.join(moves, "k").join(pairs, ["session_id", "question_id"], "left_semi")
    side = lambda cond: F.collect_list(F.when(cond, F.struct("c", F.abs("d").alias("d"))))
    cards = rows.groupBy("session_id", "question_id").agg(side(F.col("d") > 0).alias("_up"), side(F.col("d") < 0).alias("_down"))
    values = F.flatten(F.transform("_up", lambda x: F.transform(F.col("_down"), lambda y: x["c"] * y["c"] * F.least(x["d"], y["d"]))))
    return cards.select("session_id", "question_id", F.coalesce(F.array_max(values), F.lit(0.0)).alias("duel"))


def slot_of(position: Column, spicy: bool = True, explore: bool = True) -> Column:
    chain = F.when(position <= 3, "hook").when(position % 4 == 0, "vibe")
    if spicy:
        chain = chain.when(position % 10 == 7, "spicy")
    if explore:
        chain = chain.when((position % 4 == 1) & (position <= EXPLORE_UNTIL), "explore")
    return chain.otherwise("main")


def _in_slot(pack: Column, slot: Column) -> Column:
    fixed_ = F.when(slot == "hook", pack == "core").when(slot == "vibe", pack == "vibe").when(slot == "spicy", pack == "spicy")
    return fixed_.otherwise(~pack.isin("vibe", "spicy"))


def opening_questions(answers: DataFrame, pairs: DataFrame, bank: Bank) -> DataFrame:
    """(session_id, question_id) that set an untouched genre or decade against something else."""
    keys = bank.effects.where(F.col("grp").isin("genres", "decades")).select("question_id", "k").distinct()
    touched = answers.select("session_id", "question_id").distinct().join(keys, "question_id").select("session_id", "k").distinct()
    strong = bank.key_diffs().where(F.col("grp").isin("genres", "decades") & (F.abs("d") >= EXPLORE_MIN_DIFF)).select("question_id", "k")
    offered = pairs.select("session_id", "question_id").join(strong, "question_id")
    return offered.join(touched, ["session_id", "k"], "left_anti").select("session_id", "question_id").distinct()


def question_scores(answers: DataFrame, sums: DataFrame, bank: Bank, enabled: list[str] | None = None) -> DataFrame:
    """(session_id, question_id, slot, score): the pool of each session's slot, scored for it."""
    pairs = fixed(eligible_questions(answers, sums, bank, enabled))  # read by every step below
    heads = bank.canonical_questions().select("question_id", "pack", "pri")
    place = answers.groupBy("session_id").agg((F.count("*") + 1).alias("position"))
    spicy = enabled is None or "spicy" in enabled
    rows = pairs.join(heads, "question_id").join(place, "session_id").withColumn("slot", slot_of(F.col("position"), spicy))
    lead = F.lit(False)
    if bank.leads is not None:
        per_pack = answers.join(bank.questions.select("question_id", "pack"), "question_id").groupBy("session_id", "pack").agg(F.count("*").alias("_asked"))
        rows = rows.join(bank.leads, ["pack", "position"], "left").join(per_pack, ["session_id", "pack"], "left")
        lead = F.col("lead_no").isNotNull() & (F.coalesce("_asked", F.lit(0)) <= F.col("lead_no"))
    opens = opening_questions(answers, pairs, bank).withColumn("_opens", F.lit(True))
    rows = rows.withColumn("_lead", lead).join(opens, ["session_id", "question_id"], "left")
    # What each session has decides its slot; one small aggregate per session instead of a window.
    have = rows.groupBy("session_id").agg(
        F.bool_or("_lead").alias("any_lead"), F.bool_or(_in_slot(F.col("pack"), F.col("slot"))).alias("any_in"),
        F.bool_or(F.coalesce("_opens", F.lit(False)) & _in_slot(F.col("pack"), F.col("slot"))).alias("any_open"),
    )
    rows = rows.join(have, "session_id")
    slot = F.when(F.col("any_lead"), "lead").when((F.col("slot") == "explore") & ~F.col("any_open"), "main").otherwise(F.col("slot"))
    inside = F.when(F.col("any_lead"), F.col("_lead")).otherwise(~F.col("any_in") | _in_slot(F.col("pack"), F.col("slot")))
    rows = rows.where(inside).withColumn("slot", slot).where((F.col("slot") != "explore") | F.coalesce("_opens", F.lit(False)))
    rows = fixed(rows.select("session_id", "question_id", "slot", "position", "pri"))
    gain = gain_scores(rows.select("session_id", "question_id"), sums, bank)
    duel = duel_values(rows.select("session_id", "question_id"), sums, bank)
    scored = rows.join(gain, ["session_id", "question_id"]).join(duel, ["session_id", "question_id"], "left")
    bonus = F.when(F.col("position") >= DUEL_FROM, 1 + DUEL_WEIGHT * F.coalesce("duel", F.lit(0.0))).otherwise(F.lit(1.0))
    score = (
        F.when(F.col("slot").isin("explore", "lead"), F.col("pri").cast("double")).when(F.col("slot") == "hook", F.col("raw"))
        .otherwise(F.col("gain") * bonus)
    )
    return scored.select("session_id", "question_id", "slot", score.alias("score"))


def next_question(scores: DataFrame) -> DataFrame:
    """Best question per session, ties by id."""
    order = F.struct((-F.round("score", 9)).alias("s"), F.col("question_id").alias("q"))
    return scores.groupBy("session_id").agg(F.min_by("question_id", order).alias("question_id"), F.min_by("slot", order).alias("slot"))


def draw_question(scores: DataFrame, seeds: DataFrame, fam: DataFrame, avoid: DataFrame) -> DataFrame:
    """A seeded draw, weighted by score, within the slot's band of the best; then an allowed variant.

    ``seeds``: session_id, seed.
    """
    scores = fixed(scores)
    best = scores.groupBy("session_id").agg(F.max("score").alias("_best"))
    band = F.create_map(*[x for s, b in VARIETY_BAND.items() for x in (F.lit(s), F.lit(b))])
    near = scores.join(best, "session_id").where(F.col("score") >= F.col("_best") * (1 - band[F.col("slot")])).join(seeds, "session_id")
    # Largest ln(u)/w is a draw with probability proportional to w.
    key = F.log(uniform_draw(F.col("seed"), F.col("question_id"))) / F.greatest(F.lit(1e-9), F.col("score"))
    drawn = near.groupBy("session_id").agg(F.max_by("question_id", F.struct(key, F.col("question_id"))).alias("canonical"))
    options = allowed_variants(drawn, fam, avoid).join(seeds, "session_id")
    pick = uniform_draw(F.col("seed"), F.lit("variant"), F.col("question_id"))
    return options.groupBy("session_id").agg(F.max_by("question_id", F.struct(pick, F.col("question_id"))).alias("question_id"))


def allowed_variants(drawn: DataFrame, fam: DataFrame, avoid: DataFrame) -> DataFrame:
    """(session_id, question_id) of the drawn family that the session should not avoid; all when none is left."""
    options = drawn.join(fam, "canonical").join(
        avoid.select("session_id", "question_id", F.lit(True).alias("_avoid")).distinct(), ["session_id", "question_id"], "left"
    ).withColumn("_fresh", F.col("_avoid").isNull())
    any_fresh = options.groupBy("session_id").agg(F.bool_or("_fresh").alias("_any"))
    return options.join(any_fresh, "session_id").where(F.col("_fresh") | ~F.col("_any")).select("session_id", "question_id")


def persona_choices(
    effects: DataFrame, categories: DataFrame, ranges: DataFrame, tie: float = 0.05, skip_below: float = -0.25, non_target: float = 0.5
) -> DataFrame:
    """(persona, question_id, u_a, u_b, choice): what a persona answers.

    ``categories``: persona, grp, k, w. ``ranges``: persona, k, lo, hi. Both are joined on what they share
    with a card (group or axis), so cards a persona does not care about cost nothing until the last step.
    """
    mid = (F.col("lo") + F.col("hi")) / 2
    axis = effects.where("grp = 'scalar'").join(ranges, "k").select(
        "persona", "question_id", "side", (F.abs(mid) - F.abs(F.col("v") - mid)).alias("u")
    )
    aimed = categories.select("persona", "grp").distinct()
    named = effects.where("grp <> 'scalar'").join(aimed, "grp").join(categories, ["persona", "grp", "k"], "left")
    group = named.select("persona", "question_id", "side", F.when(F.col("w").isNotNull(), F.col("v") * F.col("w")).otherwise(-non_target * F.col("v")).alias("u"))
    people = categories.select("persona").union(ranges.select("persona")).distinct()
    grid = each_question(people, effects.select("question_id").distinct())
    total = axis.unionByName(group).groupBy("persona", "question_id").agg(
        F.sum(F.when(F.col("side") == "a", F.col("u"))).alias("a"), F.sum(F.when(F.col("side") == "b", F.col("u"))).alias("b")
    )
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    choice = (
        F.when(F.greatest(a, b) < skip_below, "skip")
        .when(F.abs(a - b) < tie, F.when(F.greatest(a, b) > 0, "both").otherwise("skip"))
        .when(a > b, "a").otherwise("b")
    )
    return grid.join(total, ["persona", "question_id"], "left").select("persona", "question_id", a.alias("u_a"), b.alias("u_b"), choice.alias("choice"))
