"""Answer logs → taste profiles → quantised taste vectors, for all sessions at once.

Profiles and tastes are long tables: (session, grp, k, …) with one row per dimension. ``Dims`` is the
vocabulary; every per-session group below holds at most one row per vocabulary key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cratewise.functions.features import CLUSTER_LABELS, LANGUAGE_LABELS, SCALAR_LABELS, decade_label, decade_start, label_of
from cratewise.operators.apportion import largest_remainder

TARGET_SCALE = WEIGHT_SCALE = 100
P_SCALE = 1000
PRIOR = 1.0
GROUPS = ("decades", "genres", "languages")

# --- fixed values: steps of the tweaks, names of the types ------------------------------------------
TWEAK_SHIFTS = {
    "energy": {"energy": 0.5, "tempo": 0.2, "dance": 0.15},
    "mood": {"valence": 0.5},
    "popularity": {"mainstream": 0.5},
}
TWEAK_FOCUS, ERA_SHIFT, ERA_RAMP, MAX_STEPS = 0.6, 0.4, 0.35, 2
SCALAR_LIMIT, BOOST_LIMIT, ADJUSTED_WEIGHT, BOOST_GAIN, BOOST_FLOOR = 30, 50, 40, 3, 20
ARCHETYPES = {
    "hi.bright.retro.organic": "Sunburst Revivalist", "hi.bright.retro.electric": "Neon Nostalgist",
    "hi.bright.modern.organic": "Festival Wanderer", "hi.bright.modern.electric": "Dancefloor Futurist",
    "hi.dark.retro.organic": "Thunder Purist", "hi.dark.retro.electric": "Midnight Synth Rider",
    "hi.dark.modern.organic": "Riff Rebel", "hi.dark.modern.electric": "Bass-Drop Outlaw",
    "lo.bright.retro.organic": "Porch Poet", "lo.bright.retro.electric": "Lounge Lizard",
    "lo.bright.modern.organic": "Coffeehouse Romantic", "lo.bright.modern.electric": "Lo-fi Sunbather",
    "lo.dark.retro.organic": "Rainy-Day Balladeer", "lo.dark.retro.electric": "Smoky Noir Detective",
    "lo.dark.modern.organic": "Candlelit Confessor", "lo.dark.modern.electric": "Night-Drive Ghost",
}
HINT_SCALARS = ("energy", "valence", "dance", "acoustic", "tempo", "mainstream")
# ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Dims:
    scalar: tuple[str, ...]
    decades: tuple[str, ...]
    genres: tuple[str, ...]
    languages: tuple[str, ...]

    def rows(self, *groups: str) -> list[tuple[str, str, int]]:
        return [(g, k, i) for g in groups for i, k in enumerate(getattr(self, g))]


@dataclass(frozen=True)
class TasteParams:
    ramp: float = 5.0
    tau: tuple = (("decades", 0.3), ("genres", 0.25), ("languages", 1.0))
    relative_tau: tuple = (("genres", 0.15), ("decades", 0.1))
    smooth: tuple = (("decades", 0.3),)
    from_evidence: bool = True
    lean_weight: float = 0.6
    lean_target: float = 0.6
    lean_dim: str = "mainstream"


def _round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def on_grid(sessions: DataFrame, key: str, rows: list[tuple[str, str, int]]) -> DataFrame:
    """One row per session and vocabulary key, by exploding a literal list."""
    entries = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(k).alias("k"), F.lit(i).alias("ord")) for g, k, i in rows])
    return sessions.select(key, F.inline(entries))


def choice_effects(effects: DataFrame, questions: DataFrame, packs: DataFrame) -> DataFrame:
    """(question_id, choice, grp, k, v, w): what each possible answer does. Size of the question bank.

    "both" applies the average of the two sides over all their keys, at half weight.
    """
    sides = effects.select("question_id", F.col("side").alias("choice"), "grp", "k", "v", F.lit(1.0).alias("_m"))
    both = effects.groupBy("question_id", "grp", "k").agg((F.sum("v") / 2).alias("v")).select(
        "question_id", F.lit("both").alias("choice"), "grp", "k", "v", F.lit(0.5).alias("_m")
    )
    weights = questions.join(packs, "pack").select("question_id", (F.col("pack_weight") * F.col("weight")).alias("_w"))
    return sides.unionByName(both).join(weights, "question_id").withColumn("w", F.col("_w") * F.col("_m")).drop("_w", "_m")


def answer_effects(answers: DataFrame, choices: DataFrame) -> DataFrame:
    """(session_id, grp, k, wv, w) for every effect of every answer; skips have none."""
    hit = answers.select("session_id", "question_id", "choice").join(choices, ["question_id", "choice"])
    return hit.select("session_id", "grp", "k", (F.col("w") * F.col("v")).alias("wv"), "w")


def profile_sums(effects: DataFrame) -> DataFrame:
    """(session_id, grp, k, s, w, evidence): the whole fold, in any order."""
    return effects.groupBy("session_id", "grp", "k").agg(
        F.sum("wv").alias("s"), F.sum("w").alias("w"), F.sum(F.abs("wv")).alias("evidence")
    )


def scalar_profile(sums: DataFrame, prior: float = PRIOR) -> DataFrame:
    """Position μ = Σwv / (prior + Σw) and confidence C = prior + Σw per touched scalar."""
    confidence = F.col("w") + prior
    return sums.where("grp = 'scalar'").select("session_id", "k", (F.col("s") / confidence).alias("mu"), confidence.alias("c"))


def group_evidence(sums: DataFrame) -> DataFrame:
    return sums.where("grp <> 'scalar'").groupBy("session_id", "grp").agg(F.sum("evidence").alias("evidence"))


def top_categories(sums: DataFrame, vocabulary: DataFrame, grp: str, n: int) -> DataFrame:
    """(session_id, k, rk): positive scores, best first, ties in declaration order."""
    rows = sums.where((F.col("grp") == grp) & (F.col("s") > 0)).join(vocabulary.select("k", "ord"), "k")
    best = Window.partitionBy("session_id").orderBy(F.col("s").desc(), "ord")
    return rows.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= n).select("session_id", "k", "rk")


def group_distribution(sums: DataFrame, dims: Dims, params: TasteParams = TasteParams()) -> DataFrame:
    """(session_id, grp, k, ord, p): softmax of smoothed scores; groups without evidence are absent."""
    shown = group_evidence(sums).where("evidence > 0").select("session_id", "grp")
    keys = F.array(*[
        F.struct(F.lit(g).alias("_g"), F.lit(k).alias("k"), F.lit(i).alias("ord")) for g, k, i in dims.rows(*GROUPS)
    ])
    grid = shown.select("session_id", "grp", F.inline(keys)).where("grp = _g").drop("_g")
    rows = grid.join(sums.select("session_id", "grp", "k", "s"), ["session_id", "grp", "k"], "left").na.fill(0.0, ["s"])
    group = Window.partitionBy("session_id", "grp")
    line = group.orderBy("ord")
    pick = lambda pairs, default: F.coalesce(*[F.when(F.col("grp") == g, F.lit(v)) for g, v in pairs], F.lit(default))
    around = F.coalesce(F.lag("s").over(line), F.lit(0.0)) + F.coalesce(F.lead("s").over(line), F.lit(0.0))
    rows = rows.withColumn("s", F.col("s") + pick(params.smooth, 0.0) * around)
    top = F.greatest(F.lit(0.0), F.max("s").over(group))
    rows = rows.withColumn("_t", F.greatest(pick(params.tau, 1.0), pick(params.relative_tau, 0.0) * top))
    rows = rows.withColumn("_e", F.exp((F.col("s") - F.max("s").over(group)) / F.col("_t")))
    return rows.select("session_id", "grp", "k", "ord", (F.col("_e") / F.sum("_e").over(group)).alias("p"))


def taste_scalars(sessions: DataFrame, sums: DataFrame, dims: Dims, params: TasteParams = TasteParams()) -> DataFrame:
    """(request, k, ord, target, weight): quantised positions and confidences of every scalar."""
    grid = on_grid(sessions.select("session_id").distinct(), "session_id", dims.rows("scalar"))
    rows = grid.join(sums.select("session_id", "grp", "k", "s", "w"), ["session_id", "grp", "k"], "left").na.fill(0.0, ["s", "w"])
    leaning = F.when(F.col("k") == params.lean_dim, F.lit(params.lean_weight)).otherwise(F.lit(0.0))
    evidence = F.col("w") + leaning
    total = F.col("s") + leaning * params.lean_target
    if params.from_evidence:
        t = F.when(evidence > 0, total / evidence).otherwise(F.lit(0.0))
    else:
        t = total / (PRIOR + evidence)
    return rows.select(
        F.col("session_id").alias("request"), "k", "ord", _round(_clip(t, -1, 1) * TARGET_SCALE).alias("target"),
        _round(_clip(evidence / params.ramp, 0, 1) * WEIGHT_SCALE).alias("weight"),
    )


def taste_groups(sums: DataFrame, dims: Dims, params: TasteParams = TasteParams()) -> DataFrame:
    """(request, grp, k, ord, p) with p in thousandths."""
    p = group_distribution(sums, dims, params)
    return p.select(F.col("session_id").alias("request"), "grp", "k", "ord", _round(F.col("p") * P_SCALE).alias("p"))


def taste_vectors(scalars: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per request with arrays in dimension order; a group without evidence is null."""
    ordered = lambda *cols: F.array_sort(F.collect_list(F.struct("ord", *cols)))
    s = scalars.groupBy("request").agg(ordered("target", "weight").alias("_s")).select(
        "request", F.transform("_s", lambda e: e["target"]).alias("target"), F.transform("_s", lambda e: e["weight"]).alias("weight")
    )
    g = groups.groupBy("request", "grp").agg(ordered("p").alias("_p")).groupBy("request").pivot("grp", list(GROUPS)).agg(F.first("_p"))
    lists = [F.transform(x, lambda e: e["p"]).alias(x) for x in GROUPS]
    return s.join(g.select("request", *lists), "request", "left")


def answer_violations(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(session_id, rule, question_id, n): unknown questions, unknown choices, questions answered twice."""
    known = questions.select("question_id", F.lit(True).alias("_known"))
    rows = answers.join(known, "question_id", "left")
    rule = (
        F.when(F.col("_known").isNull(), F.lit("unknown question"))
        .when(~F.col("choice").isin("a", "b", "both", "skip"), F.lit("unknown choice"))
    )
    bad = rows.withColumn("rule", rule).where("rule is not null").groupBy("session_id", "rule", "question_id").agg(F.count("*").alias("n"))
    twice = answers.groupBy("session_id", "question_id").agg(F.count("*").alias("n")).where("n > 1")
    return bad.unionByName(twice.select("session_id", F.lit("answered twice").alias("rule"), "question_id", "n"))


def taste_violations(scalars: DataFrame, groups: DataFrame, dims: Dims) -> DataFrame:
    """(request, rule): wrong lengths, values out of range, all-zero groups."""
    s = scalars.groupBy("request").agg(
        F.count("*").alias("n"), F.bool_or(~F.col("target").between(-TARGET_SCALE, TARGET_SCALE)).alias("target"),
        F.bool_or(~F.col("weight").between(0, WEIGHT_SCALE)).alias("weight"),
    )
    sizes = F.create_map(*[x for g in GROUPS for x in (F.lit(g), F.lit(len(getattr(dims, g))))])
    g = groups.groupBy("request", "grp").agg(
        F.count("*").alias("n"), F.bool_or(~F.col("p").between(0, P_SCALE)).alias("range"), F.max("p").alias("top")
    )
    listed = lambda df, checks: df.select("request", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("rule"))
    first = listed(s, [
        F.when(F.col("n") != len(dims.scalar), F.lit("scalar length")), F.when(F.col("target"), F.lit("target range")),
        F.when(F.col("weight"), F.lit("weight range")),
    ])
    name = lambda what: F.concat(F.col("grp"), F.lit(f" {what}"))
    second = listed(g, [
        F.when(F.col("n") != sizes[F.col("grp")], name("length")), F.when(F.col("range"), name("range")),
        F.when(F.col("top") == 0, name("all zero")),
    ])
    return first.unionByName(second)


# --- tweaks and adjustments -------------------------------------------------------------------------
def tweak_scalars(scalars: DataFrame, steps: DataFrame) -> DataFrame:
    """Scalars after the tweaks of each request. ``steps``: request, energy, mood, popularity, era."""
    rows = scalars.join(steps, "request", "left").na.fill(0, list(TWEAK_SHIFTS))
    weight, target = F.col("weight"), F.col("target")
    for axis, shifts in TWEAK_SHIFTS.items():  # focus: other dimensions lose confidence
        n, outside = F.col(axis), ~F.col("k").isin(*shifts)
        weight = F.when((n != 0) & outside, _round(weight * F.pow(F.lit(TWEAK_FOCUS), F.abs(n)))).otherwise(weight)
    for axis, shifts in TWEAK_SHIFTS.items():
        n = F.col(axis)
        for place, (dim, delta) in enumerate(shifts.items()):
            here = (n != 0) & (F.col("k") == dim)
            moved = _round(_clip(target + n * delta * TARGET_SCALE, -TARGET_SCALE, TARGET_SCALE))
            target = F.when(here, moved).otherwise(target)
            if place == 0:
                weight = F.when(here, F.lit(WEIGHT_SCALE)).otherwise(weight)
    return rows.select("request", "k", "ord", target.alias("target"), weight.alias("weight"))


def tweak_decades(groups: DataFrame, steps: DataFrame, dims: Dims) -> DataFrame:
    """Decade shares after the era tweak: mass moves by decades, or leans to one end without evidence."""
    n = len(dims.decades)
    have = groups.where("grp = 'decades'").groupBy("request").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "p"))), lambda e: e["p"].cast("double")).alias("_p")
    )
    rows = steps.select("request", "era").join(have, "request", "full_outer").na.fill(0, ["era"])
    side = F.when(F.col("era") > 0, 1).otherwise(-1)

    def moved(p: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            source = i - side
            arriving = F.when(source.between(0, n - 1), F.coalesce(F.get(p, source), F.lit(0.0))).otherwise(F.lit(0.0))
            stuck = F.when((i + side).between(0, n - 1), F.lit(0.0)).otherwise(x)
            return x * (1 - ERA_SHIFT) + (arriving + stuck) * ERA_SHIFT
        return F.transform(p, one)

    rows = rows.withColumn("_one", moved(F.col("_p"))).withColumn("_two", moved(F.col("_one")))
    ramp = F.array(*[F.exp(F.col("era") * ERA_RAMP * (i - (n - 1) / 2)) for i in range(n)])
    shifted = F.when(F.col("_p").isNull(), ramp).when(F.abs("era") == 1, F.col("_one")).otherwise(F.col("_two"))
    keys = F.array(*[F.lit(k) for k in dims.decades])
    long = rows.where("era <> 0").select("request", F.posexplode(shifted).alias("ord", "_w"))
    slots = largest_remainder(long, ["request"], "_w", F.lit(P_SCALE), [F.col("ord").asc()], "p")
    changed = slots.select("request", F.lit("decades").alias("grp"), F.get(keys, F.col("ord")).alias("k"), "ord", "p")
    era = steps.where("era <> 0").select("request", F.lit("decades").alias("grp"))
    return groups.join(era, ["request", "grp"], "left_anti").unionByName(changed)


def clamp_adjustments(raw: DataFrame, dims: Dims) -> DataFrame:
    """(request, grp, k, v): unknown keys dropped, values limited and rounded, zeros dropped. Languages never."""
    known = F.lit(False)
    for g in ("scalar", "genres", "decades"):
        known = known | ((F.col("grp") == g) & F.col("k").isin(*getattr(dims, g)))
    limit = F.when(F.col("grp") == "scalar", SCALAR_LIMIT).otherwise(BOOST_LIMIT)
    v = _round(F.greatest(-limit, F.least(limit, F.col("v"))))
    return raw.where(known).select("request", "grp", "k", v.alias("v")).where("v <> 0")


def adjust_scalars(scalars: DataFrame, adjustments: DataFrame) -> DataFrame:
    d = adjustments.where("grp = 'scalar'").select("request", "k", "v")
    rows = scalars.join(d, ["request", "k"], "left")
    moved = _clip(F.col("target") + F.col("v"), -TARGET_SCALE, TARGET_SCALE).cast("int")
    hit = F.col("v").isNotNull()
    return rows.select(
        "request", "k", "ord", F.when(hit, moved).otherwise(F.col("target")).alias("target"),
        F.when(hit, F.greatest("weight", F.lit(ADJUSTED_WEIGHT))).otherwise(F.col("weight")).alias("weight"),
    )


def adjust_groups(groups: DataFrame, adjustments: DataFrame, dims: Dims) -> DataFrame:
    """Boosted shares: × (1 + 3b) from at least 2 % of the mass, ÷ (1 − 3b) for negatives, requantised."""
    boost = adjustments.where("grp <> 'scalar'")
    touched = boost.select("request", "grp").distinct()
    keys = F.array(*[F.struct(F.lit(g).alias("_g"), F.lit(k).alias("k"), F.lit(i).alias("ord")) for g, k, i in dims.rows("genres", "decades")])
    grid = touched.select("request", "grp", F.inline(keys)).where("grp = _g").drop("_g")
    have = groups.select("request", "grp", "k", F.col("p").cast("double").alias("p"))
    rows = grid.join(have, ["request", "grp", "k"], "left").join(boost, ["request", "grp", "k"], "left")
    group = Window.partitionBy("request", "grp")
    x = F.coalesce("p", F.lit(1.0))  # a group without evidence starts even
    rows = rows.withColumn("x", x).withColumn("_floor", F.sum("x").over(group) * (BOOST_FLOOR / P_SCALE))
    b = F.coalesce("v", F.lit(0)) / 100
    nxt = (
        F.when(b > 0, F.greatest("x", "_floor") * (1 + BOOST_GAIN * b)).when(b < 0, F.col("x") / (1 - BOOST_GAIN * b)).otherwise(F.col("x"))
    )
    slots = largest_remainder(rows.withColumn("_w", nxt), ["request", "grp"], "_w", F.lit(P_SCALE), [F.col("ord").asc()], "p2")
    changed = slots.select("request", "grp", "k", "ord", F.col("p2").alias("p"))
    return groups.join(touched, ["request", "grp"], "left_anti").unionByName(changed)


# --- words about a taste ----------------------------------------------------------------------------
def archetypes(scalars: DataFrame, groups: DataFrame) -> DataFrame:
    """(request, archetype, genre, decade): one of sixteen types, and the top genre and decade."""
    at = lambda d: F.coalesce(F.max(F.when(F.col("k") == d, F.col("target"))), F.lit(0))
    s = scalars.groupBy("request").agg(at("energy").alias("e"), at("valence").alias("v"), at("acoustic").alias("a"))
    top = F.min_by("k", F.struct(-F.col("p"), F.col("ord")))
    is_ = lambda g: F.col("grp") == g
    modern = F.sum(F.when(is_("decades") & (decade_start(F.col("k")) >= 2000), F.col("p")))
    g = groups.groupBy("request").agg(
        (F.coalesce(modern, F.lit(0)) / F.nullif(F.sum(F.when(is_("decades"), F.col("p"))), F.lit(0).cast("long"))).alias("m"),
    )
    best = groups.groupBy("request", "grp").agg(top.alias("k")).groupBy("request").pivot("grp", ["genres", "decades"]).agg(F.first("k"))
    key = F.concat_ws(
        ".", F.when(F.col("e") >= 15, "hi").otherwise("lo"), F.when(F.col("v") >= 0, "bright").otherwise("dark"),
        F.when(F.col("m") < 0.35, "retro").otherwise("modern"), F.when(F.col("a") >= 0, "organic").otherwise("electric"),
    )
    names = F.create_map(*[F.lit(x) for pair in ARCHETYPES.items() for x in pair])
    wide = s.join(g, "request", "left").join(best, "request", "left")
    return wide.select("request", names[key].alias("archetype"), F.col("genres").alias("genre"), F.col("decades").alias("decade"))


def playlist_titles(types: DataFrame, answered: DataFrame, seed: DataFrame) -> DataFrame:
    """(request, title, description). ``answered``: request, n. ``seed``: request, seed."""
    tail = F.concat_ws(" ", label_of(F.col("genre"), CLUSTER_LABELS), decade_label(F.col("decade")))
    title = F.when(tail == "", F.col("archetype")).otherwise(F.concat_ws(" · ", "archetype", tail))
    words = F.concat(F.col("n").cast("string"), F.lit(" answers · seed "), F.substring("seed", 1, 4), F.lit("…"))
    return types.join(answered, "request").join(seed, "request").select("request", title.alias("title"), words.alias("description"))


def hints(scalars: DataFrame, groups: DataFrame, dims: Dims) -> DataFrame:
    """(request, hints): what the taste leans to, as words "kind:keys" in order genre, era, language, scalars."""
    lists = taste_vectors(scalars, groups)
    share = lambda g: F.transform(F.col(g), lambda p: p / P_SCALE)
    keyed = lambda g: F.array(*[F.lit(k) for k in getattr(dims, g)])
    ranked = F.array_sort(F.transform(share("genres"), lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    first, second = ranked[0], F.get(ranked, F.lit(1))
    name = lambda g, i: F.get(keyed(g), i)
    two = F.concat(F.lit("genre:"), name("genres", first["i"]), F.lit("+"), name("genres", second["i"]))
    genre = F.when(F.col("genres").isNotNull() & (-first["p"] >= 0.35), F.when(-second["p"] >= 0.25, two).otherwise(
        F.concat(F.lit("genre:"), name("genres", first["i"]))))

    n = len(dims.decades)
    single, pair = max(0.35, 2.8 / n), max(0.45, 3.6 / n)
    d = share("decades")
    at = lambda i: F.when(i >= 0, F.coalesce(F.get(d, i), F.lit(0.0))).otherwise(F.lit(0.0))
    top = (F.array_position(d, F.array_max(d)) - 1).cast("int")
    before = at(top - 1) > at(top + 1)
    near = F.when(before, top - 1).otherwise(top + 1)
    both = lambda i: F.concat(F.lit("era:"), name("decades", i), F.lit("+"), name("decades", i + 1))
    locked = F.when(at(near) >= 0.15, both(F.least(near, top))).otherwise(F.concat(F.lit("era:"), name("decades", top)))
    sums = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: (F.get("decades", i) + F.get("decades", i + 1)) / P_SCALE)
    best = (F.array_position(sums, F.array_max(sums)) - 1).cast("int")
    era = F.when(F.col("decades").isNotNull(), F.when(at(top) >= single, locked).when(F.array_max(sums) >= pair, both(best)))

    language = F.coalesce(F.filter(
        F.transform(share("languages"), lambda p, i: F.when((p >= 0.5) & (name("languages", i) != "lang_en"), F.concat(F.lit("language:"), name("languages", i)))),
        lambda x: x.isNotNull(),
    ), F.array().cast("array<string>"))
    leans = []
    for k in HINT_SCALARS:
        if k in dims.scalar:
            i = dims.scalar.index(k)
            t, w = F.col("target")[i] / TARGET_SCALE, F.col("weight")[i] / WEIGHT_SCALE
            leans.append(F.when((w >= 0.6) & (F.abs(t) >= 0.4), F.concat(F.lit(f"scalar:{k}:"), F.when(t > 0, "high").otherwise("low"))))
    words = F.concat(F.array(genre, era), language, F.array(*leans))
    return lists.select("request", F.filter(words, lambda x: x.isNotNull()).alias("hints"))


def summary_lines(scalars: DataFrame, groups: DataFrame) -> DataFrame:
    """(request, line, text): mixes of at least 5 % best first, and each scalar's side and sureness."""
    p = F.col("p") / P_SCALE
    label = (
        F.when(F.col("grp") == "genres", label_of(F.col("k"), CLUSTER_LABELS)).when(F.col("grp") == "decades", decade_label(F.col("k")))
        .otherwise(label_of(F.col("k"), LANGUAGE_LABELS))
    )
    part = F.concat(label, F.lit(" ["), F.col("k"), F.lit("] "), F.floor(p * 100 + 0.5).cast("string"), F.lit("%"))
    shown = groups.where(p >= 0.05).select("request", "grp", F.struct((-F.col("p")).alias("p"), "ord", part.alias("t")).alias("e"))
    mixes = groups.select("request", "grp").distinct().join(
        shown.groupBy("request", "grp").agg(F.array_sort(F.collect_list("e")).alias("l")), ["request", "grp"], "left"
    ).select("request", F.col("grp").alias("line"), F.coalesce(F.array_join(F.transform("l", lambda e: e["t"]), ", "), F.lit("spread evenly")).alias("text"))
    ends = F.create_map(*[x for k, (_, lo, hi) in SCALAR_LABELS.items() for x in (F.lit(k), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))])
    end = F.try_element_at(ends, F.col("k"))
    t = F.col("target") / TARGET_SCALE
    side = F.when(t > 0.15, end["hi"]).when(t < -0.15, end["lo"]).otherwise("middle")
    sure = F.when(F.col("weight") >= 70, "sure").when(F.col("weight") >= 35, "fairly sure").otherwise("a hint")
    number = F.concat(F.when(t >= 0, "+").otherwise(""), F.format_string("%.2f", t))
    words = F.when(F.col("weight") == 0, F.lit("unknown")).otherwise(F.concat(side, F.lit(" ("), number, F.lit(", "), sure, F.lit(")")))
    return mixes.unionByName(scalars.select("request", F.col("k").alias("line"), words.alias("text")))


def coverage(sums: DataFrame, sessions: DataFrame, min_scalars: int = 7) -> DataFrame:
    """(session_id, covered): enough scalars touched, and decades and genres with evidence."""
    got = sums.groupBy("session_id").agg(
        F.count_if((F.col("grp") == "scalar") & (F.col("w") > 0)).alias("_s"),
        F.coalesce(F.sum(F.when(F.col("grp") == "decades", F.col("evidence"))), F.lit(0.0)).alias("_d"),
        F.coalesce(F.sum(F.when(F.col("grp") == "genres", F.col("evidence"))), F.lit(0.0)).alias("_g"),
    )
    ok = (F.col("_s") >= min_scalars) & (F.col("_d") > 0) & (F.col("_g") > 0)
    return sessions.select("session_id").distinct().join(got, "session_id", "left").select("session_id", F.coalesce(ok, F.lit(False)).alias("covered"))


def shareable_answers(answers: DataFrame, questions: DataFrame, opted_in: DataFrame) -> DataFrame:
    """Answers that may leave: known questions, no skips, sensitive ones only with the session's opt-in."""
    known = answers.where("choice <> 'skip'").join(questions.select("question_id", "sensitive"), "question_id")
    allowed = opted_in.select("session_id", F.lit(True).alias("_in")).distinct()
    ok = ~F.col("sensitive") | F.coalesce("_in", F.lit(False))
    return known.join(allowed, "session_id", "left").where(ok).select("session_id", "seq", "question_id", "choice")
