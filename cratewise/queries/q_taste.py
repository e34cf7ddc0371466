"""Taste profiles and question selection (J1–J19, B13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratewise.functions.text import seed_of
from cratewise.plans import questions as qs
from cratewise.plans import taste
from cratewise.queries.registry import query
from cratewise.queries.roles import GENRES, Roles, oracle_stage, stage

c = F.col
DIMS = taste.Dims(
    ("energy", "valence", "dance", "acoustic", "intensity", "tempo", "mainstream", "vocal", "complexity"),
    ("dec50", "dec60", "dec70", "dec80", "dec90", "dec00", "dec10", "dec20"), GENRES,
    ("lang_en", "lang_he", "lang_fr", "lang_es", "lang_other"),
)

oracle_stage("o_choice", """
    SELECT e.question_id, e.side AS choice, e.grp, e.k, e.v, p.pack_weight * q.weight AS w FROM effects e JOIN questions q ON q.question_id = e.question_id JOIN packs p ON p.pack = q.pack
    UNION ALL SELECT e.question_id, 'both', e.grp, e.k, sum(e.v) / 2, 0.5 * any_value(p.pack_weight * q.weight) FROM effects e JOIN questions q ON q.question_id = e.question_id
      JOIN packs p ON p.pack = q.pack GROUP BY 1, 3, 4""")
oracle_stage("o_effect", "SELECT a.session_id, o.grp, o.k, o.w * o.v AS wv, o.w FROM answers a JOIN o_choice o ON o.question_id = a.question_id AND o.choice = a.choice")
oracle_stage("st_sums", "SELECT session_id, grp, k, sum(wv) AS s, sum(w) AS w, sum(abs(wv)) AS evidence FROM o_effect GROUP BY 1, 2, 3")

stage("choices")(lambda r: taste.choice_effects(r.effects, r.questions, r.packs))
stage("st_sums")(lambda r: r.keep(taste.profile_sums(taste.answer_effects(r.answers, r.choices))))


@query("j1_answer_effects", "SELECT session_id, grp, k, wv, w FROM o_effect")
def j1(r: Roles):
    return taste.answer_effects(r.answers, r.choices)


@query("j2_scalar_fold", "SELECT session_id, k, round(s / (1 + w), 9) AS mu, 1 + w AS c FROM st_sums WHERE grp = 'scalar'")
def j2(r: Roles):
    return taste.scalar_profile(r.st_sums).withColumn("mu", F.round("mu", 9))


@query("j3_group_evidence", "SELECT session_id, grp, sum(evidence) AS evidence FROM st_sums WHERE grp <> 'scalar' GROUP BY 1, 2")
def j3(r: Roles):
    return taste.group_evidence(r.st_sums)


@query("j4_top_categories", """
    SELECT session_id, k, rk FROM (SELECT s.session_id, s.k, row_number() OVER (PARTITION BY s.session_id ORDER BY s.s DESC, d.ord) AS rk
      FROM st_sums s JOIN dims d ON d.grp = 'genres' AND d.k = s.k WHERE s.grp = 'genres' AND s.s > 0) WHERE rk <= 3""")
def j4(r: Roles):
    return taste.top_categories(r.st_sums, r.dims.where("grp = 'genres'"), "genres", 3)


oracle_stage("o_dist", """
    WITH g AS (SELECT e.session_id, d.grp, d.k, d.ord, coalesce(s.s, 0) AS s FROM (SELECT DISTINCT session_id, grp FROM st_sums WHERE grp <> 'scalar' AND evidence > 0) e
        JOIN dims d ON d.grp = e.grp LEFT JOIN st_sums s ON s.session_id = e.session_id AND s.k = d.k),
    m AS (SELECT *, CASE WHEN grp = 'decades' THEN s + 0.3 * (coalesce(lag(s) OVER w, 0) + coalesce(lead(s) OVER w, 0)) ELSE s END AS z FROM g WINDOW w AS (PARTITION BY session_id, grp ORDER BY ord)),
    t AS (SELECT *, max(z) OVER (PARTITION BY session_id, grp) AS mz, greatest(CASE grp WHEN 'decades' THEN 0.3 WHEN 'genres' THEN 0.25 ELSE 1 END,
        CASE grp WHEN 'genres' THEN 0.15 WHEN 'decades' THEN 0.1 ELSE 0 END * greatest(0, max(z) OVER (PARTITION BY session_id, grp))) AS tau FROM m)
    SELECT session_id, grp, k, ord, exp((z - mz) / tau) / sum(exp((z - mz) / tau)) OVER (PARTITION BY session_id, grp) AS p FROM t""")


@query("j5_group_distribution", "SELECT session_id, grp, k, ord, round(p, 7) AS p FROM o_dist")
def j5(r: Roles):
    return taste.group_distribution(r.st_sums, DIMS).withColumn("p", F.round("p", 7))


@query("j6_taste_scalars", """
    SELECT request, k, ord, CAST(floor(greatest(-1, least(1, CASE WHEN w > 0 THEN s / w ELSE 0 END)) * 100 + 0.5) AS INTEGER) AS target,
           CAST(floor(greatest(0, least(1, w / 5)) * 100 + 0.5) AS INTEGER) AS weight FROM (
      SELECT a.session_id AS request, d.k, d.ord, coalesce(s.w, 0) + (CASE WHEN d.k = 'mainstream' THEN 0.6 ELSE 0 END) AS w, coalesce(s.s, 0) + (CASE WHEN d.k = 'mainstream' THEN CAST(0.6 AS DOUBLE) * 0.6 ELSE 0 END) AS s
      FROM (SELECT DISTINCT session_id FROM answers) a JOIN dims d ON d.grp = 'scalar' LEFT JOIN st_sums s ON s.session_id = a.session_id AND s.k = d.k)""")
def j6(r: Roles):
    return taste.taste_scalars(r.answers, r.st_sums, DIMS)


@query("j6_taste_groups", "SELECT session_id AS request, grp, k, ord, CAST(floor(p * 1000 + 0.5) AS INTEGER) AS p FROM o_dist")
def j6b(r: Roles):
    return taste.taste_groups(r.st_sums, DIMS)


@query("j6_taste_vectors", """
    SELECT s.request, s.target, s.weight, d.p AS decades, g.p AS genres, l.p AS languages FROM
      (SELECT request, string_agg(target, ',' ORDER BY ord) AS target, string_agg(weight, ',' ORDER BY ord) AS weight FROM taste_scalar GROUP BY 1) s
    LEFT JOIN (SELECT request, string_agg(p, ',' ORDER BY ord) AS p FROM taste_group WHERE grp = 'decades' GROUP BY 1) d ON d.request = s.request
    LEFT JOIN (SELECT request, string_agg(p, ',' ORDER BY ord) AS p FROM taste_group WHERE grp = 'genres' GROUP BY 1) g ON g.request = s.request
    LEFT JOIN (SELECT request, string_agg(p, ',' ORDER BY ord) AS p FROM taste_group WHERE grp = 'languages' GROUP BY 1) l ON l.request = s.request""")
def j6c(r: Roles):
    v = taste.taste_vectors(r.taste_scalar, r.taste_group)
    text = lambda x: F.array_join(F.transform(x, lambda e: e.cast("string")), ",").alias(x)
    return v.select("request", *[text(x) for x in ("target", "weight", "decades", "genres", "languages")])


@query("j7_answer_violations", """
    SELECT session_id, 'unknown question' AS rule, question_id, count(*) AS n FROM answers WHERE question_id NOT IN (SELECT question_id FROM questions WHERE pri <> 37) GROUP BY 1, 3
    UNION ALL SELECT session_id, 'answered twice', question_id, count(*) FROM answers GROUP BY 1, 3 HAVING count(*) > 1""")
def j7(r: Roles):
    return taste.answer_violations(r.answers, r.questions.where("pri <> 37"))


@query("j7_taste_violations", """
    SELECT DISTINCT request, 'target range' AS rule FROM (SELECT request, target * 2 - ord AS t FROM taste_scalar) WHERE abs(t) > 100
    UNION ALL SELECT request, grp || ' all zero' FROM (SELECT request, grp, max(CASE WHEN p < 300 THEN 0 ELSE p END) AS m FROM taste_group GROUP BY 1, 2) WHERE m = 0
    UNION ALL SELECT request, grp || ' length' FROM taste_group WHERE grp = 'genres' AND request % 2 = 0 AND ord = 0""")
def j7b(r: Roles):
    s = r.taste_scalar.withColumn("target", c("target") * 2 - c("ord"))
    g = r.taste_group.where("not (grp = 'genres' and request % 2 = 0 and ord = 5)")
    g = r.taste_group.withColumn("p", F.when(c("p") < 300, 0).otherwise(c("p"))).join(g.select("request", "grp", "k"), ["request", "grp", "k"], "left_semi")
    first = r.taste_group.where("grp = 'genres' and request % 2 = 0 and ord = 5").select("request", "grp", "k", "ord", F.when(c("p") < 300, 0).otherwise(c("p")).alias("p"))
    # Move the last genre's share to the first, so only the length is wrong.
    g = g.unionByName(first.withColumns({"k": F.lit("x"), "ord": F.lit(9)}).limit(0)).join(first.select("request", "grp", c("p").alias("_p")), ["request", "grp"], "left")
    g = g.withColumn("p", F.when(c("ord") == 0, F.greatest("p", F.coalesce("_p", F.lit(0)))).otherwise(c("p"))).drop("_p")
    return taste.taste_violations(s, g, DIMS)


@query("j8_tweak_scalars", """
    WITH f AS (SELECT t.*, s.energy, s.mood, s.popularity, CASE WHEN energy <> 0 AND k NOT IN ('energy', 'tempo', 'dance') THEN floor(weight * power(0.6, abs(energy)) + 0.5) ELSE weight END AS w1
        FROM taste_scalar t JOIN tweak_steps s ON s.request = t.request),
    g AS (SELECT *, CASE WHEN mood <> 0 AND k <> 'valence' THEN floor(w1 * power(0.6, abs(mood)) + 0.5) ELSE w1 END AS w2 FROM f),
    h AS (SELECT *, CASE WHEN popularity <> 0 AND k <> 'mainstream' THEN floor(w2 * power(0.6, abs(popularity)) + 0.5) ELSE w2 END AS w3 FROM g)
    SELECT request, k, ord, CAST(CASE WHEN k IN ('energy', 'tempo', 'dance') AND energy <> 0 THEN greatest(-100, least(100, target + energy * CASE k WHEN 'energy' THEN 50 WHEN 'tempo' THEN 20 ELSE 15 END))
        WHEN k = 'valence' AND mood <> 0 THEN greatest(-100, least(100, target + mood * 50)) WHEN k = 'mainstream' AND popularity <> 0 THEN greatest(-100, least(100, target + popularity * 50)) ELSE target END AS INTEGER) AS target,
      CAST(CASE WHEN (k = 'energy' AND energy <> 0) OR (k = 'valence' AND mood <> 0) OR (k = 'mainstream' AND popularity <> 0) THEN 100 ELSE w3 END AS INTEGER) AS weight FROM h""")
def j8(r: Roles):
    return taste.tweak_scalars(r.taste_scalar, r.tweak_steps)


@query("j8_tweak_decades", """
    WITH b AS (SELECT s.request, s.era, d.k, d.ord, CASE WHEN t.p IS NOT NULL THEN CAST(t.p AS DOUBLE) END AS p FROM tweak_steps s JOIN dims d ON d.grp = 'decades'
        LEFT JOIN taste_group t ON t.request = s.request AND t.grp = 'decades' AND t.k = d.k WHERE s.era <> 0),
    o AS (SELECT *, CASE WHEN era > 0 THEN coalesce(lag(p) OVER w, 0) ELSE coalesce(lead(p) OVER w, 0) END AS a, CASE WHEN (era > 0 AND ord = 7) OR (era < 0 AND ord = 0) THEN p ELSE 0 END AS e FROM b WINDOW w AS (PARTITION BY request ORDER BY ord)),
    q AS (SELECT request, era, k, ord, p, p * (1 - 0.4) + (a + e) * 0.4 AS p1 FROM o),
    u AS (SELECT *, CASE WHEN era > 0 THEN coalesce(lag(p1) OVER w, 0) ELSE coalesce(lead(p1) OVER w, 0) END AS a, CASE WHEN (era > 0 AND ord = 7) OR (era < 0 AND ord = 0) THEN p1 ELSE 0 END AS e FROM q WINDOW w AS (PARTITION BY request ORDER BY ord)),
    v AS (SELECT request, k, ord, CASE WHEN p IS NULL THEN exp(era * 0.35 * (ord - 3.5)) WHEN abs(era) = 1 THEN p1 ELSE p1 * (1 - 0.4) + (a + e) * 0.4 END AS w FROM u),
    x AS (SELECT *, round(w / sum(w) OVER (PARTITION BY request) * 1000, 9) AS ex FROM v)
    SELECT request, 'decades' AS grp, k, ord, CAST(floor(ex) + (CASE WHEN row_number() OVER (PARTITION BY request ORDER BY round(ex - floor(ex), 6) DESC, ord) <= 1000 - sum(floor(ex)) OVER (PARTITION BY request) THEN 1 ELSE 0 END) AS INTEGER) AS p FROM x
    UNION ALL SELECT t.request, t.grp, t.k, t.ord, t.p FROM taste_group t LEFT JOIN tweak_steps s ON s.request = t.request WHERE NOT (t.grp = 'decades' AND coalesce(s.era, 0) <> 0)""")
def j8b(r: Roles):
    return taste.tweak_decades(r.taste_group, r.tweak_steps, DIMS)


oracle_stage("o_adj", """
    SELECT request, grp, k, CASE WHEN grp = 'scalar' THEN greatest(-30, least(30, v)) ELSE greatest(-50, least(50, v)) END AS v FROM deltas WHERE v <> 0 AND k <> 'PROMO'""")
stage("adj")(lambda r: taste.clamp_adjustments(r.deltas.where("k <> 'PROMO'").unionByName(r.deltas.withColumn("k", F.lit("nope"))), DIMS))


@query("j9_clamped_adjustments", "SELECT request, grp, k, CAST(v AS INTEGER) AS v FROM o_adj")
def j9(r: Roles):
    return r.adj


@query("j9_adjust_scalars", """
    SELECT t.request, t.k, t.ord, CAST(CASE WHEN a.v IS NULL THEN t.target ELSE greatest(-100, least(100, t.target + a.v)) END AS INTEGER) AS target,
           CAST(CASE WHEN a.v IS NULL THEN t.weight ELSE greatest(t.weight, 40) END AS INTEGER) AS weight
    FROM taste_scalar t LEFT JOIN o_adj a ON a.request = t.request AND a.grp = 'scalar' AND a.k = t.k""")
def j9b(r: Roles):
    return taste.adjust_scalars(r.taste_scalar, r.adj)


@query("j9_adjust_groups", """
    WITH t AS (SELECT DISTINCT request, grp FROM o_adj WHERE grp <> 'scalar'),
    x AS (SELECT t.request, t.grp, d.k, d.ord, coalesce(CAST(g.p AS DOUBLE), 1) AS x, coalesce(a.v, 0) / 100 AS b FROM t JOIN dims d ON d.grp = t.grp
        LEFT JOIN taste_group g ON g.request = t.request AND g.k = d.k LEFT JOIN o_adj a ON a.request = t.request AND a.k = d.k AND a.grp = t.grp),
    y AS (SELECT *, sum(x) OVER (PARTITION BY request, grp) * 0.02 AS f FROM x),
    z AS (SELECT request, grp, k, ord, CASE WHEN b > 0 THEN greatest(x, f) * (1 + 3 * b) WHEN b < 0 THEN x / (1 - 3 * b) ELSE x END AS w FROM y),
    e AS (SELECT *, round(w / sum(w) OVER (PARTITION BY request, grp) * 1000, 9) AS ex FROM z)
    SELECT request, grp, k, ord, CAST(floor(ex) + (CASE WHEN row_number() OVER (PARTITION BY request, grp ORDER BY round(ex - floor(ex), 6) DESC, ord) <= 1000 - sum(floor(ex)) OVER (PARTITION BY request, grp) THEN 1 ELSE 0 END) AS INTEGER) AS p FROM e
    UNION ALL SELECT g.request, g.grp, g.k, g.ord, g.p FROM taste_group g WHERE (g.request, g.grp) NOT IN (SELECT (request, grp) FROM t)""")
def j9c(r: Roles):
    return taste.adjust_groups(r.taste_group, r.adj, DIMS)


oracle_stage("o_at", """
    SELECT request, max(CASE WHEN k = 'energy' THEN target END) AS e, max(CASE WHEN k = 'valence' THEN target END) AS v, max(CASE WHEN k = 'acoustic' THEN target END) AS a FROM taste_scalar GROUP BY 1""")
oracle_stage("o_arch", f"""
    SELECT o.request, CASE (CASE WHEN e >= 15 THEN 'hi' ELSE 'lo' END) || '.' || (CASE WHEN v >= 0 THEN 'bright' ELSE 'dark' END) || '.' || (CASE WHEN m.m < 0.35 THEN 'retro' ELSE 'modern' END) || '.' || (CASE WHEN a >= 0 THEN 'organic' ELSE 'electric' END)
      {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in taste.ARCHETYPES.items())} END AS archetype, g.k AS genre, d.k AS decade FROM o_at o
    LEFT JOIN (SELECT request, sum(CASE WHEN ord >= 5 THEN p ELSE 0 END) / CAST(nullif(sum(p), 0) AS DOUBLE) AS m FROM taste_group WHERE grp = 'decades' GROUP BY 1) m ON m.request = o.request
    LEFT JOIN (SELECT request, arg_min(k, (-p, ord)) AS k FROM taste_group WHERE grp = 'genres' GROUP BY 1) g ON g.request = o.request
    LEFT JOIN (SELECT request, arg_min(k, (-p, ord)) AS k FROM taste_group WHERE grp = 'decades' GROUP BY 1) d ON d.request = o.request""")


@query("j10_archetype", "SELECT * FROM o_arch")
def j10(r: Roles):
    return taste.archetypes(r.taste_scalar, r.taste_group)


@query("j10_playlist_title", """
    SELECT o.request, archetype || coalesce(' · ' || nullif(concat_ws(' ', upper(substr(genre, 1, 1)) || lower(substr(genre, 2)), CASE WHEN decade IN ('dec00', 'dec10', 'dec20') THEN '20' || substr(decade, 4) || 's' ELSE substr(decade, 4) || 's' END), ''), '') AS title,
           u.n || ' answers · seed ' || substr('seed' || o.request, 1, 4) || '…' AS description FROM o_arch o JOIN user_sum u ON u.request = o.request""")
def j10b(r: Roles):
    return taste.playlist_titles(taste.archetypes(r.taste_scalar, r.taste_group), r.user_sum.select("request", "n"), r.requests.select("request", "seed"))


@query("j11_hints", """
    WITH g AS (SELECT request, list(k ORDER BY p DESC, ord) AS ks, list(p / 1000.0 ORDER BY p DESC, ord) AS ps FROM taste_group WHERE grp = 'genres' GROUP BY 1),
    d AS (SELECT request, list(k ORDER BY ord) AS ks, list(p / 1000.0 ORDER BY ord) AS ps, CAST(arg_min(ord, (-p, ord)) AS INTEGER) + 1 AS t FROM taste_group WHERE grp = 'decades' GROUP BY 1),
    pr AS (SELECT request, arg_min(i, (-s, i)) AS i, max(s) AS s FROM (SELECT request, ord + 1 AS i, (p + lead(p) OVER (PARTITION BY request ORDER BY ord)) / 1000.0 AS s FROM taste_group WHERE grp = 'decades') WHERE s IS NOT NULL GROUP BY 1),
    h AS (
      SELECT request, 1 AS o, 0 AS o2, 'genre:' || ks[1] || CASE WHEN ps[2] >= 0.25 THEN '+' || ks[2] ELSE '' END AS t FROM g WHERE ps[1] >= 0.35
      UNION ALL SELECT d.request, 2, 0, CASE WHEN ps[t] >= 0.35 THEN CASE WHEN coalesce(CASE WHEN t > 1 THEN ps[t - 1] END, 0) > coalesce(ps[t + 1], 0)
            THEN CASE WHEN ps[t - 1] >= 0.15 THEN 'era:' || ks[t - 1] || '+' || ks[t] ELSE 'era:' || ks[t] END
            ELSE CASE WHEN coalesce(ps[t + 1], 0) >= 0.15 THEN 'era:' || ks[t] || '+' || ks[t + 1] ELSE 'era:' || ks[t] END END
          ELSE 'era:' || ks[i] || '+' || ks[i + 1] END FROM d JOIN pr ON pr.request = d.request WHERE ps[t] >= 0.35 OR s >= 0.45
      UNION ALL SELECT request, 3, ord, 'language:' || k FROM taste_group WHERE grp = 'languages' AND p >= 500 AND k <> 'lang_en'
      UNION ALL SELECT request, 4, list_position(['energy', 'valence', 'dance', 'acoustic', 'tempo', 'mainstream'], k), 'scalar:' || k || ':' || CASE WHEN target > 0 THEN 'high' ELSE 'low' END
        FROM taste_scalar WHERE weight >= 60 AND abs(target) >= 40 AND k IN ('energy', 'valence', 'dance', 'acoustic', 'tempo', 'mainstream'))
    SELECT u.request, coalesce(string_agg(h.t, ';' ORDER BY h.o, h.o2), '') AS hints FROM user_sum u LEFT JOIN h ON h.request = u.request GROUP BY 1""")
def j11(r: Roles):
    return taste.hints(r.taste_scalar, r.taste_group, DIMS).withColumn("hints", F.array_join("hints", ";"))


# --- questions --------------------------------------------------------------------------------------
@stage("bank")
def _bank(r: Roles):
    q = r.questions
    leads = r.spark.createDataFrame([("deep", 0, 30), ("deep", 1, 70)], "pack string, lead_no int, position int")
    return qs.Bank(
        q.select("question_id", "pack", "pri", "weight", "family"), r.effects, r.packs, r.dims.where("grp = 'genres'").select("k", "ord"),
        q.where("unlock_question is not null").select("question_id", c("unlock_question").alias("ref_question"), c("unlock_side").alias("ref_side")),
        q.where("unlock_genre is not null").select("question_id", c("unlock_genre").alias("k")), leads=leads,
    )


oracle_stage("o_fam", "SELECT question_id, coalesce(family, question_id) AS canonical FROM questions")
oracle_stage("o_asked", "SELECT a.session_id, f.canonical, arg_max(a.choice, a.seq) AS choice FROM answers a JOIN o_fam f ON f.question_id = a.question_id GROUP BY 1, 2")
oracle_stage("o_eligible", """
    SELECT s.session_id, q.question_id, q.pack, q.pri, q.weight FROM (SELECT DISTINCT session_id FROM answers) s CROSS JOIN questions q
    WHERE q.family IS NULL AND NOT EXISTS (SELECT 1 FROM o_asked a WHERE a.session_id = s.session_id AND a.canonical = q.question_id)
      AND ((q.unlock_question IS NULL AND q.unlock_genre IS NULL)
        OR EXISTS (SELECT 1 FROM o_asked a JOIN o_fam f ON f.canonical = a.canonical WHERE a.session_id = s.session_id AND f.question_id = q.unlock_question AND a.choice IN (q.unlock_side, 'both'))
        OR q.unlock_genre IN (SELECT k FROM (SELECT e.session_id AS sid, e.k, row_number() OVER (PARTITION BY e.session_id ORDER BY e.s DESC, d.ord) AS i FROM st_sums e
             JOIN dims d ON d.grp = 'genres' AND d.k = e.k WHERE e.grp = 'genres' AND e.s > 0) WHERE i <= 3 AND sid = s.session_id))""")
oracle_stage("o_diff", "SELECT question_id, grp, k, sum(CASE WHEN side = 'a' THEN v ELSE -v END) AS d FROM effects GROUP BY 1, 2, 3")
oracle_stage("o_gain", """
    SELECT e.session_id, e.question_id, sum(abs(d.d) * (CASE WHEN d.grp = 'scalar' THEN 1 / (1 + coalesce(s.w, 0)) ELSE 1 / (1 + coalesce(g.ev, 0)) END) * e.weight * p.pack_weight) * (0.5 + any_value(e.pri) / 100) AS raw, count(*) AS nk
    FROM o_eligible e JOIN packs p ON p.pack = e.pack JOIN o_diff d ON d.question_id = e.question_id LEFT JOIN st_sums s ON s.session_id = e.session_id AND s.k = d.k
    LEFT JOIN (SELECT session_id, grp, sum(evidence) AS ev FROM st_sums GROUP BY 1, 2) g ON g.session_id = e.session_id AND g.grp = d.grp GROUP BY 1, 2""")
oracle_stage("o_duel", """
    WITH k AS (SELECT s.session_id, s.k, s.s / t.top AS c FROM st_sums s JOIN (SELECT session_id, max(s) AS top FROM st_sums WHERE grp = 'genres' GROUP BY 1) t ON t.session_id = s.session_id WHERE s.grp = 'genres' AND s.s >= 1)
    SELECT e.session_id, e.question_id, max(a.c * b.c * least(abs(x.d), abs(y.d))) AS duel FROM o_eligible e JOIN o_diff x ON x.question_id = e.question_id AND x.grp = 'genres' JOIN o_diff y ON y.question_id = e.question_id AND y.grp = 'genres' AND x.d > 0 AND y.d < 0
    JOIN k a ON a.session_id = e.session_id AND a.k = x.k JOIN k b ON b.session_id = e.session_id AND b.k = y.k GROUP BY 1, 2""")


@query("j12_eligible_questions", "SELECT session_id, question_id FROM o_eligible")
def j12(r: Roles):
    return qs.eligible_questions(r.answers, r.st_sums, r.bank)


@query("j13_gain_score", "SELECT session_id, question_id, round(raw / nk, 11) AS gain FROM o_gain")
def j13(r: Roles):
    pairs = qs.eligible_questions(r.answers, r.st_sums, r.bank)
    return qs.gain_scores(pairs, r.st_sums, r.bank).select("session_id", "question_id", F.round("gain", 11).alias("gain"))


@query("j14_duel_value", "SELECT session_id, question_id, round(duel, 7) AS duel FROM o_duel")
def j14(r: Roles):
    pairs = qs.eligible_questions(r.answers, r.st_sums, r.bank)
    return qs.duel_values(pairs, r.st_sums, r.bank).where("duel > 0").withColumn("duel", F.round("duel", 7))


@query("j15_next_question", """
    WITH p AS (SELECT session_id, count(*) + 1 AS pos FROM answers GROUP BY 1),
    b AS (SELECT e.*, p.pos, CASE WHEN pos <= 3 THEN 'hook' WHEN pos % 4 = 0 THEN 'vibe' WHEN pos % 10 = 7 THEN 'spicy' WHEN pos % 4 = 1 AND pos <= 20 THEN 'explore' ELSE 'main' END AS slot,
        CASE WHEN e.pack = 'deep' AND pos IN (30, 70) AND (SELECT count(*) FROM answers a JOIN questions q ON q.question_id = a.question_id WHERE a.session_id = e.session_id AND q.pack = 'deep') <= (CASE pos WHEN 30 THEN 0 ELSE 1 END) THEN true ELSE false END AS led,
        EXISTS (SELECT 1 FROM o_diff d WHERE d.question_id = e.question_id AND d.grp IN ('genres', 'decades') AND abs(d.d) >= 0.5 AND d.k NOT IN
          (SELECT x.k FROM answers a JOIN effects x ON x.question_id = a.question_id WHERE a.session_id = e.session_id AND x.grp IN ('genres', 'decades'))) AS opens
      FROM o_eligible e JOIN p ON p.session_id = e.session_id),
    i AS (SELECT *, CASE slot WHEN 'hook' THEN pack = 'core' WHEN 'vibe' THEN pack = 'vibe' WHEN 'spicy' THEN pack = 'spicy' ELSE pack NOT IN ('vibe', 'spicy') END AS ins FROM b),
    a AS (SELECT *, bool_or(led) OVER (PARTITION BY session_id) AS al, bool_or(ins) OVER (PARTITION BY session_id) AS ai, bool_or(opens AND ins) OVER (PARTITION BY session_id) AS ao FROM i),
    f AS (SELECT *, CASE WHEN al THEN 'lead' WHEN slot = 'explore' AND NOT ao THEN 'main' ELSE slot END AS fs FROM a WHERE CASE WHEN al THEN led ELSE NOT ai OR ins END),
    s AS (SELECT f.session_id, f.question_id, f.fs AS slot, CASE WHEN f.fs IN ('explore', 'lead') THEN f.pri WHEN f.fs = 'hook' THEN g.raw ELSE g.raw / g.nk * (CASE WHEN f.pos >= 6 THEN 1 + 3 * coalesce(u.duel, 0) ELSE 1 END) END AS score
      FROM f JOIN o_gain g ON g.session_id = f.session_id AND g.question_id = f.question_id LEFT JOIN o_duel u ON u.session_id = f.session_id AND u.question_id = f.question_id WHERE f.fs <> 'explore' OR f.opens)
    SELECT session_id, question_id, slot FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, question_id) AS n FROM s) WHERE n = 1""")
def j15(r: Roles):
    return qs.next_question(qs.question_scores(r.answers, r.st_sums, r.bank))


@query("j15_drawn_question")
def j15b(r: Roles):
    scores = qs.question_scores(r.answers, r.st_sums, r.bank)
    seeds = r.answers.groupBy("session_id").agg(seed_of(c("session_id").cast("string"), F.count("*").cast("string")).alias("seed"))
    return qs.draw_question(scores, seeds, r.bank.families(), r.answers)


@query("j16_coverage", """
    SELECT a.session_id, coalesce(sc >= 7 AND d > 0 AND g > 0, false) AS covered FROM (SELECT DISTINCT session_id FROM answers) a LEFT JOIN
      (SELECT session_id, count(*) FILTER (WHERE grp = 'scalar' AND w > 0) AS sc, coalesce(sum(evidence) FILTER (WHERE grp = 'decades'), 0) AS d, coalesce(sum(evidence) FILTER (WHERE grp = 'genres'), 0) AS g FROM st_sums GROUP BY 1) s
    ON s.session_id = a.session_id""")
def j16(r: Roles):
    return taste.coverage(r.st_sums, r.answers)


@query("j17_persona_choices", """
    WITH cat AS (SELECT request AS persona, grp, k, CAST(p AS DOUBLE) / 331 AS w FROM taste_group WHERE p > 150), rg AS (SELECT request AS persona, k, CAST(target - weight AS DOUBLE) / 200 AS lo, CAST(target + weight AS DOUBLE) / 200 AS hi FROM taste_scalar WHERE weight > 0),
    u AS (SELECT r.persona, e.question_id, e.side, abs((lo + hi) / 2) - abs(e.v - (lo + hi) / 2) AS u FROM effects e JOIN rg r ON e.grp = 'scalar' AND r.k = e.k
      UNION ALL SELECT g.persona, e.question_id, e.side, coalesce(e.v * c.w, -0.5 * e.v) FROM effects e JOIN (SELECT DISTINCT persona, grp FROM cat) g ON g.grp = e.grp LEFT JOIN cat c ON c.persona = g.persona AND c.k = e.k),
    t AS (SELECT p.persona, q.question_id, round(coalesce(sum(CASE WHEN u.side = 'a' THEN u.u END), 0), 7) AS u_a, round(coalesce(sum(CASE WHEN u.side = 'b' THEN u.u END), 0), 7) AS u_b
      FROM (SELECT persona FROM cat UNION SELECT persona FROM rg) p CROSS JOIN questions q LEFT JOIN u ON u.persona = p.persona AND u.question_id = q.question_id GROUP BY 1, 2)
    SELECT persona, question_id, u_a, u_b, CASE WHEN greatest(u_a, u_b) < -0.25 THEN 'skip' WHEN abs(u_a - u_b) < 0.05 THEN CASE WHEN greatest(u_a, u_b) > 0 THEN 'both' ELSE 'skip' END WHEN u_a > u_b THEN 'a' ELSE 'b' END AS choice FROM t""")
def j17(r: Roles):
    cats = r.taste_group.where("p > 150").select(c("request").alias("persona"), "grp", "k", (c("p").cast("double") / 331).alias("w"))
    half = lambda x: x.cast("double") / 200
    rng = r.taste_scalar.where("weight > 0").select(c("request").alias("persona"), "k", half(c("target") - c("weight")).alias("lo"), half(c("target") + c("weight")).alias("hi"))
    out = qs.persona_choices(r.effects, cats, rng)
    return out.withColumns({"u_a": F.round("u_a", 7), "u_b": F.round("u_b", 7)})


@query("j18_allowed_variants", """
    WITH d AS (SELECT DISTINCT session_id, 'q' || (session_id % 4 * 10) AS canonical FROM answers), v AS (SELECT d.session_id, f.question_id, (d.session_id, f.question_id) NOT IN (SELECT (session_id, question_id) FROM answers) AS fresh
      FROM d JOIN o_fam f ON f.canonical = d.canonical)
    SELECT session_id, question_id FROM (SELECT *, bool_or(fresh) OVER (PARTITION BY session_id) AS anew FROM v) WHERE fresh OR NOT anew""")
def j18(r: Roles):
    drawn = r.answers.select("session_id").distinct().withColumn("canonical", F.concat(F.lit("q"), (c("session_id") % 4 * 10).cast("string")))
    return qs.allowed_variants(drawn, r.bank.families(), r.answers.select("session_id", "question_id"))


@query("j19_profile_summary", """
    SELECT t.request, t.grp AS line, coalesce(string_agg(CASE WHEN p >= 50 THEN (CASE grp WHEN 'genres' THEN upper(substr(k, 1, 1)) || lower(substr(k, 2)) WHEN 'decades' THEN (CASE WHEN ord >= 5 THEN '20' ELSE '' END) || substr(k, 4) || 's'
        ELSE CASE k WHEN 'lang_en' THEN 'English' WHEN 'lang_he' THEN 'Hebrew' WHEN 'lang_fr' THEN 'French' WHEN 'lang_es' THEN 'Spanish' ELSE 'Other languages' END END) || ' [' || k || '] ' || CAST(floor(CAST(p AS DOUBLE) / 1000 * 100 + 0.5) AS INTEGER) || '%' END, ', ' ORDER BY p DESC, ord), 'spread evenly') AS text
    FROM taste_group t GROUP BY 1, 2
    UNION ALL SELECT request, k, CASE WHEN weight = 0 THEN 'unknown' ELSE (CASE WHEN target > 15 THEN CASE k WHEN 'energy' THEN 'Energetic' WHEN 'valence' THEN 'Bright' WHEN 'dance' THEN 'Danceable' WHEN 'acoustic' THEN 'Organic' WHEN 'intensity' THEN 'Intense'
        WHEN 'tempo' THEN 'Fast' WHEN 'mainstream' THEN 'Hits' WHEN 'vocal' THEN 'Vocal' ELSE 'Complex' END WHEN target < -15 THEN CASE k WHEN 'energy' THEN 'Calm' WHEN 'valence' THEN 'Dark' WHEN 'dance' THEN 'Still' WHEN 'acoustic' THEN 'Electric'
        WHEN 'intensity' THEN 'Gentle' WHEN 'tempo' THEN 'Slow' WHEN 'mainstream' THEN 'Deep cuts' WHEN 'vocal' THEN 'Instrumental' ELSE 'Simple' END ELSE 'middle' END) || ' (' || (CASE WHEN target >= 0 THEN '+' ELSE '' END) || printf('%.2f', target / 100.0)
        || ', ' || (CASE WHEN weight >= 70 THEN 'sure' WHEN weight >= 35 THEN 'fairly sure' ELSE 'a hint' END) || ')' END FROM taste_scalar""")
def j19(r: Roles):
    return taste.summary_lines(r.taste_scalar, r.taste_group)


@query("b13_sensitive_answers", """
    SELECT a.session_id, a.seq, a.question_id, a.choice FROM answers a JOIN questions q ON q.question_id = a.question_id WHERE a.choice <> 'skip' AND (NOT q.sensitive OR a.session_id % 3 = 0)""")
def b13(r: Roles):
    return taste.shareable_answers(r.answers, r.questions, r.answers.where("session_id % 3 = 0").select("session_id"))
