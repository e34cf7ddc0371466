"""Role tables: the given tables read as recordings, listens, tags, answers, tastes and playlists.

``ROLE_SQL`` is text both engines run. ``STAGE_SQL`` (filled by the oracle modules) is the DuckDB form of
a derived stage; ``STAGES`` is the Spark form of the same stage, built with the library's operators.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cratewise.session import fixed, limit_broadcasts, tune

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

_SCALAR_RULES = {  # axis → two whole multipliers, so both engines compute the same fractions
    "energy": (37, 11), "valence": (53, 7), "dance": (29, 13), "acoustic": (71, 3), "intensity": (43, 17),
    "tempo": (61, 19), "mainstream": (83, 5), "vocal": (97, 23), "complexity": (31, 2),
}
_SCALAR_SQL = ",\n".join(
    f"CAST((p_partkey * {a} + p_size * {b}) % 201 - 100 AS DOUBLE) / 100 AS {n}"
    for n, (a, b) in _SCALAR_RULES.items()
)
GENRES = ("ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE")
_DIMS = [
    *[("scalar", n) for n in _SCALAR_RULES],
    *[("decades", f"dec{d}") for d in ("50", "60", "70", "80", "90", "00", "10", "20")],
    *[("genres", g) for g in GENRES],
    *[("languages", f"lang_{x}") for x in ("en", "he", "fr", "es", "other")],
]


def _dims_sql() -> str:
    ords: dict[str, int] = {}
    rows = []
    for i, (grp, k) in enumerate(_DIMS):
        rows.append(f"({i}, '{grp}', '{k}', {ords.setdefault(grp, 0)})")
        ords[grp] += 1
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(i, grp, k, ord)"



def prob_sql() -> str:
    from cratewise.functions.features import PROBABILITIES

    return ",\n".join(
        f"CAST((l_orderkey * {2 * i + 1} + l_partkey * {i + 3}) % 1001 AS DOUBLE) / 1000 AS {p}"
        for i, p in enumerate(PROBABILITIES)
    )


ROLE_SQL: dict[str, str] = {
    "dims": _dims_sql(),
    "item_pop": """
        SELECT l_partkey AS track_id, count(DISTINCT o_custkey) AS listeners,
               CAST(sum(l_quantity) AS BIGINT) AS listens
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_partkey""",
    "track_base": f"""
        SELECT p_partkey AS track_id, p_name AS title, p_brand AS artist,
               CASE WHEN p_partkey % 37 <> 0 THEN p_type END AS genre,
               CASE WHEN p_partkey % 29 <> 0
                    THEN CAST(1955 + (p_size * 7 + p_partkey) % 68 AS INT) END AS year,
               CASE p_partkey % 9 WHEN 0 THEN 'lang_he' WHEN 1 THEN 'lang_fr' WHEN 2 THEN 'lang_es'
                    WHEN 3 THEN 'none' WHEN 4 THEN 'unknown' ELSE 'lang_en' END AS language,
               CASE p_partkey % 13 WHEN 0 THEN 'IL' WHEN 1 THEN 'FR' WHEN 2 THEN NULL ELSE 'US' END AS country,
               CASE WHEN p_partkey % 9 = 0 THEN 'il' ELSE 'intl' END AS market,
               CAST(CASE WHEN p_partkey % 5 < 2 THEN 0 WHEN p_partkey % 5 < 4 THEN 1 ELSE 2 END AS INT) AS tier,
               CAST(p_partkey * 7919 % 10007 AS DOUBLE) / 10007 AS hit,
               CAST(1 + p_partkey % 20 AS INT) AS artist_rank,
               CAST((p_partkey * 7 + p_size) % 400 * 1000 AS INT) AS length_ms,
               CAST(60 + p_partkey % 40 AS DOUBLE) / 100 AS confidence,
               CASE p_partkey % 4 WHEN 0 THEN 'ab_direct' WHEN 1 THEN 'ab_sibling' ELSE 'model' END AS feature_source,
               {_SCALAR_SQL}
        FROM part""",
    "tracks": """
        SELECT b.*, CASE WHEN year < 1960 THEN 'dec50' WHEN year < 1970 THEN 'dec60' WHEN year < 1980 THEN 'dec70'
                 WHEN year < 1990 THEN 'dec80' WHEN year < 2000 THEN 'dec90' WHEN year < 2010 THEN 'dec00'
                 WHEN year < 2020 THEN 'dec10' WHEN year IS NOT NULL THEN 'dec20' END AS decade,
               coalesce(p.listeners, 0) AS listeners, coalesce(p.listens, 0) AS listens
        FROM track_base b LEFT JOIN item_pop p ON p.track_id = b.track_id""",
    "track_cluster": """
        SELECT t.track_id, d.k AS cluster, d.ord AS ord,
               CAST(CASE WHEN d.k = t.genre THEN 0.7 ELSE 0.3 END AS DOUBLE) AS w
        FROM track_base t JOIN dims g ON g.grp = 'genres' AND g.k = t.genre
        JOIN dims d ON d.grp = 'genres' AND (d.k = t.genre OR d.ord = (g.ord + 1 + t.track_id % 3) % 6)""",
    "plays": """
        SELECT o_custkey AS user_id, l_partkey AS track_id, CAST(sum(l_quantity) AS BIGINT) AS listens
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey""",
    # --- answers and tastes
    "event_k": """
        SELECT event_id, user_id, ts, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS x
        FROM events""",
    "answers": """
        SELECT user_id AS session_id, event_id AS seq, concat('q', CAST(x % 120 AS STRING)) AS question_id,
               CASE event_type WHEN 'view' THEN 'a' WHEN 'click' THEN 'b' WHEN 'purchase' THEN 'both'
                    WHEN 'signup' THEN 'a' ELSE 'skip' END AS choice
        FROM event_k""",
    "bank_no": "SELECT CAST(i AS INT) AS i FROM range(120) AS r(i)",
    "questions": """
        SELECT concat('q', CAST(i AS STRING)) AS question_id,
               CASE i % 5 WHEN 0 THEN 'core' WHEN 1 THEN 'vibe' WHEN 2 THEN 'spicy' WHEN 3 THEN 'context' ELSE 'deep' END
                 AS pack,
               i * 37 % 100 AS pri, CAST(CASE WHEN i % 3 = 0 THEN 1.5 ELSE 1 END AS DOUBLE) AS weight,
               CASE WHEN i % 10 = 9 THEN concat('q', CAST(i - 9 AS STRING)) END AS family,
               i % 13 = 0 AS sensitive,
               CASE WHEN i % 8 = 5 THEN concat('q', CAST(i - 5 AS STRING)) END AS unlock_question,
               CASE WHEN i % 8 = 5 THEN 'a' END AS unlock_side,
               CASE WHEN i % 8 = 6 THEN 'PROMO' END AS unlock_genre
        FROM bank_no""",
    "packs": """
        SELECT * FROM (VALUES ('core', CAST(1 AS DOUBLE)), ('vibe', CAST(0.75 AS DOUBLE)), ('spicy', CAST(1 AS DOUBLE)),
          ('context', CAST(0.5 AS DOUBLE)), ('deep', CAST(1.25 AS DOUBLE))) AS t(pack, pack_weight)""",
    "effects": """
        SELECT concat('q', CAST(b.i AS STRING)) AS question_id, s.side, d.k, d.grp, s.v
        FROM bank_no b CROSS JOIN (VALUES ('a', 1, 0, CAST(0.75 AS DOUBLE)), ('a', 3, 5, CAST(0.5 AS DOUBLE)),
             ('b', 5, 14, CAST(0.625 AS DOUBLE)), ('b', 3, 9, CAST(-0.5 AS DOUBLE))) AS s(side, m, c, v)
        JOIN dims d ON d.i = (b.i * s.m + s.c) % 28""",
    "user_sum": "SELECT user_id AS request, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM event_k GROUP BY user_id",
    "requests": """
        SELECT request, CAST(10 + request % 20 AS INT) AS length, concat('seed', CAST(request AS STRING)) AS seed
        FROM user_sum""",
    "taste_scalar": """
        SELECT u.request, d.k, d.ord, CAST(u.s * (d.ord + 3) % 201 - 100 AS INT) AS target,
               CAST(CASE WHEN (u.request + d.ord) % 7 = 0 THEN 0 ELSE u.s * (d.ord + 7) % 101 END AS INT) AS weight
        FROM user_sum u JOIN dims d ON d.grp = 'scalar'""",
    "taste_group": """
        SELECT u.request, d.grp, d.k, d.ord, CAST((u.s * (d.ord * d.ord + 3) + u.request) % 331 AS INT) AS p
        FROM user_sum u JOIN dims d ON d.grp <> 'scalar' AND (u.request + length(d.grp)) % 6 <> 0""",
    "tweak_steps": """
        SELECT request, CAST(request % 5 - 2 AS INT) AS energy, CAST(request % 3 - 1 AS INT) AS mood,
               CAST(request % 4 - 2 AS INT) AS popularity, CAST(s % 5 - 2 AS INT) AS era
        FROM user_sum""",
    "deltas": """
        SELECT u.request, d.grp, d.k, CAST((u.s + d.i * 13) % 121 - 60 AS INT) AS v
        FROM user_sum u JOIN dims d ON (u.request + d.i) % 5 = 0 AND d.grp <> 'languages'""",
    # --- playlists and personas
    "playlist_track": """
        SELECT l_orderkey AS playlist_id, l_linenumber AS pos, min(l_partkey) AS track_id
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "mix_track": """
        SELECT o_custkey AS playlist_id, l_orderkey * 8 + l_linenumber AS pos, min(l_partkey) AS track_id
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey, l_orderkey * 8 + l_linenumber""",
    "persona_cluster": """
        SELECT * FROM (VALUES ('p1', 'PROMO', CAST(1 AS DOUBLE)), ('p1', 'SMALL', CAST(0.5 AS DOUBLE)),
          ('p2', 'LARGE', CAST(1 AS DOUBLE)), ('p3', 'ECONOMY', CAST(0.75 AS DOUBLE)),
          ('p3', 'MEDIUM', CAST(1 AS DOUBLE))) AS t(persona, cluster, cw)""",
    "persona_decade": """
        SELECT * FROM (VALUES ('p1', 'dec80', CAST(1 AS DOUBLE)), ('p1', 'dec90', CAST(0.5 AS DOUBLE)),
          ('p3', 'dec00', CAST(1 AS DOUBLE))) AS t(persona, decade, dw)""",
    "persona_language": """
        SELECT * FROM (VALUES ('p2', 'lang_en', CAST(1 AS DOUBLE)), ('p2', 'none', CAST(0.5 AS DOUBLE)))
        AS t(persona, language, lw)""",
    "persona_range": """
        SELECT * FROM (VALUES ('p1', 'energy', CAST(0.25 AS DOUBLE), CAST(1 AS DOUBLE)),
          ('p1', 'valence', CAST(-1 AS DOUBLE), CAST(0 AS DOUBLE)),
          ('p3', 'tempo', CAST(-0.5 AS DOUBLE), CAST(0.5 AS DOUBLE))) AS t(persona, k, lo, hi)""",
    # --- free text
    "doc_title": """
        SELECT doc_id, source, lang,
               concat(text, CASE doc_id % 8 WHEN 0 THEN ' (Live at Town)'
                 WHEN 1 THEN ' - 2011 Remaster' WHEN 2 THEN ' feat. Ana & Bo' WHEN 3 THEN ' [Radio Edit]'
                 WHEN 4 THEN ' (Karaoke Version)' WHEN 5 THEN ' - Live, 1999' ELSE '' END) AS title
        FROM documents""",
    # --- raw catalog inputs
    "recording": """
        SELECT CAST(p_partkey AS INT) AS id, concat('r', lpad(CAST(p_partkey AS STRING), 9, '0')) AS gid,
               CASE p_partkey % 7 WHEN 0 THEN concat(p_name, ' (Live at Town)')
                    WHEN 1 THEN concat(p_name, ' - 2011 Remaster') ELSE p_name END AS name,
               CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS artist_credit,
               CAST((p_partkey * 7 + p_size) % 400 * 1000 AS INT) AS length_ms, '' AS comment
        FROM part""",
    "redirect": "SELECT concat('m', gid) AS gid, id AS new_id FROM recording WHERE id % 11 = 0",
    "canonical": """
        SELECT r.gid AS recording, c.gid AS canonical FROM recording r
        JOIN recording c ON c.id = r.id - r.id % 40 WHERE r.id % 5 = 0""",
    "listen": """
        SELECT CAST(o_custkey AS INT) AS user_id,
               concat(CASE WHEN l_partkey % 11 = 0 AND l_linenumber < 3 THEN 'mr' ELSE 'r' END,
                      lpad(CAST(l_partkey AS STRING), 9, '0')) AS gid,
               CAST(sum(l_quantity) AS BIGINT) AS listens
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 17 <> 3
        GROUP BY o_custkey, l_partkey, CASE WHEN l_partkey % 11 = 0 AND l_linenumber < 3 THEN 'mr' ELSE 'r' END""",
    "artist": """
        SELECT DISTINCT a AS id, concat('a', lpad(CAST(a AS STRING), 6, '0')) AS gid,
               CASE WHEN a = 3 THEN 'Various Artists' ELSE concat('The Act ', CAST(a AS STRING)) END AS name,
               CASE WHEN a % 6 <> 5 THEN CAST(a % 25 AS INT) END AS area
        FROM (SELECT artist_credit AS a FROM recording UNION ALL SELECT artist_credit + 100 FROM recording) x""",
    "credit_name": """
        SELECT DISTINCT artist_credit, CAST(0 AS INT) AS position, artist_credit AS artist FROM recording
        UNION ALL
        SELECT DISTINCT artist_credit, CAST(1 AS INT), artist_credit + 100 FROM recording WHERE artist_credit % 4 = 1""",
    "area_parent": """
        SELECT n_nationkey AS child, CAST(floor(n_nationkey / 2) AS INT) AS parent FROM nation WHERE n_nationkey > 0
        UNION ALL SELECT n_nationkey, CAST(floor(n_nationkey / 3) AS INT) FROM nation WHERE n_nationkey % 4 = 1""",
    "area_iso": """
        SELECT n_nationkey AS area, CASE WHEN r_name = 'ASIA' THEN 'IL' ELSE substr(r_name, 1, 2) END AS code
        FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey < 7 AND n_nationkey <> 0""",
    "medium": """
        SELECT DISTINCT CAST(l_suppkey * 2 + l_linenumber % 2 AS INT) AS id, CAST(l_suppkey AS INT) AS release
        FROM lineitem""",
    "dump_track": """
        SELECT CAST(l_partkey AS INT) AS recording, CAST(l_suppkey * 2 + l_linenumber % 2 AS INT) AS medium
        FROM lineitem""",
    "release_event": """
        SELECT CAST(l_suppkey AS INT) AS release, CASE WHEN l_orderkey % 3 <> 0
               THEN CAST(1950 + l_orderkey % 73 + l_suppkey % 20 AS INT) END AS year
        FROM lineitem""",
    "release": """
        SELECT CAST(s_suppkey AS INT) AS id, concat('e', CAST(s_suppkey AS STRING)) AS gid, s_name AS name,
               CAST(s_suppkey % 60 AS INT) AS release_group,
               CASE WHEN s_suppkey % 6 <> 0 THEN CAST(1 + s_suppkey % 4 AS INT) END AS status,
               CASE s_suppkey % 4 WHEN 0 THEN 'eng' WHEN 1 THEN 'heb' WHEN 2 THEN 'fra' END AS lang
        FROM supplier""",
    "release_group": """
        SELECT DISTINCT CAST(s_suppkey % 60 AS INT) AS id, CAST(s_suppkey % 60 % 25 AS INT) AS artist_credit
        FROM supplier""",
    "rg_secondary": """
        SELECT id AS release_group, CASE WHEN id % 3 = 0 THEN 'compilation' ELSE 'interview' END AS type
        FROM release_group WHERE id % 3 = 0 OR id % 17 = 1""",
    "rec_work": """
        SELECT DISTINCT CAST(l_partkey AS INT) AS recording, CAST(l_orderkey AS INT) AS work
        FROM lineitem WHERE l_partkey % 8 <> 2""",
    "work_lang": """
        SELECT CAST(o_orderkey AS INT) AS work,
               CASE o_orderkey % 5 WHEN 0 THEN 'heb' WHEN 1 THEN 'spa' WHEN 2 THEN 'zxx' WHEN 3 THEN 'deu'
                    ELSE 'eng' END AS lang
        FROM orders""",
    "isrc": """
        SELECT DISTINCT CAST(l_partkey AS INT) AS recording,
               concat('USABC', lpad(CAST(l_orderkey AS STRING), 7, '0')) AS isrc
        FROM lineitem WHERE l_partkey % 4 <> 2""",
    "recording_tag": """
        SELECT CAST(p_partkey AS INT) AS entity, regexp_extract(p_name, '^([a-z]+)', 1) AS tag,
               CAST(1 + p_size % 5 AS INT) AS votes FROM part WHERE p_partkey % 3 = 0""",
    "rg_tag": """
        SELECT CAST(s_suppkey % 60 AS INT) AS entity, lower(p_type) AS tag, CAST(count(*) AS INT) AS votes
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
        WHERE s_suppkey % 60 % 2 = 0 GROUP BY 1, 2""",
    "artist_tag": """
        SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS entity,
               regexp_extract(p_name, '([a-z]+)$', 1) AS tag, CAST(count(*) AS INT) AS votes
        FROM part WHERE CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 3 <> 0 GROUP BY 1, 2""",
    "tag_map": """
        SELECT * FROM (VALUES ('small', 'SMALL', 1.0), ('red', 'PROMO', 0.8), ('blue', 'ECONOMY', 0.9),
          ('hot', 'LARGE', 0.7), ('hot', 'MEDIUM', 0.3), ('large', 'LARGE', 1.0), ('economy', 'ECONOMY', 1.0),
          ('promo', 'PROMO', 1.0), ('medium', 'MEDIUM', 1.0), ('standard', 'STANDARD', 0.6),
          ('ring', 'complexity', 0.5), ('bolt', 'intensity', -0.25), ('gear', 'complexity', -0.5),
          ('gear', 'intensity', 0.75), ('widget', 'STANDARD', 0.4), ('old', 'intensity', -0.5)) AS t(tag, key, value)""",
    "tag_prior": """
        SELECT * FROM (VALUES ('SMALL', 'complexity', -0.2), ('LARGE', 'intensity', 0.3), ('PROMO', 'complexity', 0.1),
          ('ECONOMY', 'intensity', -0.15)) AS t(cluster, key, value)""",
    "tag_class": """
        SELECT * FROM (VALUES ('genre_dortmund__rock', 'LARGE', 0.8), ('genre_dortmund__pop', 'PROMO', 0.7),
          ('genre_dortmund__jazz', 'SMALL', 0.9), ('genre_rosamerica__hip', 'MEDIUM', 0.6),
          ('genre_rosamerica__cla', 'STANDARD', 1.0), ('genre_dortmund__blues', 'ECONOMY', 0.5))
        AS t(class, cluster, value)""",
    "tag_nonmusic": "SELECT * FROM (VALUES ('plate'), ('new'), ('nut')) AS t(tag)",
    "ab_hl": f"""
        SELECT CASE WHEN l_partkey % 11 = 0 THEN concat('mr', lpad(CAST(l_partkey AS STRING), 9, '0'))
                    ELSE concat('r', lpad(CAST(l_partkey AS STRING), 9, '0')) END AS mbid,
               {prob_sql()}
        FROM lineitem WHERE l_partkey % 4 <> 2""",
    "ab_rhythm": """
        SELECT concat('r', lpad(CAST(l_partkey AS STRING), 9, '0')) AS mbid,
               CAST(l_orderkey % 180 + 40 AS DOUBLE) AS bpm
        FROM lineitem WHERE l_partkey % 4 <> 2""",
    "pop_cache": """
        SELECT gid, CASE WHEN u % 9 <> 0 THEN u END AS users, CASE WHEN u % 9 <> 0 THEN 3 * u END AS listens
        FROM (SELECT gid, CAST(id * 31 % 5003 AS BIGINT) AS u FROM recording WHERE id % 3 <> 1
              UNION ALL SELECT gid, CAST(id * 17 % 4001 AS BIGINT) FROM recording WHERE id % 4 = 2) x""",
    "curated": """
        SELECT gid AS mbid, CAST(1 + id % 3 AS INT) AS tier, CAST(id AS INT) AS pos FROM artist WHERE id % 9 = 4""",
    "pins": """
        SELECT a.gid AS mbid, CAST(1 + r.id % 3 AS INT) AS k, r.name AS title
        FROM recording r JOIN artist a ON a.id = r.artist_credit WHERE r.id % 41 = 0 AND a.id % 9 = 4
        UNION ALL SELECT gid, 1, 'no such song' FROM artist WHERE id % 18 = 4""",
}

STAGE_SQL: dict[str, str] = {}
STAGES: dict[str, Callable[[Roles], DataFrame]] = {}


def stage(name: str, sql: str | None = None):
    """Register a derived stage: the function builds it in Spark, ``sql`` is its DuckDB form."""

    def keep(fn):
        if name in STAGES:
            raise ValueError(f"stage {name} is defined twice")
        STAGES[name] = fn
        if sql:
            oracle_stage(name, sql)
        return fn

    return keep


def oracle_stage(name: str, sql: str) -> None:
    if name in STAGE_SQL:
        raise ValueError(f"oracle stage {name} is defined twice")
    STAGE_SQL[name] = sql


def _named(text: str, names) -> list[str]:
    seen = dict.fromkeys(m.group(1) for m in re.finditer(r"\b(?:FROM|JOIN)\s+([a-z_][a-z_0-9]*)", text))

    return [n for n in seen if n in names]


def sql_with_roles(body: str) -> str:
    """Prefix ``body`` with the definitions of every role and stage it reads, in dependency order."""
    texts = {**ROLE_SQL, **STAGE_SQL}
    done: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in _named(text, texts):
            if name not in done:
                visit(texts[name])
                done[name] = texts[name]

    visit(body)
    body = body.strip()
    parts = [f"{n} AS ({t.strip()})" for n, t in done.items()]
    recursive = ""
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if m:
        recursive = "RECURSIVE " if m.group(1) else ""
        rest = body[m.end():]
        if not parts:
            return body
        return f"WITH {recursive}" + ",\n".join(parts) + ",\n" + rest
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


class Roles:
    """Lazily built role and stage DataFrames for one folder of tables."""

    _cache: dict[tuple, Roles] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = limit_broadcasts(tune(spark))
        self.folder = folder
        self._built: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Roles:
        key = (spark.sparkContext.applicationId, id(spark), str(folder))
        if key not in cls._cache:
            cls._cache[key] = cls(spark, str(folder))
        return cls._cache[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def _build(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in STAGES:
            return STAGES[name](self)
        if name in ROLE_SQL:
            return self._sql(ROLE_SQL[name])
        raise AttributeError(name)

    def _sql(self, text: str) -> DataFrame:
        used = _named(text, {*BASE_TABLES, *ROLE_SQL, *STAGES})
        for name in used:
            text = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", text)
        return self.spark.sql(text, **{n: getattr(self, n) for n in used}) if used else self.spark.sql(text)

    def keep(self, df: DataFrame) -> DataFrame:
        """Materialise a stage that several others read."""
        return fixed(df)
