"""DuckDB fragments the oracle texts share."""

from cratewise.functions.features import CERTAINTY_CLASSES, GENRE_CLASSES, PROBABILITIES
from cratewise.functions.text import VERSION_WORDS

_NOISE = "|".join(VERSION_WORDS)


def norm(e: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({e})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def strip(e: str) -> str:
    out = f"regexp_replace(lower({e}), '\\s*[(\\[][^)\\]]*\\b(?:{_NOISE})\\b[^)\\]]*[)\\]]', '', 'g')"
    out = f"regexp_replace({out}, '\\s+[-–—]\\s+[^-–—]*\\b(?:{_NOISE})\\b.*$', '', 'g')"
    return f"regexp_replace({out}, '\\s+(?:feat\\.?|ft\\.|featuring)\\s.*$', '', 'g')"


def title_key(e: str) -> str:
    return f"coalesce(nullif({norm(strip(e))}, ''), nullif({norm(e)}, ''), lower({e}))"


def version(e: str) -> str:
    return f"CASE WHEN regexp_matches(lower({e}), '[(\\[][^)\\]]*\\blive\\b|\\s[-–—]\\s[^-–—]*\\blive\\b') THEN 'live' ELSE 'studio' END"


def decade(y: str) -> str:
    return (
        f"CASE WHEN {y} IS NOT NULL THEN 'dec' || lpad(CAST(greatest(1950, least(2020, {y} // 10 * 10)) % 100 AS VARCHAR), 2, '0') END"
    )


def mean_columns(total: str = "n") -> str:
    return ", ".join(f"CAST(sum({p}) AS DOUBLE) / sum({total}) AS {p}" for p in PROBABILITIES)


def sum_columns(source: str = "") -> str:
    return ", ".join(f"sum(CAST({source}{p} AS DECIMAL(12,5))) AS {p}" for p in PROBABILITIES)


CERTAINTY = "(" + " + ".join(f"abs(2 * {p} - 1)" for p in CERTAINTY_CLASSES) + f") / {len(CERTAINTY_CLASSES)}"
GENRE_LIST = ", ".join(GENRE_CLASSES)
