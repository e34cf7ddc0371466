"""Text expressions. Every function takes and returns a Column and stays inside code generation."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: these lists and patterns define the keys, so they are stated as they are ---------
VERSION_WORDS = (
    r"re-?master(?:ed)?", "live", r"feat\.?", "featuring", r"ft\.?", "radio edit", "radio version",
    "radio mix", "single version", "single edit", "album version", "mono", "stereo", "explicit",
    "clean", "bonus track", "original mix", r"\d{4} version", r"\d{4} mix",
)
SCRIPT_LANGUAGES = (("Hebrew", "heb"),)
LANGUAGE_BUCKETS = {"eng": "lang_en", "heb": "lang_he", "fra": "lang_fr", "spa": "lang_es", "zxx": "none"}
NON_MUSIC_TITLE = (
    r"\bkaraoke\b|in the style of|originally performed by|made famous by|\btribute to\b|backing track"
)
HOLIDAY_WORDS = (
    "christmas", "xmas", "x-mas", "navidad", "santa claus", "santa baby", "jingle bells?", "sleigh ride",
    "sleigh bells", "silver bells", "carol of the bells", "rudolph", "reindeer", "frosty the snowman",
    "winter wonderland", "let it snow", "silent night", "o holy night", "little drummer boy",
    "deck the halls?", "mistletoe", "holly jolly", "first noel", "hanukkah", "chanukah", "tannenbaum",
    "most wonderful time of the year", "baby,? it.s cold outside", "mary,? did you know", "o come,? all ye",
    "hark the herald", "away in a manger", "we wish you a merry", "good king wenceslas", "auld lang syne",
)
HOLIDAY_ANYWHERE = ("noël", "חנוכה", "סביבון")
CREDIT_SEPARATOR = r"(?i)\s*(?:,|;|/|&|\+|\band\b|\bfeat\.?|\bft\.|\bfeaturing\b|\bwith\b|\bvs\.?)\s*"
AUTOMATED_AGENT = r"(?i)bot\b|crawl|spider|headless|preview|facebookexternalhit"
ISRC_SHAPE = r"^[A-Z]{2}[A-Z0-9]{3}\d{7}$"
SOURCE_TAGS = ("x", "ig", "tt")
# ----------------------------------------------------------------------------------------------------

_NOISE = "|".join(VERSION_WORDS)
_IN_BRACKETS = rf"\s*[(\[][^)\]]*\b(?:{_NOISE})\b[^)\]]*[)\]]"
_AFTER_DASH = rf"\s+[-–—]\s+[^-–—]*\b(?:{_NOISE})\b.*$"
_GUEST_TAIL = r"\s+(?:feat\.?|ft\.|featuring)\s.*$"
_LIVE_TITLE = r"[(\[][^)\]]*\blive\b|\s[-–—]\s[^-–—]*\blive\b"
_HOLIDAY = rf"(?i)\b(?:{'|'.join(HOLIDAY_WORDS)})\b|{'|'.join(HOLIDAY_ANYWHERE)}"


def _accent_table() -> tuple[str, str]:
    """Precomposed letters and their base letter, generated from the Unicode decompositions."""
    composed, base = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]):
            composed.append(chr(code))
            base.append(parts[0])
    return "".join(composed), "".join(base)


_COMPOSED, _BASE = _accent_table()


def drop_accents(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, _COMPOSED, _BASE), r"\p{M}+", "")


def norm_text(s: Column) -> Column:
    """Lower case, no accents, every run of other characters than letters and digits is one space."""
    return F.trim(F.regexp_replace(F.lower(drop_accents(s)), r"[^\p{L}\p{N}]+", " "))


def strip_version(s: Column) -> Column:
    """Drop bracketed, dashed and trailing version remarks from a title."""
    steps = (_IN_BRACKETS, _AFTER_DASH, _GUEST_TAIL)
    return reduce(lambda text, pattern: F.regexp_replace(text, pattern, ""), steps, F.lower(s))


def norm_title(s: Column) -> Column:
    empty = F.lit("")
    return F.coalesce(
        F.nullif(norm_text(strip_version(s)), empty), F.nullif(norm_text(s), empty), F.lower(s)
    )


def is_live(title: Column) -> Column:
    return F.lower(title).rlike(_LIVE_TITLE)


def version_type(title: Column, comment: Column) -> Column:
    live = is_live(title) | F.lower(F.coalesce(comment, F.lit(""))).rlike(r"^live\b")
    return F.when(live, "live").otherwise("studio")


def squash(s: Column) -> Column:
    """Letters and digits only, for comparing names that differ in spacing or punctuation."""
    return F.regexp_replace(norm_text(s), " ", "")


def decade_of(year: Column) -> Column:
    """Decade key: 1950s and older share one key, 2020s and newer another."""
    start = F.greatest(F.lit(1950), F.least(F.lit(2020), F.floor(year / 10) * 10))
    return F.when(year.isNotNull(), F.concat(F.lit("dec"), F.lpad((start % 100).cast("string"), 2, "0")))


def script_lang(title: Column) -> Column:
    known = [F.when(title.rlike(rf"\p{{Is{script}}}"), F.lit(iso)) for script, iso in SCRIPT_LANGUAGES]
    return F.coalesce(*known, F.lit(None).cast("string"))


def lang_bucket(iso: Column) -> Column:
    missing = iso.isNull() | (iso == "und")
    chain = F.when(missing, F.lit("unknown"))
    for code, bucket in LANGUAGE_BUCKETS.items():
        chain = chain.when(iso == code, bucket)
    return chain.otherwise("lang_other")


def unescape_copy(s: Column) -> Column:
    r"""Undo text-dump escapes (\\, \t, \n, \r); a private-use character guards literal backslashes."""
    guard = F.lit(chr(0xE000))
    pairs = ((r"\t", "\t"), (r"\n", "\n"), (r"\r", "\r"))
    text = F.replace(s, F.lit("\\\\"), guard)
    for written, meant in pairs:
        text = F.replace(text, F.lit(written), F.lit(meant))
    return F.replace(text, guard, F.lit("\\"))


def escape_copy(s: Column) -> Column:
    text = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for written, meant in ((r"\t", "\t"), (r"\n", "\n"), (r"\r", "\r")):
        text = F.replace(text, F.lit(meant), F.lit(written))
    return text


def is_non_music_title(title: Column) -> Column:
    return F.lower(title).rlike(NON_MUSIC_TITLE)


def is_holiday_title(title: Column) -> Column:
    return title.rlike(_HOLIDAY)


def artist_key(name: Column) -> Column:
    return F.regexp_replace(norm_text(name), "^the ", "")


def credit_names(credit: Column) -> Column:
    """The whole credit and each credited name, as comparison keys."""
    parts = F.concat(F.array(credit), F.split(credit, CREDIT_SEPARATOR))
    keys = F.transform(parts, artist_key)
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) > 0))


def digits_of(s: Column) -> Column:
    """The numbers in a key; two titles match only when these agree."""
    return F.array_join(F.regexp_extract_all(s, F.lit(r"(\p{N}+)"), F.lit(1)), " ")


def similarity(a: Column, b: Column) -> Column:
    """1 − edit distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    ratio = 1 - F.levenshtein(a, b) / longer
    return F.when(a == b, F.lit(1.0)).when(F.least(F.length(a), F.length(b)) == 0, F.lit(0.0)).otherwise(ratio)


def valid_isrc(code: Column) -> Column:
    return F.upper(code).rlike(ISRC_SHAPE)


def one_line(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"[\r\n\t]+", " "))


def xml_text(s: Column) -> Column:
    """Escape for XML 1.0; characters it forbids even when escaped are removed."""
    text = F.regexp_replace(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def clean_display(s: Column, limit: int) -> Column:
    """Control characters and outer quotes removed, cut to ``limit`` on a word where possible."""
    text = F.trim(F.regexp_replace(F.regexp_replace(s, r"[\x00-\x1F\x7F-\x9F]", " "), r"\s+", " "))
    text = F.trim(F.regexp_replace(text, "^[\"'“”‘’«»]+|[\"'“”‘’«»]+$", ""))
    head = F.substring(text, 1, limit - 1)
    # Length of the head up to its last space, 0 without one.
    word_end = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    cut = F.when(word_end > limit / 2, F.substring(head, F.lit(1), word_end)).otherwise(head)
    shown = F.when(F.length(text) > limit, F.concat(F.rtrim(cut), F.lit("…"))).otherwise(text)
    return F.nullif(shown, F.lit(""))


def slug(title: Column, fallback: str = "playlist", limit: int = 60) -> Column:
    text = F.regexp_replace(F.lower(drop_accents(title)), "[^a-z0-9]+", "-")
    text = F.regexp_replace(F.substring(text, 1, limit), "^-+|-+$", "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(fallback))


def csv_field(value: Column) -> Column:
    """A CSV cell: formula starts are disarmed, and the cell is quoted where the format needs it."""
    safe = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(safe.rlike(r'[",\r\n]|^\s|\s$'), quoted).otherwise(safe)


def short_link_tag(path: Column) -> Column:
    name = F.lower(F.regexp_replace(path, "^/|/$", ""))
    return F.when(name.isin(*SOURCE_TAGS), name)


def looks_like_visit(method: Column, mode: Column, agent: Column) -> Column:
    """A page navigation by something that does not call itself a bot."""
    navigates = (method == "GET") & (mode == "navigate")
    return F.coalesce(navigates & (F.length(agent) > 0) & ~agent.rlike(AUTOMATED_AGENT), F.lit(False))


def client_key(address: Column) -> Column:
    """Rate-limit key of an address: IPv4 as it is (also when IPv6-mapped), IPv6 by its /64 network."""
    plain = F.lower(F.regexp_replace(address, "%.*$", ""))
    mapped = F.regexp_extract(plain, r"^::ffff:(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    sides = F.split(plain, "::")
    groups = lambda s: F.when(F.coalesce(s, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(s, ":")
    )
    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    gap = F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))
    whole = F.when(F.size(sides) > 1, F.concat(left, F.array_repeat(F.lit("0"), gap), right)).otherwise(left)
    network = F.transform(F.slice(whole, 1, 4), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
    return (
        F.when(mapped != "", mapped)
        .when(~plain.contains(":"), plain)
        .otherwise(F.concat(F.array_join(network, ":"), F.lit("::/64")))
    )


def utc_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def utc_hour(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH")


def hash_bucket(key: Column, n: int) -> Column:
    """Stable bucket of a key: 28 bits of its md5, modulo ``n``."""
    return F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long") % n


def seed_of(*parts: Column) -> Column:
    """16 hex digits over the given parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def follow_up_seed(seed: Column, what: str, n: Column) -> Column:
    return F.substring(F.sha2(F.concat(seed, F.lit(f":{what}:"), n.cast("string")), 256), 1, 16)


def uniform_draw(*parts: Column) -> Column:
    """A repeatable number in (0, 1) from the md5 of the parts (52 bits)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)
