"""Feature axes, confidences and display labels as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the audio vocabulary and its constants -------------------------------------------
CLASSIFIERS = {
    "danceability": ("danceable",),
    "mood_happy": ("happy",),
    "mood_sad": ("sad",),
    "mood_relaxed": ("relaxed",),
    "mood_party": ("party",),
    "mood_aggressive": ("aggressive",),
    "mood_acoustic": ("acoustic",),
    "mood_electronic": ("electronic",),
    "voice_instrumental": ("voice",),
    "genre_dortmund": (
        "alternative", "blues", "electronic", "folkcountry", "funksoulrnb", "jazz", "pop", "raphiphop", "rock",
    ),
    "genre_rosamerica": ("cla", "dan", "hip", "jaz", "pop", "rhy", "roc", "spe"),
}
SCALARS = ("energy", "valence", "dance", "acoustic", "intensity", "tempo", "mainstream", "vocal", "complexity")
AUDIO_DIMS = ("energy", "valence", "dance", "acoustic", "intensity", "tempo", "vocal")
SCALED_DIMS = (*AUDIO_DIMS, "complexity")
DECADES = ("dec50", "dec60", "dec70", "dec80", "dec90", "dec00", "dec10", "dec20")
LANGUAGES = ("lang_en", "lang_he", "lang_fr", "lang_es", "lang_other")
FAST_CLUSTERS = ("edm", "house_techno", "dance_pop", "punk", "metal", "funk_disco", "kpop")
SLOW_CLUSTERS = ("hiphop", "rnb_soul", "reggae", "chill_ambient", "soundtrack", "classical", "folk", "blues")
CLUSTER_LABELS = {
    "classic_rock": "Classic Rock", "alt_indie": "Alt & Indie", "metal": "Metal", "punk": "Punk", "pop": "Pop",
    "dance_pop": "Dance Pop", "hiphop": "Hip-Hop", "rnb_soul": "R&B & Soul", "funk_disco": "Funk & Disco",
    "house_techno": "House & Techno", "edm": "EDM", "chill_ambient": "Chill & Ambient",
    "synth_newwave": "Synth & New Wave", "folk": "Folk", "country": "Country", "blues": "Blues", "jazz": "Jazz",
    "classical": "Classical", "soundtrack": "Soundtrack", "reggae": "Reggae", "latin": "Latin", "world": "World",
    "mizrahi": "Mizrahi", "kpop": "K-Pop",
}
LANGUAGE_LABELS = {
    "lang_en": "English", "lang_he": "Hebrew", "lang_fr": "French", "lang_es": "Spanish",
    "lang_other": "Other languages",
}
#: scalar → (name, low end, high end)
SCALAR_LABELS = {
    "energy": ("Energy", "Calm", "Energetic"), "valence": ("Mood", "Dark", "Bright"),
    "dance": ("Dance", "Still", "Danceable"), "acoustic": ("Texture", "Electric", "Organic"),
    "intensity": ("Intensity", "Gentle", "Intense"), "tempo": ("Tempo", "Slow", "Fast"),
    "mainstream": ("Popularity", "Deep cuts", "Hits"), "vocal": ("Vocals", "Instrumental", "Vocal"),
    "complexity": ("Complexity", "Simple", "Complex"),
}
# ----------------------------------------------------------------------------------------------------

#: The 26 probability columns, ``<classifier>__<class>``.
PROBABILITIES = tuple(f"{c}__{k}" for c, classes in CLASSIFIERS.items() for k in classes)
#: Genre classes used when a song has no tags (speech is not a genre).
GENRE_CLASSES = tuple(p for p in PROBABILITIES if p.startswith("genre_") and not p.endswith("__spe"))
#: The mood, dance and voice classes whose certainty feeds the confidence.
CERTAINTY_CLASSES = tuple(p for p in PROBABILITIES if not p.startswith("genre_"))


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def corrected_bpm(
    bpm: Column, cluster: Column, fast: tuple = FAST_CLUSTERS, slow: tuple = SLOW_CLUSTERS
) -> Column:
    """Undo half-time detections in fast genres and double-time ones in slow genres."""
    return (
        F.when((bpm < 70) & cluster.isin(*fast), bpm * 2)
        .when((bpm > 165) & cluster.isin(*slow), bpm / 2)
        .otherwise(bpm)
    )


def tempo_axis(bpm: Column, cluster: Column, **genres) -> Column:
    """60 bpm → −1, 180 bpm → +1; null without a bpm."""
    return F.when(bpm.isNotNull(), clamp((corrected_bpm(bpm, cluster, **genres) - 120) / 60))


def raw_dims(p) -> dict[str, Column]:
    """Raw axes from mean class probabilities; ``p(name)`` gives the column of a class."""
    both_ways = lambda x: 2 * x - 1
    aggressive = p("mood_aggressive__aggressive")
    calmness, party = p("mood_relaxed__relaxed"), p("mood_party__party")
    return {
        "energy": both_ways(0.4 * (1 - calmness) + 0.3 * party + 0.3 * aggressive),
        "valence": p("mood_happy__happy") - p("mood_sad__sad"),
        "dance": both_ways(p("danceability__danceable")),
        "acoustic": p("mood_acoustic__acoustic") - p("mood_electronic__electronic"),
        "intensity": both_ways(aggressive),
        "vocal": both_ways(p("voice_instrumental__voice")),
    }


def certainty(p) -> Column:
    """How far the base classifiers are from undecided, on average."""
    return reduce(add, [F.abs(2 * p(c) - 1) for c in CERTAINTY_CLASSES]) / len(CERTAINTY_CLASSES)


def feature_confidence(source: Column, sure: Column, has_artist: Column) -> Column:
    direct = 0.75 + 0.25 * sure
    return (
        F.when(source == "ab_direct", direct)
        .when(source == "ab_sibling", 0.8 * direct)
        .when(has_artist > 0, F.lit(0.6))
        .otherwise(F.lit(0.45))
    )


def readable_key(key: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(key, "_+", " ")))


def label_of(key: Column, labels: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), readable_key(key))


def decade_start(key: Column) -> Column:
    """First year of a decade key; two digits from 50 up are 19xx."""
    digits = F.nullif(F.regexp_extract(key, r"^dec(\d\d)$", 1), F.lit("")).cast("int")
    return F.when(digits >= 50, 1900 + digits).otherwise(2000 + digits)


def decade_label(key: Column) -> Column:
    start = decade_start(key)
    text = F.when(start >= 2000, start).otherwise(start % 100).cast("string")
    return F.coalesce(F.concat(text, F.lit("s")), readable_key(key))
