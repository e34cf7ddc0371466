"""Joins the catalog needs beyond plain equality: redirects, hierarchies, siblings, fuzzy matches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cratewise.functions.text import digits_of, similarity, squash
from cratewise.session import fixed


def resolve_redirects(current: DataFrame, redirects: DataFrame, canonical: DataFrame) -> DataFrame:
    """(recording, canon): follow the canonical id through merged ids; lowest target wins, else itself.

    ``current``: gid, id. ``redirects``: gid, new_id. ``canonical``: recording gid, canonical gid.
    """
    ids = current.select("gid", "id").unionByName(redirects.select("gid", F.col("new_id").alias("id")))
    targets = (
        canonical.join(ids.withColumnsRenamed({"gid": "canonical", "id": "target"}), "canonical")
        .groupBy("recording").agg(F.min("target").alias("target"))
        .withColumnRenamed("recording", "gid")
    )
    return current.join(targets, "gid", "left").select(
        F.col("id").alias("recording"), F.coalesce("target", "id").alias("canon")
    )


def nearest_label(nodes: DataFrame, parents: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label) of the nearest labelled node upward, ties by label; a labelled node ends its walk.

    ``nodes``: node. ``parents``: child, parent. ``labels``: node, label. Walks end where nothing new is met, so any
    depth is reached and cycles stop.
    """
    marks = fixed(labels.groupBy(F.col("node").alias("_at")).agg(F.min("label").alias("_label")))
    up = parents.select(F.col("child").alias("_at"), F.col("parent").alias("_next"))
    front = fixed(nodes.select("node", F.col("node").alias("_at")).distinct())
    met, hits, depth = front, None, 0
    while not front.isEmpty():
        step = front.join(marks, "_at", "left")
        found = step.where("_label is not null").select("node", F.lit(depth).alias("_depth"), "_label")
        hits = found if hits is None else hits.unionByName(found)
        above = step.where("_label is null").join(up, "_at").select("node", F.col("_next").alias("_at")).distinct()
        front = fixed(above.join(met, ["node", "_at"], "left_anti"))
        met = met.unionByName(front)
        depth += 1
    if hits is None:
        return marks.select(F.col("_at").alias("node"), F.col("_label").alias("label")).limit(0)
    return hits.groupBy("node").agg(F.min_by("_label", F.struct("_depth", "_label")).alias("label"))


#: Recordings that a light key has at most; a heavier one is summed by classes.
HEAVY_KEY = 64


def sibling_totals(
    song_keys: DataFrame, own: DataFrame, keys: DataFrame, values: DataFrame, measures: dict[str, Column],
    split: tuple[str, ...] = (), heavy_key: int = HEAVY_KEY,
) -> DataFrame:
    """Sums over the distinct recordings that share a key with a song; heavy keys list no pairs.

    Through light keys, of ``heavy_key`` recordings at most, a song meets recordings one by one. Through heavy ones it meets
    classes: recordings with the same set of heavy keys, however different their light keys are, are summed once, and a song
    adds up the classes that have one of its keys. What it meets both ways counts by its class alone. Its own recordings are
    taken back out.
    ``song_keys``: song, key. ``own``: song, recording. ``keys``: recording, key. ``values``: recording plus
    columns. ``measures``: output name → expression summed over ``values`` rows (whole numbers or decimals),
    per value of the ``split`` columns.
    """
    sums = [F.sum(c).alias(n) for n, c in measures.items()]
    keys = fixed(keys.join(song_keys.select("key").distinct(), "key", "left_semi").distinct())
    values = fixed(values.join(keys.select("recording").distinct(), "recording", "left_semi"))
    counted = keys.join(values.select("recording").distinct(), "recording", "left_semi")
    heavy = fixed(counted.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > heavy_key).select("key"))
    asked = song_keys.distinct()
    light = asked.join(counted, "key").join(heavy, "key", "left_anti").select("song", "recording").distinct()
    class_of = fixed(counted.join(heavy, "key").groupBy("recording").agg(F.array_sort(F.collect_set("key")).alias("heavy_keys")))
    by_key = class_of.select("heavy_keys").distinct().select(F.explode("heavy_keys").alias("key"), "heavy_keys")
    touched = fixed(asked.join(by_key, "key").select("song", "heavy_keys").distinct())
    classes = values.join(class_of, "recording").groupBy("heavy_keys", *split).agg(*sums)
    one_by_one = light.join(class_of, "recording", "left").join(touched, ["song", "heavy_keys"], "left_anti").select("song", "recording")
    # Own recordings count only where the song reaches them.
    reachable = own.join(keys, "recording").join(song_keys, ["song", "key"], "left_semi").select("song", "recording").distinct()
    parts = [
        touched.join(classes, "heavy_keys").select("song", *split, *measures),
        one_by_one.join(values, "recording").groupBy("song", *split).agg(*sums),
        reachable.join(values, "recording").groupBy("song", *split).agg(*sums).select("song", *split, *[(-F.col(n)).alias(n) for n in measures]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("song", *split).agg(*[F.sum(n).alias(n) for n in measures])


def contains_match(queries: DataFrame, tracks: DataFrame) -> DataFrame:
    """(query, track_id): equal squashed title, and the track's artist contains the query's artist.

    ``queries``: query, artist, title. ``tracks``: track_id, artist, title_key.
    """
    wanted = queries.select("query", squash(F.col("artist")).alias("_qa"), squash(F.col("title")).alias("_t"))
    have = tracks.select("track_id", squash(F.col("artist")).alias("_a"), squash(F.col("title_key")).alias("_t"))
    return (
        wanted.distinct().join(have, "_t").where(F.contains("_a", "_qa"))
        .select("query", "track_id").distinct()
    )


def gram_sizes(threshold: float) -> list[int]:
    """Letters of a chunk by length class; the last entry holds for all longer classes.

    A class is a step of the logarithm to the base 1/threshold, so that similar strings are in the same or the next class.
    A string of n letters may take d edits (with the longest string that it can be similar to); cut into chunks of the size
    of its class it has more than d chunks. 0: strings of the class take no edit.
    """
    most = lambda n: math.floor((1 - threshold) * n / threshold + 1e-9)
    always = math.ceil(threshold / (1 - threshold) - 1e-9) - 1
    # From this length on, chunks of ``always`` letters are enough for every string.
    settled = math.ceil(always / max(1 - always * (1 - threshold) / threshold, 1e-9)) + 2
    sizes: dict[int, int] = {}
    for n in range(1, min(settled, 5_000) + 1):
        k, fits = length_class(n, threshold), n // (most(n) + 1) if most(n) else 0
        sizes[k] = min(sizes.get(k) or fits, fits) if fits else sizes.get(k, 0)
    last = max(sizes)
    return [sizes.get(k, 0) for k in range(last)] + [min(always, sizes[last] or always)]


def length_class(n: int, threshold: float) -> int:
    return math.floor(math.log(n) / math.log(1 / threshold) + 1e-9)


def similar_pairs(
    left: DataFrame, right: DataFrame, block: list[str], value: str, threshold: float = 0.85
) -> DataFrame:
    """(block…, left value, right value, sim) for all pairs with similarity ≥ threshold (above one half) and equal numbers.

    Exact chunk filter: an edit spoils one chunk of a string at most, so that of d+1 chunks of the left string one stands in
    the right one, shifted by d letters at most. Left strings give d+1 chunks, right strings their grams of the chunk sizes of
    the three length classes around theirs: rows in proportion to the string. Pairs meet by an equality join on (class, chunk)
    and are compared once their lengths and places fit. Equal values are joined directly.
    """
    l = left.select(*block, F.col(value).alias("lv")).where(F.length("lv") > 0).distinct()
    r = right.select(*block, F.col(value).alias("rv")).where(F.length("rv") > 0).distinct()
    same = l.join(r.withColumn("lv", F.col("rv")), [*block, "lv"]).select(*block, "lv", "rv", F.lit(1.0).alias("sim"))

    sizes = gram_sizes(threshold)
    listed = F.array(*[F.lit(q) for q in sizes])
    size_of = lambda k: F.when(k < 0, 0).otherwise(F.get(listed, F.least(k, F.lit(len(sizes) - 1))))
    edits_of = lambda longer: F.floor((1 - threshold) * longer + 1e-9).cast("int")

    def classed(df: DataFrame, name: str, n: str) -> DataFrame:
        d = df.withColumns({"digits": digits_of(F.col(name)), n: F.length(name)})
        return d.withColumn("class", F.floor(F.log(F.col(n)) / math.log(1 / threshold) + 1e-9).cast("int"))

    chunk = lambda name, start, size: F.struct(start.alias("at"), F.substring(F.col(name), start + 1, size).alias("text"))
    lefts = classed(l, "lv", "ln").withColumn("size", size_of(F.col("class"))).withColumn("edits", F.floor((1 - threshold) * F.col("ln") / threshold + 1e-9).cast("int"))
    lefts = lefts.where("edits > 0").withColumn("c", F.explode(F.transform(F.sequence(F.lit(0), F.col("edits")), lambda i: chunk("lv", i * F.col("size"), F.col("size")))))
    rights = classed(r, "rv", "rn").withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    rights = rights.withColumn("size", size_of(F.col("class"))).where("size > 0 AND rn >= size")
    rights = rights.withColumn("c", F.explode(F.transform(F.sequence(F.lit(0), F.col("rn") - F.col("size")), lambda i: chunk("rv", i, F.col("size")))))

    keys = [*block, "digits", "class", "text"]
    ours = lefts.select(*block, "digits", "class", F.col("c.text").alias("text"), F.col("c.at").alias("la"), "ln", "lv")
    theirs = rights.select(*block, "digits", "class", F.col("c.text").alias("text"), F.col("c.at").alias("ra"), "rn", "rv")
    most = edits_of(F.greatest("ln", "rn"))
    fits = (F.abs(F.col("ln") - F.col("rn")) <= most) & (F.abs(F.col("la") - F.col("ra")) <= most) & (F.col("lv") != F.col("rv"))
    found = ours.join(theirs, keys).where(fits).select(*block, "lv", "rv").distinct()
    near = found.withColumn("sim", similarity(F.col("lv"), F.col("rv"))).where(F.col("sim") >= threshold - 1e-12)
    return same.unionByName(near)


def match_entities(
    left: DataFrame, right: DataFrame, threshold: float = 0.85, fuzzy_artists: bool = True, max_codes: int | None = None
) -> DataFrame:
    """(left_id, right_id, via) best counterpart of every left track.

    A shared code wins, a track's codes in order (the first ``max_codes`` alone, where given). Otherwise titles must reach the
    threshold with equal numbers, an artist name must match (also by threshold), and a studio track is not
    swapped for a live one. Both sides: id, k (title key), artists (name keys), codes, live.
    """
    lcodes = left.select("left_id", F.posexplode(F.slice("codes", 1, max_codes) if max_codes else F.col("codes")).alias("_at", "code"))
    rcodes = right.select("right_id", F.explode("codes").alias("code")).groupBy("code").agg(F.min("right_id").alias("right_id"))
    by_code = (
        lcodes.join(rcodes, "code").groupBy("left_id").agg(F.min_by("right_id", "_at").alias("right_id"))
        .withColumn("via", F.lit("isrc"))
    )
    rest = left.join(by_code, "left_id", "left_anti")
    lnames = rest.select("left_id", "k", "live", F.explode("artists").alias("artist"))
    rnames = right.select("right_id", "k", "live", F.explode("artists").alias("artist"))
    if fuzzy_artists:
        # Resolve left names to right names first; everything after is equality on the right name.
        names = similar_pairs(lnames, rnames, [], "artist", threshold).select(F.col("lv").alias("artist"), F.col("rv").alias("_to"))
        lnames = lnames.join(names, "artist").select("left_id", "k", "live", F.col("_to").alias("artist"))
    pairs = similar_pairs(lnames, rnames, ["artist"], "k", threshold)
    # The best right track per (artist, title key, live) stands for its equals, so equal titles never multiply.
    offers = rnames.groupBy("artist", F.col("k").alias("rv"), "live").agg(F.min("right_id").alias("right_id"))
    offered = pairs.join(offers, ["artist", "rv"]).groupBy("artist", "lv").agg(
        *[F.min(F.when(cond, F.struct(-F.col("sim"), F.col("right_id")))).alias(name)
          for name, cond in (("any_", F.lit(True)), ("studio", ~F.col("live")))]
    )
    chosen = F.when(F.col("live"), F.col("any_")).otherwise(F.col("studio"))
    best = (
        lnames.join(offered.withColumnRenamed("lv", "k"), ["artist", "k"])
        .withColumn("_c", chosen).where("_c is not null").groupBy("left_id").agg(F.min("_c").alias("_c"))
    )
    by_text = best.select("left_id", F.col("_c.right_id").alias("right_id"), F.lit("search").alias("via"))
    return by_code.select("left_id", "right_id", "via").unionByName(by_text)
