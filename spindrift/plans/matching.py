"""Matching of candidates to canonical tracks: exact identifiers, then a scored ladder.

A title can be shared by very many tracks, so candidates are never paired with tracks.  The
score only asks which of credits, version and duration agree, so tracks are aggregated by
each of those combinations first; a candidate then looks up eight keys, of which the best
that exists is its score.  Identifiers are keys of the same kind that go before those, so one
equality join with pre-aggregated keys decides everything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.classify import ladder
from ..functions.text import VERSION_MARKERS, blank_to_null, composed_credits, first_contained, normalize_identifier, normalize_text, normalized_credits, zero_to_null

TOLERANCE_MS = 2000
#: Least points, of 100, of an automatic match.
AUTOMATIC = 93
#: Points in falling order, and whether credits, version and duration agree.
LEVELS = ((100, True, True, True), (90, True, True, False), (85, True, False, True), (75, True, False, False), (70, False, True, True), (60, False, True, False), (55, False, False, True), (45, False, False, False))
_WIDTH = 2 * TOLERANCE_MS + 1
#: Exact rules by level, before those of the score, with their points and key columns.
EXACT = ((-3, "exact_isrc", 100, ("k_isrc",)), (-2, "exact_barcode_position", 99, ("k_place",)), (-1, "exact_musicbrainz", 98, ("k_recording", "k_group")))

KINDS = ("automatic", "review", "new")
#: Rows that one task makes keys of.  A row has up to 15 keys of its own, which a task sorts.
ROWS_A_TASK = 20_000


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out by ordinal, so that no task makes keys of many more than ROWS_A_TASK rows.

    Columns of a few values compress so well that one split of a file can hold millions of
    rows, whose keys are many times its size.  Rows are counted for it, which reads `df`
    once more, without the columns that decide nothing.
    """
    n = math.ceil(df.count() / ROWS_A_TASK)
    return df.repartition(n, "ordinal") if n > 1 else df


def with_match_keys(df: DataFrame, compose: bool = True) -> DataFrame:
    """`df` with the normalised keys of a candidate or track, all prefixed with k_."""
    credits = composed_credits(F.col("credits")) if compose else F.col("credits")
    barcode = blank_to_null(F.coalesce("upc", "ean"))
    return df.withColumns(
        {
            "k_isrc": normalize_identifier(blank_to_null(F.col("isrc"))),
            "k_barcode": normalize_identifier(barcode),
            "k_position": F.concat_ws(":", zero_to_null(F.col("track_number")).cast("string"), F.coalesce("disc_number", F.lit(1)).cast("string")),
            "k_recording": blank_to_null(F.col("musicbrainz_recording_id")),
            "k_group": blank_to_null(F.col("musicbrainz_release_group_id")),
            "k_title": normalize_text(F.col("title"), compose),
            "k_credits": F.coalesce(normalized_credits(credits), F.lit("")),
        }
    ).withColumn("k_version", F.coalesce(F.col("version"), first_contained(F.col("k_title"), VERSION_MARKERS))).withColumn("k_place", F.when(zero_to_null(F.col("track_number")).isNotNull(), F.concat("k_barcode", F.lit("@"), "k_position")))


def _level_key(title: Column, credits: Column, version: Column, level: int, bucket: Column | None) -> Column:
    _, c, v, d = LEVELS[level]
    parts = [F.lit(level), title, credits if c else F.lit(None), F.coalesce(version, F.lit("\x00")) if v else F.lit(None), bucket if d else F.lit(None)]
    return F.struct(*(F.coalesce(p.cast("string"), F.lit("")).alias(f"p{k}") for k, p in enumerate(parts)))


def _exact_keys(by_release_group: bool = True) -> list[Column]:
    """The identifiers' keys, null where a row has none."""
    parts = lambda level, k: F.struct(*(p.alias(f"p{n}") for n, p in enumerate((F.lit(str(level)), F.col(k), F.lit(k), F.lit(""), F.lit("")))))
    return [F.when(F.col(k).isNotNull(), parts(level, k)) for level, _, _, keys in EXACT for k in keys if by_release_group or k != "k_group"]


def level_rows(tracks: DataFrame) -> DataFrame:
    """Tracks by each level key, with the duration where it counts."""
    bucket = F.floor(F.col("duration_ms") / _WIDTH)
    keys = [F.when(F.lit(True) if not LEVELS[k][3] else F.col("duration_ms").isNotNull(), F.struct(_level_key(F.col("k_title"), F.col("k_credits"), F.col("k_version"), k, bucket).alias("key"), (F.col("duration_ms") if LEVELS[k][3] else F.lit(None).cast("int")).alias("duration"))) for k in range(len(LEVELS))]
    keys += [F.when(k.isNotNull(), F.struct(k.alias("key"), F.lit(None).cast("int").alias("duration"))) for k in _exact_keys()]
    rows = tracks.select("ordinal", "track_id", "k_version", F.explode(F.filter(F.array(*keys), lambda x: x.isNotNull())).alias("_l"))
    return rows.select("ordinal", "track_id", "k_version", F.col("_l.key").alias("_key"), F.col("_l.duration").alias("_duration"))


def _two_first(rows: DataFrame) -> DataFrame:
    """A row for each level key and duration: its first track, and the ordinal of its second.

    Whether a candidate sees one track or several is all that counts, and it sees the tracks
    before it: two tell.  The limit of two applies before the shuffle as well, so a key that
    very many tracks share sends two rows a task.
    """
    w = Window.partitionBy("_key", "_duration").orderBy("ordinal")
    two = rows.withColumn("_rank", F.row_number().over(w)).filter("_rank <= 2")
    return two.groupBy("_key", "_duration").agg(F.min(F.struct("ordinal", "track_id", "k_version")).alias("_first"), F.max(F.when(F.col("_rank") == 2, F.col("ordinal"))).alias("_second"))


def asked_levels(candidates: DataFrame, by_release_group: bool = True) -> DataFrame:
    """(_of, _own, _key): the level keys that each candidate looks up, none for a null."""
    args = (F.col("k_title"), F.col("k_credits"), F.col("k_version"))
    d = F.col("duration_ms")
    buckets = F.when(d.isNotNull(), F.sequence(F.floor((d - TOLERANCE_MS) / _WIDTH), F.floor((d + TOLERANCE_MS) / _WIDTH))).otherwise(F.array().cast("array<bigint>"))
    in_buckets = lambda k: F.transform(buckets, lambda b: _level_key(*args, k, b))
    arrays = [in_buckets(k) if LEVELS[k][3] else F.array(_level_key(*args, k, None)) for k in range(len(LEVELS))]
    exact = F.filter(F.array(*_exact_keys(by_release_group)), lambda k: k.isNotNull())
    return candidates.select(F.col("ordinal").alias("_of"), d.alias("_own"), F.explode(F.concat(exact, *arrays)).alias("_key"))


def _by_duration(rows: DataFrame) -> DataFrame:
    """A row for each level key: its durations in order, each with its first track and the
    ordinal of its second.  A key spans one bucket, so there are at most 4,001 of them."""
    return _two_first(rows).groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_duration", "_first", "_second"))).alias("_tops"))


def _best_levels(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(ordinal, _best: level, n, first) of the best level of each candidate that has one.

    A candidate meets one row for each key it asks, whatever the number of its tracks and
    durations, and searches the durations in it; a key that very many candidates ask for is
    split by the adaptive skew join, as its other side is that one row.
    """
    near = lambda t: (t["_first"]["ordinal"] < F.col("_of")) & (t["_duration"].isNull() | (F.abs(t["_duration"] - F.col("_own")) <= TOLERANCE_MS))
    met = asked.join(_by_duration(rows), "_key").select("_of", F.col("_key.p0").cast("int").alias("level"), F.filter("_tops", near).alias("_near")).filter(F.size("_near") > 0)
    first = F.array_min(F.transform("_near", lambda t: t["_first"]))
    seen = F.size("_near") + F.size(F.filter("_near", lambda t: t["_second"] < F.col("_of")))
    # A candidate asks at most 16 keys, so all it met fit one row; a level's two buckets add up.
    hits = met.select("_of", F.struct("level", first.alias("first"), seen.alias("n")).alias("_hit")).groupBy(F.col("_of").alias("ordinal")).agg(F.collect_list("_hit").alias("_hits"))
    best = hits.withColumn("_top", F.array_min("_hits"))
    n = F.aggregate(F.filter("_hits", lambda h: h["level"] == F.col("_top.level")), F.lit(0), lambda total, h: total + h["n"])
    return best.select("ordinal", F.struct(F.col("_top.level").alias("level"), n.alias("n"), F.col("_top.first").alias("first")).alias("_best"))


def match(candidates: DataFrame, tracks: DataFrame, compose: bool = True, by_release_group: bool = True) -> DataFrame:
    """`candidates` with kind, rule, points (of 100), reasons and track_id.

    Both sides carry a total order in `ordinal`: a candidate sees only tracks with a lower
    one, and "first" means the least.  Tracks that were there before a batch have negative
    ordinals.  Rules in order: equal ISRC; equal barcode and position; equal recording or
    (unless switched off) release group; then the score of tracks with an equal title.
    """
    c, t = with_match_keys(spread(candidates), compose), with_match_keys(spread(tracks), compose)
    return match_keyed(c, asked_levels(c, by_release_group), level_rows(t), candidates.columns)


def match_keyed(c: DataFrame, asked: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The same with keys and level rows made before, for rounds over one batch."""
    c = c.join(_best_levels(asked, rows), "ordinal", "left")
    level = F.col("_best.level")
    exact = [(F.coalesce(level == n, F.lit(False)), rule, points) for n, rule, points, _ in EXACT]
    at = F.when(level >= 0, level + 1)
    points = F.element_at(F.array(*(F.lit(p) for p, *_ in LEVELS)), at)
    agree = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in LEVELS)), at)
    other = F.col("_best.first.k_version")
    conflict = F.coalesce(other != F.col("k_version"), F.lit(False))
    tied = F.col("_best.n") > 1
    sure = (points >= AUTOMATIC) & ~tied & ~conflict
    any_exact = exact[0][0] | exact[1][0] | exact[2][0]
    kind = ladder((any_exact, "automatic"), (level.isNull(), "new"), (sure, "automatic"), otherwise="review")
    rule = ladder(*((w, r) for w, r, _ in exact), (level.isNull(), "new_canonical"), (sure, "metadata"), otherwise="manual_review")
    scored = F.array(
        F.lit("Normalized titles are identical"),
        F.when(agree(1), F.lit("Canonical artist credits are identical")),
        F.when(agree(2), F.lit("Version markers agree")),
        F.when(agree(3), F.lit("Durations are within two seconds")),
        F.when(~sure, F.when(tied, F.lit("Multiple canonical tracks have the same score")).otherwise(F.lit("Score is below 0.93"))),
        F.when(~sure & conflict, F.lit("Version markers conflict")),
    )
    reasons = (
        F.when(exact[0][0], F.array(F.concat(F.lit("ISRC "), F.col("k_isrc"), F.lit(" is identical"))))
        .when(exact[1][0], F.array(F.lit("Barcode, disc, and track position are identical")))
        .when(exact[2][0], F.array(F.lit("MusicBrainz recording or release-group identifier is identical")))
        .when(level.isNull(), F.array(F.lit("No existing canonical recording has comparable metadata")))
        .otherwise(F.filter(scored, lambda r: r.isNotNull()))
    )
    return c.select(
        *columns,
        kind.alias("kind"),
        rule.alias("rule"),
        ladder(*((w, p) for w, _, p in exact), (level.isNull(), 100), otherwise=points).cast("int").alias("points"),
        reasons.alias("reasons"),
        F.col("_best.first.track_id").alias("track_id"),
    )


def confidence(points: Column) -> Column:
    return (points / F.lit(100)).cast("decimal(4,3)")
