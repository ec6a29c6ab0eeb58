"""Scoring of proposed artists and the choice between mapping and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import normalize_text


def artist_score(name: Column, aliases: Column, found_name: Column, found_aliases: Column, source_score: Column, disambiguation: Column, compose: bool = True) -> Column:
    """(millis, reasons): a score of at most 1000 thousandths, as integers, so that equal
    scores are equal; half a thousandth rounds up."""
    plain = lambda c: normalize_text(c, compose=False)
    accepted = F.concat(F.array(normalize_text(name, compose)), F.transform(F.coalesce(aliases, F.array().cast("array<string>")), plain))
    exact = F.array_contains(accepted, normalize_text(found_name, compose))
    by_alias = F.arrays_overlap(accepted, F.transform(F.coalesce(found_aliases, F.array().cast("array<string>")), plain))
    known = F.coalesce(disambiguation, F.lit("")) != ""
    points = F.floor((source_score * 9 + 1) / 2) + F.when(exact, 400).otherwise(0) + F.when(by_alias, 100).otherwise(0) + F.when(known, 20).otherwise(0)
    reasons = F.array(
        F.concat(F.lit("MusicBrainz search score is "), source_score.cast("string")),
        F.when(exact, F.lit("Canonical name or user alias is exact")),
        F.when(by_alias, F.lit("MusicBrainz alias matches a canonical name or user alias")),
        F.when(known, F.concat(F.lit("Disambiguation is available: "), disambiguation)),
    )
    return F.struct(F.least(points, F.lit(1000)).cast("long").alias("millis"), F.filter(reasons, lambda r: r.isNotNull()).alias("reasons"))


def map_or_propose(scored: DataFrame, by: list[str], position: str, millis: str, threshold: int = 970, gap: int = 80, most: int = 5) -> DataFrame:
    """Results to act on, with `outcome`: the first one mapped, or the first few proposed.

    The order is that of the source, not of the scores: the first result is mapped if it
    reaches the threshold and the second, if any, is `gap` or more below it.
    """
    w = Window.partitionBy(*by).orderBy(position)
    ranked = scored.withColumns({"_rank": F.row_number().over(w), "_second": F.lead(millis).over(w)})
    sure = (F.col("_rank") == 1) & (F.col(millis) >= threshold) & (F.col("_second").isNull() | (F.col(millis) - F.col("_second") >= gap))
    ranked = ranked.withColumn("_mapped", F.max(sure.cast("int")).over(Window.partitionBy(*by)) == 1)
    kept = ranked.filter((F.col("_mapped") & (F.col("_rank") == 1)) | (~F.col("_mapped") & (F.col("_rank") <= most)))
    return kept.withColumn("outcome", F.when(F.col("_mapped"), F.lit("mapped")).otherwise(F.lit("proposed"))).drop("_rank", "_second", "_mapped")
