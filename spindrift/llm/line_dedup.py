"""Removal of lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, stored
from .hot_join import join_by_weight

#: White space that a key loses at both ends.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _without(lines: Column, dropped: Column) -> Column:
    """The lines between the positions of `dropped`, which are in order, joined again: one
    slice for each run of lines that stay, so the work is linear in the lines."""
    size = F.size(dropped)

    def run(ls: Column, k: Column) -> Column:
        first = F.when(k == 0, F.lit(0)).otherwise(F.get(dropped, k - 1) + 1)
        end = F.when(k == size, F.size(ls)).otherwise(F.get(dropped, k))
        return F.slice(ls, first + 1, end - first)

    # The outer lambda binds the split once for all runs.
    runs = F.transform(F.array(lines), lambda ls: F.flatten(F.transform(F.sequence(F.lit(0), size), lambda k: run(ls, k))))
    return F.array_join(F.get(runs, 0), "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, n_lines, n_dropped, kept): texts without the lines that many documents share.

    Lines are what stands between line feeds.  A line's key is the line without white space
    at its ends and with A-Z in lower case.  A key of `min_chars` code points or more that is
    found in `min_docs` documents or more loses all its lines, except in the document with
    the largest id that holds it.  `n_lines` counts before dropping.

    Lines are exploded and hashed (128 bits of SHA-256), documents are counted for each
    hash by partial aggregates, and only hashes and positions are shuffled for the verdict:
    each line meets it in a join that broadcasts the few hot keys.  Texts are moved once, to
    meet the positions they lose.

    A null or empty text is one empty line.  Documents are told apart by id: rows of one id
    count once and are judged alike, and all rows without an id count as one document, which
    comes before all others.  Texts of any length are read whole; an empty table gives an
    empty one; other columns are ignored.
    """
    source = keyed_text(docs, id_col, text_col).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    source = source.withColumn("_print", F.xxhash64("_text"))
    split = F.split("_text", "\n", -1)
    folded = F.split(F.translate("_text", UPPER, LOWER), "\n", -1)
    lines = source.select("_id", "_print", F.posexplode(folded).alias("_at", "_line")).withColumn("_line", F.btrim("_line", F.lit(BLANKS)))
    lines = lines.filter(F.char_length("_line") >= min_chars).select("_id", "_print", "_at", F.substring(F.unhex(F.sha2("_line", 256)), 1, 16).alias("_key"))

    # Keys of too few documents stand here as well if many lines have them, so that every
    # frequent key is known to the join.
    by_document = lines.groupBy("_key", "_id").agg(F.count("*").alias("_n"))
    keys = by_document.groupBy("_key").agg(F.sum("_n").alias("_n_lines"), (F.count("*") >= min_docs).alias("_shared"), F.max("_id").alias("_keeper"))
    verdicts = stored(keys.filter(F.col("_n_lines") >= min_docs), "line-verdicts")

    judged = join_by_weight(lines, verdicts, ["_key"], "_n_lines", ["_id", "_print", "_at"])
    doomed = judged.filter(F.col("_shared") & ~F.col("_id").eqNullSafe(F.col("_keeper")))
    dropped = doomed.groupBy(F.col("_id").alias("_of"), F.col("_print").alias("_its")).agg(F.sort_array(F.collect_set("_at")).alias("_dropped"))
    met = source.join(dropped, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_print") == F.col("_its")), "left")
    return met.select(
        F.col("_id").alias(id_col),
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_dropped").isNull(), F.col("_text")).otherwise(_without(split, F.col("_dropped"))).alias("kept"),
    )
