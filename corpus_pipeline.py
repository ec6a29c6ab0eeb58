"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the result
is written as Parquet and read again as the next stage's documents.

In every stage a null text counts as the empty text, texts of any length are read whole,
null and repeated ids give rows like others, other columns are carried along whatever their
names, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import drop_stored, read, scratch, stored
from spindrift.llm.decontamination import decontaminate
from spindrift.llm.quality import quality_rules
from spindrift.llm.secrets import secret_scan
from spindrift.llm.sentencepiece_codec import sentencepiece_encode
from spindrift.llm.simhash import keep_one_of_each

#: What a secret's span is replaced by.
REDACTED = "[REDACTED]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null or empty text has no words and goes."""
    return quality_rules(docs, carry=tuple(docs.columns)).filter("kept").select("carried.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id; rows of one id
    with different texts are judged apart, equal rows are one."""
    return keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; a text without words stays."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"), carry=tuple(docs.columns)).filter(~F.col("contaminated")).select("carried.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text and its length counted again; a null
    text stays null."""
    clean = secret_scan(docs, redact_as=REDACTED, carry=tuple(c for c in docs.columns if c != "text"))
    columns = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return clean.select(*(columns[c].alias(c) if c in columns else F.col(f"carried.{c}").alias(c) for c in docs.columns))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with digests of the ids and of the text they decode to;
    none for a null or empty text.  The other columns end here."""
    coded = sentencepiece_encode(docs, public_tokenizers.path("piece_bpe_32k.model"), spans=False, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the stages before it wrote is deleted on the way."""
    docs, last = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}", keep=True)
        if last is not None:
            drop_stored(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no fingerprint of these shingles and no SentencePiece; tests hold the pipeline
#: against a brute-force version instead.
ORACLE_SQL = None
