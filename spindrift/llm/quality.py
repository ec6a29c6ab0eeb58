"""Quality rules: counts, repetition, and divergence from language references."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, forget, keyed_text, slices, stored

#: Words per language in the histograms; a last bin counts all other words.
N_COMMON = 24
#: Code points of the longest word that can be one of them.
COMMON_LENGTH = 32
#: A language has a reference of its own from this part of the usable documents on, so there
#: are at most as many of these, and one more for all other languages.
MAX_LANGUAGES = 256
#: That of all other languages, and of an empty or null one: character classes only.
OTHER = ""
#: Words that a task counts before it hands its counts on.
COUNTED_WORDS = 80_000
#: Character classes in histogram order; the last takes every character beyond ASCII.
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "beyond")
MARKS = b".,;:!?'\"()-"
SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"

_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[list(SPACES)], _CLASS[list(MARKS)] = 3, 4
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 7, 6  # a character beyond ASCII counts at its first byte
_FOLLOWING = bytes(range(0x80, 0xC0))
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(5)], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside any 5-word window that occurs at least twice, first ones included."""
    n = len(words) - 4
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = sum((h[k : k + n] * _POWERS[k] for k in range(1, 5)), h[:n])
    in_order = np.sort(keys)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return 0
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    at = np.flatnonzero(twice[place] == keys).tolist()
    # Equal hashes are a shortlist; the words themselves decide.
    windows = [tuple(words[i : i + 5]) for i in at]
    times = Counter(windows)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at, windows):
        if times[w] > 1:
            edge[i] += 1
            edge[i + 5] -= 1
    return int((np.cumsum(edge) > 0).sum())


def _counts(text: bytes) -> tuple:
    """Words, characters in words, symbols, repeated lines, repeated words; character classes."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    words = text.split()
    return (
        len(words),
        len(text.translate(None, _FOLLOWING + SPACES)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)[:7],
    )


def _common(text: bytes, bins: dict[bytes, int] | None) -> np.ndarray:
    if not bins:
        return np.zeros(N_COMMON + 1, np.int64)
    return np.bincount(np.fromiter(map(bins.get, text.lower().split(), repeat(N_COMMON)), np.int64), minlength=N_COMMON + 1)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()


@dataclass(frozen=True)
class Reference:
    """What the usable documents of a language look like: sums of their character classes,
    its common words, most widespread first, and how often these and all others occur."""

    lang: str
    classes: list[int]
    words: list[str] = field(default_factory=list)
    common: list[int] = field(default_factory=lambda: [0] * (N_COMMON + 1))


def language_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, min_words: int, max_repeat_percent: int) -> DataFrame:
    """Counts over the documents that pass the base rules, added up in each task: rows
    (lang, word, n_docs, n_times), and with a null word a language's documents, words and
    sums of character classes.

    A task hands its counts on after COUNTED_WORDS words of its own vocabulary, so its memory
    is bounded by these and one slice of texts.
    """
    schema = "lang string, word string, n_docs long, n_times long, classes array<long>"

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        times: dict[str, Counter] = {}
        spread: dict[str, Counter] = {}
        wholes: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            while wholes:  # a language's counts go when they are handed on
                lang, whole = wholes.popitem()
                n_times, n_with = times.pop(lang), spread.pop(lang)
                words = [w for w in n_times if len(w) <= COMMON_LENGTH or len(w) <= 4 * COMMON_LENGTH and len(w.decode()) <= COMMON_LENGTH]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (len(words) + 1), pa.string()),
                        pa.array([None, *words], pa.binary()).cast(pa.string()),
                        pa.array([int(whole[0]), *map(n_with.__getitem__, words)], pa.int64()),
                        pa.array([int(whole[1]), *map(n_times.__getitem__, words)], pa.int64()),
                        pa.array([whole[2:], *repeat(None, len(words))], pa.list_(pa.int64())),
                    ],
                    names=["lang", "word", "n_docs", "n_times", "classes"],
                )

        for batch in slices(batches):
            for text, lang in zip(_texts(batch), batch.column(2).to_pylist()):
                n_words, _, _, _, n_repeat_words, classes = _counts(text)
                if n_words < min_words or 100 * n_repeat_words > max_repeat_percent * n_words:
                    continue
                words = text.lower().split()
                times.setdefault(lang, Counter()).update(words)
                spread.setdefault(lang, Counter()).update(set(words))
                wholes[lang] = wholes.get(lang, 0) + np.array([1, n_words, *classes], np.int64)
            if sum(map(len, times.values())) > COUNTED_WORDS:
                yield from rows()
        yield from rows()

    source = keyed_text(docs, id_col, text_col, F.coalesce(F.col(lang_col).cast("string"), F.lit(OTHER)).alias("lang"))
    return source.mapInArrow(counts, schema)


def language_references(counts: DataFrame, min_language_docs: int, min_common_percent: int) -> list[Reference]:
    """The references over `language_counts`: at most MAX_LANGUAGES and one for the rest.

    Common words of a language are the N_COMMON words that most of its documents have, ties
    in order of the words.  They are ranked in each task before they are exchanged, so one
    language may have most of all words.  A language of fewer than `min_language_docs`
    documents, or whose common words are less than `min_common_percent` of its words (as
    where spaces do not part words), has none.  What comes to the driver are the references.
    """
    sums = [F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(len(CLASSES))]
    langs = counts.filter("word IS NULL").groupBy("lang").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_times").alias("n_words"), *sums)
    n_docs = langs.agg(F.sum("n_docs")).first()[0] or 0
    is_large = (F.col("n_docs") * MAX_LANGUAGES >= n_docs) & (F.col("lang") != OTHER)
    large = {r.lang: r for r in langs.filter(is_large).collect()}
    rest = langs.filter(~is_large).agg(*(F.sum(f"c{k}") for k in range(len(CLASSES)))).first()
    out = [] if rest[0] is None else [Reference(OTHER, list(rest))]
    worded = [g for g, r in large.items() if r.n_docs >= min_language_docs]
    spread = counts.filter(F.col("word").isNotNull() & F.col("lang").isin(worded)).groupBy("lang", "word").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_times").alias("n_times"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_docs"), "word"))
    top = spread.withColumn("place", rank).filter(F.col("place") <= N_COMMON).collect() if worded else []
    for lang, r in large.items():
        classes = [r[f"c{k}"] for k in range(len(CLASSES))]
        words = sorted((t for t in top if t.lang == lang), key=lambda t: t.place)
        known = sum(t.n_times for t in words)
        if not words or 100 * known < min_common_percent * r.n_words:
            out.append(Reference(lang, classes))
            continue
        times = [t.n_times for t in words] + [0] * (N_COMMON - len(words))
        out.append(Reference(lang, classes, [t.word for t in words], [*times, r.n_words - known]))
    return out


def document_features(docs: DataFrame, references: list[Reference], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """The id column, the reference language, the base counts and both histograms, and
    `carried`, a struct of the columns named in `carry`, if any."""
    carried = [F.struct(*carry).alias("carried")] if carry else []
    source = keyed_text(docs, id_col, text_col, F.col(lang_col).cast("string").alias("lang"), *carried)
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType(
        [
            source.schema[0],
            T.StructField("reference", T.StringType()),
            *(T.StructField(n, T.LongType()) for n in numbers),
            T.StructField("classes", T.ArrayType(T.LongType())),
            T.StructField("common", T.ArrayType(T.LongType())),
            *source.schema.fields[3:],
        ]
    )
    bins = {r.lang: {w.encode(): i for i, w in enumerate(r.words)} for r in references}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            langs = [g if g in bins else OTHER for g in batch.column(2).to_pylist()]
            rows = [(*_counts(t), _common(t, bins.get(g))) for t, g in zip(_texts(batch), langs)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(langs, pa.string()),
                    *(pa.array([r[k] for r in rows], pa.int64()) for k in range(5)),
                    *(pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (5, 6)),
                    *batch.columns[3:],
                ],
                names=schema.names,
            )

    return source.mapInArrow(features, schema)


def total(counts: Column) -> Column:
    return F.nullif(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def jensen_shannon(counts: Column, reference: Column, n: Column, n_reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, from 0 to 1) of two arrays of counts; null where
    either is empty.  `n` and `n_reference` are their totals, as columns of their own: within
    the lambda they would be added up again for each element."""
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    parts = F.zip_with(counts, reference, lambda x, y: 0.5 * (term(x / n, (x / n + y / n_reference) / 2) + term(y / n_reference, (x / n + y / n_reference) / 2)))
    distance = F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))
    return F.when(n.isNotNull() & n_reference.isNotNull(), distance)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    min_class_chars: int = 200,
    min_common_words: int = 100,
    max_class_distance: float = 0.3,
    max_common_share: float = 0.9,
    min_language_docs: int = 50,
    min_common_percent: int = 10,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Judge each document by counts and by its distance from its language.

    Returns the id column, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, `class_distance`, `common_distance`, `rejected_by` (array of rule names),
    kept and `carried`, a struct of the columns named in `carry`, if any.

    References are the character-class and common-word histograms of each language, summed
    over all documents that pass the base rules, so nothing is sampled; the common words of a
    language are learned from the same documents (`language_references`).  A document is
    rejected if its Jensen-Shannon distance from a reference exceeds the limit: a distance
    for character classes, and for common words a share of the distance that a text without
    any common word has from the same reference, which is the most a text can reach by
    lacking them (some 0.34 where common words make up a fifth of a language).  The guards
    leave out documents with fewer than `min_class_chars` non-space characters or
    `min_common_words` words, for which a histogram says little, and common words of
    languages with too few documents or no words that are common.  Languages of less than
    1 / MAX_LANGUAGES of the usable documents are held together against the characters of
    all such documents, and against no words.

    Null texts are empty: no words, rejected by the base rules.  Texts of any length are
    counted whole.  A null language counts as an empty one, which has no words.  Repeated
    rows and null ids give a row each; an empty table gives an empty result; other columns
    are ignored.  Texts are read twice: for the references, whose counts by task are written
    to the shared folder, and for the verdicts.  Only the references are broadcast, at most
    MAX_LANGUAGES + 1 rows.
    """
    spark = docs.sparkSession
    counts = stored(language_counts(docs, id_col, text_col, lang_col, min_words, max_repeat_percent), "quality")
    found = language_references(counts, min_language_docs, min_common_percent)
    drop_stored(counts)
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    lacking = F.array(*(F.lit(int(k == N_COMMON)).cast("long") for k in range(N_COMMON + 1)))
    references = spark.createDataFrame([(r.lang, r.classes, r.common) for r in found], "reference string, ref_classes array<long>, ref_common array<long>")
    references = F.broadcast(references.withColumn("reach", jensen_shannon(lacking, F.col("ref_common"), F.lit(1.0), total(F.col("ref_common")))))
    judged = document_features(docs, found, id_col, text_col, lang_col, carry)
    judged = judged.join(references, "reference", "left").withColumns({f"n_{c}": total(F.col(c)) for c in ("classes", "common", "ref_classes", "ref_common")})
    distance = lambda c: jensen_shannon(F.col(c), F.col(f"ref_{c}"), F.col(f"n_{c}"), F.col(f"n_ref_{c}"))
    too_far = lambda name, limit: F.coalesce(F.col(name) > limit, F.lit(False))
    rules = F.array(
        F.when(F.col("n_words") < min_words, F.lit("min_words")),
        F.when(100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"), F.lit("repeat_words")),
        F.when(too_far("class_distance", max_class_distance), F.lit("class_distance")),
        F.when(F.coalesce(F.col("common_distance") > max_common_share * F.col("reach"), F.lit(False)), F.lit("common_distance")),
    )
    return (
        judged.withColumn("class_distance", F.when(F.col("word_chars") >= min_class_chars, distance("classes")))
        .withColumn("common_distance", F.when(F.col("n_words") >= min_common_words, distance("common")))
        .withColumn("rejected_by", F.filter(rules, lambda r: r.isNotNull()))
        .select(
            id_col,
            *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
            base_failed.alias("base_failed"),
            "class_distance",
            "common_distance",
            "rejected_by",
            (F.size("rejected_by") == 0).alias("kept"),
            *(["carried"] if carry else []),
        )
    )
