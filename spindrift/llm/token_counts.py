"""Token counts by heap-and-linked-list byte-pair merging, without identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import PieceVocabulary
from .common import kept_by_worker, keyed_text, slices, texts_of
from .normalizer import Normalizer
from .piece_cache import ChunkCache


@kept_by_worker(2)
def _counter(model_path: str) -> tuple[PieceVocabulary, Normalizer, ChunkCache]:
    vocabulary = PieceVocabulary(model_path)
    return vocabulary, Normalizer(vocabulary), ChunkCache(vocabulary.count)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row of `docs`.

    The text is normalised as the model says and cut where no piece can reach across; in
    each cut the lowest-rank adjacent pair is popped from a heap and merged in a linked list
    until none is left.  The count is the initial symbols less the merges.  Counts of
    repeated cuts come from a bounded cache.

    Null texts count as empty: 0 bytes and 0 tokens.  Repeated rows and null ids give one
    row each; texts of any length are counted whole; an empty table gives an empty result;
    other columns of `docs` are ignored.
    The work is one pass without a shuffle.
    """
    source = keyed_text(docs, id_col, text_col)
    schema = T.StructType([source.schema[0], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens")), T.StructField("over_limit", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, normalizer, cache = _counter(model_path)
        find, known = vocabulary.chunks.findall, cache.__getitem__
        for batch in slices(batches):
            texts = texts_of(batch)
            tokens = [sum(map(known, find(normalizer.text(t)))) for t in texts]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return source.mapInArrow(count, schema)
