"""SentencePiece encoding with byte offsets, and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import BYTE, CONTROL, SPACE, PieceVocabulary
from .common import kept_by_worker, keyed_text, slices, texts_of
from .normalizer import Normalizer
from .piece_cache import ChunkCache

#: Chunks in each of a codec's two generations, some 300 bytes each.
CACHED_CHUNKS = 200_000


class Codec:
    """Encoder and decoder of one model, kept by each Python worker."""

    def __init__(self, model_path: str):
        self.vocabulary = v = PieceVocabulary(model_path)
        self.normalizer = Normalizer(v)
        self.cache = ChunkCache(self._encode_chunk, CACHED_CHUNKS)
        self.is_byte = np.array([k == BYTE for k in v.kinds])
        byte_of = {i: bytes([b]) for b, i in v.byte_ids.items()}
        self.surface = [byte_of[i] if k == BYTE else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(v.pieces, v.kinds))]
        self.surface[v.unknown_id] = " ⁇ ".encode()

    def _encode_chunk(self, chunk: str) -> bytes:
        """Rows (id, start, end) of int32; positions are normalised characters of the chunk
        if there is a character map, else UTF-8 bytes with a space mark as one byte."""
        rows = self.vocabulary.encode(chunk)
        if self.normalizer.plain:
            at = [0]
            for c in chunk:
                at.append(at[-1] + (1 if c == SPACE else len(c.encode())))
            rows = [(i, at[a], at[b]) for i, a, b in rows]
            size = at[-1]
        else:
            size = len(chunk)
        return np.array([*rows, (-1, size, 0)], np.int32).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first byte, end byte in the original text) of the pieces of a text.

        The mark of the dummy prefix has no source, so a first piece starts at byte 0.
        """
        normalizer = self.normalizer
        plain = normalizer.plain and not (SPACE in text and normalizer.escape)
        if plain:
            normal = normalizer.text(text)
        else:
            normal, first, last = normalizer.aligned(text)
        raw = b"".join(map(self.cache.__getitem__, self.vocabulary.chunks.findall(normal)))
        rows = np.frombuffer(raw, np.int32).reshape(-1, 3)
        ids, starts, ends = rows[:, 0], rows[:, 1], rows[:, 2]
        closing = ids < 0
        base = np.cumsum(np.where(closing, starts, 0)) - np.where(closing, starts, 0)
        keep = ~closing
        ids, starts, ends = ids[keep], (starts + base)[keep], (ends + base)[keep]
        if plain:
            if normalizer.prefix:
                starts, ends = np.maximum(starts - 1, 0), ends - 1
            return ids, starts, ends
        if normalizer.plain:  # spaces and literal marks count one byte above: go through characters
            width = np.array([0, *(1 if c == SPACE else len(c.encode()) for c in normal)]).cumsum()
            starts, ends = np.searchsorted(width, starts), np.searchsorted(width, ends)
        return ids, np.array(first, np.int64)[starts], np.array(last, np.int64)[ends - 1]

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids: marks become spaces, one leading mark is dropped, byte
        pieces are joined to characters, and each byte of an invalid run becomes U+FFFD."""
        if not len(ids):
            return ""
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = self._decode_runs(ids)
        if self.normalizer.prefix or self.normalizer.squeeze:
            head = next((i for i in ids.tolist() if self.vocabulary.kinds[i] != CONTROL), None)
            if head is not None and self.vocabulary.pieces[head].startswith(SPACE):
                text = text[1:]
        return text

    def _decode_runs(self, ids: np.ndarray) -> str:
        out, at, flags = [], 0, self.is_byte[ids]
        while at < len(ids):
            end = at
            while end < len(ids) and flags[end] == flags[at]:
                end += 1
            data = b"".join(self.surface[i] for i in ids[at:end].tolist())
            while data:
                try:
                    out.append(data.decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(data[: e.start].decode() + "�")
                    data = data[e.start + 1 :]
            at = end
        return "".join(out)


@kept_by_worker(2)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype())))


def sentencepiece_encode(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    spans: bool = True,
    decoded: bool = False,
) -> DataFrame:
    """Encode each text as the public library does, and optionally decode it again.

    Returns the id column, `ids` array<int>; with `spans` also `starts` and `ends`
    array<int>, the byte range of the original text behind each piece (byte pieces of one
    character share its range); with `decoded` also the text that the ids decode to.

    Normalisation takes the longest prefix in the model's compiled character map and
    records its source, pieces are merged per cut of the normalised text that no piece can
    span, and each piece is projected back through the recorded alignment.

    Null and empty texts give empty arrays and an empty decoded text.  Repeated rows and
    null ids give a row each; texts of any length are encoded whole; an empty table gives an
    empty result; other columns are ignored.  One pass, no shuffle.
    """
    source = keyed_text(docs, id_col, text_col)
    array = T.ArrayType(T.IntegerType())
    names = ["ids", *["starts", "ends"] * spans]
    fields = [source.schema[0], *(T.StructField(n, array) for n in names)]
    if decoded:
        fields.append(T.StructField("decoded", T.StringType()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in slices(batches, 1 << 20):
            rows = [own.encode(t) for t in texts_of(batch)]
            out = [batch.column(0), *(_lists([r[k] for r in rows], pa.int32()) for k in range(len(names)))]
            if decoded:
                out.append(pa.array([own.decode(r[0]) for r in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return source.mapInArrow(encode, T.StructType(fields))


def sentencepiece_decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of each row's piece ids; a null list decodes to the empty text."""
    source = encoded.select(id_col, ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            texts = [own.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return source.mapInArrow(decode, T.StructType([source.schema[0], T.StructField("decoded", T.StringType())]))
