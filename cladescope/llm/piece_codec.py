"""SentencePiece encoding with original byte spans, and decoding.

The library yields the ids. The spans come from our own normaliser: it walks the
text by the longest prefix that the model's compiled character map knows, and
records for every normalised byte the offset of the source it came from. A
piece's normalised bytes then project to a span of the original bytes.

Each executor process loads the model once; rows are independent, so there is no
shuffle and a lost executor costs its own tasks only. Memory is bounded by one
Arrow batch (and by a text's size: texts are never cut).

Defined cases: a null text counts as empty, an empty text has no ids and decodes
to the empty text; other columns are ignored (clashing names don't matter);
repeated rows and null ids give a row each; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladescope.llm.common import lean
from cladescope.llm.textscan import slices

# Fixed values of the SentencePiece model format.
SPACE_SYMBOL = "▁".encode()
# Fields of the model: its normaliser, and there the character map, whether a blank is
# put first, whether extra blanks go, and whether blanks are written as the symbol.
NORMALIZER, SETTINGS = 3, (2, 3, 4, 5)
REPLACEMENT = "�".encode()


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 bytes and a table of replacements.

    Layout: 32-bit little-endian size of the trie, the trie's 32-bit units, then
    NUL-terminated replacement strings that the trie's values point into.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``data[at:]`` and what replaces it."""
        units, found, n = self.units, None, len(self.units)
        if not n:
            return None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= n:
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        start = found[1]
        return found[0], self.replacements[start : self.replacements.index(b"\0", start)]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class Normalizer:
    """Normalised bytes of a text, and the source offset of each (one more for the end)."""

    def __init__(self, blob: bytes, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.map, self.dummy_prefix, self.squeeze = CharacterMap(blob), dummy_prefix, squeeze
        self.space = SPACE_SYMBOL if escape else b" "

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if self.map.units or self.squeeze:
            return self._walk(data)
        if not data:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        at = np.arange(len(raw))
        first = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, at, 0))
        lead = len(self.space) * self.dummy_prefix
        back = np.repeat(first, np.where(raw == 32, len(self.space), 1))
        return self.space * self.dummy_prefix + data.replace(b" ", self.space), np.concatenate([np.zeros(lead, np.int64), back, [len(raw)]])

    def _walk(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, back, at, blank = bytearray(), [], 0, self.squeeze
        body = False
        while at < len(data):
            size, text = self._step(data, at)
            if blank:
                text = text.lstrip(b" ")
            if text and not body:
                body = True
                if self.dummy_prefix:
                    out += self.space
                    back += [at] * len(self.space)
            piece = text.replace(b" ", self.space)
            out += piece
            back += [at] * len(piece)
            if text:
                blank = self.squeeze and text.endswith(b" ")
            at += size
        end = len(data)
        while self.squeeze and out.endswith(self.space) and len(out) > 0:
            del out[-len(self.space) :]
            end = back[-len(self.space)]
            del back[-len(self.space) :]
        return bytes(out), np.array([*back, end], np.int64)

    def _step(self, data: bytes, at: int) -> tuple[int, bytes]:
        if hit := self.map.longest(data, at):
            return hit
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, data[at : at + size]


def _fields(message: bytes):
    """(number, value) of a message's fields: numbers or bytes."""

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    at = 0
    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size = number()
            yield key >> 3, message[at : at + size]
            at += size


def normalizer_spec(model: bytes) -> dict:
    """The normaliser's settings from the model's bytes, without objects for its pieces."""
    spec = dict(_fields(next((v for k, v in _fields(model) if k == NORMALIZER), b"")))
    blob, *flags = (spec.get(k, default) for k, default in zip(SETTINGS, (b"", 1, 1, 1)))
    return dict(zip(("blob", "dummy_prefix", "squeeze", "escape"), (blob, *map(bool, flags))))


class PieceCodec:
    """One loaded model: ids, spans in original bytes, and the decoded text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = Normalizer(**normalizer_spec(library.serialized_model_proto()))
        ids = list(range(library.get_piece_size()))
        self.sizes = np.array([1 if library.is_byte(i) else -1 if library.is_unknown(i) else len(p.encode()) for i, p in zip(ids, library.id_to_piece(ids))])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every piece in the bytes of ``text``."""
        normal, back = self.normalize(text.encode())
        sizes = self.sizes[ids]
        if (sizes < 0).any() or sizes.sum() != len(normal):  # unknown pieces: their surfaces tell the size
            proto = self.library.encode(text, return_type="proto")
            sizes = np.array([self.sizes[p.id] if self.sizes[p.id] >= 0 else len(p.piece.encode()) for p in proto.pieces], np.int64)
        ends = np.minimum(np.cumsum(sizes), len(normal))
        starts = np.minimum(ends - sizes, len(normal))
        return back[starts], back[ends]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)))


#: Characters of text encoded at once; a longer text is encoded alone.
CHUNK = 1 << 18


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, ids, starts and ends (byte spans in the text), decoded.

    ``path`` is the model file's place on every executor (a fixed, small file
    that is installed with the environment).
    """

    def run(batches):
        model = codec(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for begin, end in slices(texts, CHUNK):
                part = texts[begin:end]
                ids = model.encode(part)
                arrays = [np.array(x, np.int32) for x in ids]
                spans = [model.spans(t, a) for t, a in zip(part, arrays)]
                yield pa.record_batch(
                    [batch.column("doc_id").slice(begin, end - begin), _lists(arrays), _lists([s for s, _ in spans]), _lists([e for _, e in spans]), pa.array([model.decode(x) for x in ids], pa.string())],
                    names=["doc_id", "ids", "starts", "ends", "decoded"],
                )

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return slim.mapInArrow(lean(run), "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string")


def with_digests(encoded: DataFrame) -> DataFrame:
    """The ids of each row, where they stand in the text's bytes, and their digests."""
    return encoded.select("doc_id", "ids", "starts", "ends", *digest_columns())


def digest_columns() -> list[Column]:
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("starts", "ends").alias("spans_hash"),
    ]


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_hash (of the pieces' byte spans)."""
    return encoded.select("doc_id", *digest_columns())
