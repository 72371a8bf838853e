"""Token-id shards with Elias-Fano document boundaries.

Documents are dealt by ranges of doc_id, so that shards hold consecutive runs of
the corpus; each task encodes its run and writes shards. A shard is one binary
record: a header, the concatenated ids as little-endian 32-bit integers, and the
document boundaries in Elias-Fano form: the low bits packed, the high bits in
unary, and the select directory, of 32 bits for every STEP boundaries. A boundary
costs about 2 + log2(ids / documents) bits instead of the 64 of an offset table;
readers take offsets by select, a block of the high bits at a time. Shards are rows of a Parquet table in
the shared folder, since executors reach shared storage through Spark only.

Encoding is exact and local to words: with this pre-tokeniser every match starts
at a single space that stands between two non-spaces, so the pieces between such
places are encoded by the library on their own, each distinct piece once a task
while it stays in the bounded cache. Texts that hold one of the library's added
tokens are encoded by the library itself.

Defined cases: a null text is empty, a document without tokens still has the end
id; a null doc_id sorts first; rows of equal id are ordered by their texts; an
empty table gives no shards and an empty result; extra columns are ignored. A
text longer than a shard's share makes a shard of its own.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladescope.llm.common import lean, materialize

#: Ids after which a shard is closed, and pieces that a process keeps encoded (with a batch's words a dict of 2**20 places).
SHARD_IDS, CACHE = 1 << 18, 640_000
#: Set bits between two entries of the select directory.
STEP = 256
HEADER = struct.Struct("<4sIQQB3xII")  # magic, version, documents, ids, low bits, bytes of low bits, bytes of high bits
# Fixed value: the pre-tokeniser's pattern, for ASCII.
_MATCH = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+""", re.ASCII)
MAGIC, VERSION = b"EFID", 2
#: Stands for a line end before a word that it belongs to; no printable text holds it.
LINE_END = "\0"
#: Writers of so many ids.
_PACK = [struct.Struct(f"<{k}I").pack for k in range(16)]


class EliasFano:
    """A non-decreasing sequence of n integers up to u, with select by position.

    The directory holds the bit position of every STEP-th set bit, so a value is
    found by reading one block of the high bits, and nothing is kept per value.
    """

    def __init__(self, n: int, width: int, low: bytes, high: bytes, directory: bytes):
        self.n, self.width = n, width
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.directory = np.frombuffer(directory, "<u4")

    @staticmethod
    def build(values: np.ndarray, u: int) -> "EliasFano":
        n = len(values)
        width = max(0, (max(u, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1) if width else np.zeros((n, 0), np.uint64)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        return EliasFano(n, width, low, np.packbits(unary, bitorder="little").tobytes(), places[::STEP].astype("<u4").tobytes())

    def _block(self, j: int, count: int) -> np.ndarray:
        """Bit positions of the first ``count`` set bits from directory entry ``j`` on, in its block."""
        begin = int(self.directory[j])
        end = int(self.directory[j + 1]) if j + 1 < len(self.directory) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin // 8 : (end + 7) // 8], bitorder="little")
        return np.flatnonzero(bits[begin % 8 :])[:count] + begin

    def select(self, k: int) -> int:
        """The k-th value, from 0."""
        at = int(self._block(k // STEP, k % STEP + 1)[-1])
        return (at - k << self.width) | int(self._low(k, 1)[0])

    def _low(self, k: int, count: int) -> np.ndarray:
        if not self.width:
            return np.zeros(count, np.int64)
        begin, end = k * self.width, (k + count) * self.width
        bits = np.unpackbits(self.low[begin // 8 : (end + 7) // 8], bitorder="little")[begin % 8 :][: end - begin]
        return (bits.reshape(count, self.width).astype(np.int64) << np.arange(self.width)).sum(1)

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """Position of each block's first value, and the values that select returns there, a block at a time."""
        for j in range(len(self.directory)):
            first = j * STEP
            count = min(STEP, self.n - first)
            places = self._block(j, count) - np.arange(first, first + count)
            yield first, places << self.width | self._low(first, count)


def write_shard(documents: list[bytes]) -> bytes:
    """A shard of documents, each the bytes of its ids (32-bit little-endian)."""
    ends = np.cumsum([len(d) // 4 for d in documents])
    total = int(ends[-1]) if len(ends) else 0
    ef = EliasFano.build(ends, total)
    low, high, directory = ef.low.tobytes(), ef.high.tobytes(), ef.directory.tobytes()
    return HEADER.pack(MAGIC, VERSION, len(documents), total, ef.width, len(low), len(high)) + directory + low + high + b"".join(documents)


class Shard:
    """Reader of a shard; boundaries and ids come from its bytes alone."""

    def __init__(self, blob: bytes):
        magic, version, self.n, self.total, width, low, high = HEADER.unpack_from(blob)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a shard of token ids")
        ends = np.cumsum([HEADER.size, 4 * -(-self.n // STEP), low, high]).tolist()
        directory, low, high = (blob[a:b] for a, b in zip(ends, ends[1:]))
        self.ends = EliasFano(self.n, width, low, high, directory)
        self.ids = memoryview(blob)[ends[-1] :]

    def bounds(self, k: int) -> tuple[int, int]:
        return self.ends.select(k - 1) if k else 0, self.ends.select(k)

    def document(self, k: int) -> np.ndarray:
        begin, end = self.bounds(k)
        return np.frombuffer(self.ids[4 * begin : 4 * end], "<u4")

    def documents(self) -> Iterator[tuple[int, int, memoryview]]:
        """(begin, number of ids, their bytes) of all documents in turn."""
        begin = 0
        for _, ends in self.ends.blocks():
            for end in ends.tolist():
                yield begin, end - begin, self.ids[4 * begin : 4 * end]
                begin = end


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PieceEncoder(dict):
    """word -> bytes of the ids of a blank and the word, encoded when first met; ``older`` is the generation before.

    Pieces without the leading blank are in ``bare``.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.tokenize = self.library.model.tokenize
        self.letters = _byte_letters()
        self.blank = self.letters[32]
        self.older: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    @staticmethod
    def simple(text: str) -> bool:
        """Whether every blank of ``text`` stands between two characters that aren't white space."""
        if not text or text[0] == " " or text[-1] == " " or "  " in text:
            return False
        if text.isprintable():
            return True  # no other white space
        return " \n" not in text and "\n " not in text and text.replace("\n", "").isprintable()

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Parts that the pre-tokeniser never joins: cut before a blank between two characters that aren't white space."""
        out: list[str] = []
        for i, part in enumerate(text.split(" ")):
            piece = " " + part if i else part
            if i and (not part or part[0].isspace() or not out[-1] or out[-1][-1].isspace()):
                out[-1] += piece
            else:
                out.append(piece)
        return out

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        if len(self) > CACHE:
            self.older = dict(self)
            self.clear()
        if len(self.bare) > CACHE // 4:
            self.bare.clear()
        get, out = self.__getitem__, []
        for text in texts:
            if any(m in text for m in self.marks):
                out.append(array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes() + end)
            elif self.simple(text):
                # a line end between two words goes with the second one, so that both are known from elsewhere
                words = iter((text.replace("\n", " " + LINE_END) if "\n" in text and "\n\n" not in text else text).split(" "))
                out.append(self._piece(next(words)) + b"".join(map(get, words)) + end)
            else:
                out.append(b"".join(map(self._piece, self.pieces(text))) + end)
        return out

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if word.isalpha():
                ids = self._model(self.blank + (word if word.isascii() else self._spell(word)))
            elif word[:1] == LINE_END:  # see encode
                ids = self._piece("\n") + self._piece(word[1:])
            elif word[-1:] in (",", ".") and word[:-1].isalpha():
                met = word[:-1] in self
                ids = self[word[:-1]] + self._piece(word[-1])
                if not met:  # a rare word with its comma isn't worth a place
                    return ids
            else:
                ids = self._fresh(" " + word)
        self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        if piece[:1] == " ":
            return self[piece[1:]] if piece[1:2] != LINE_END else self._fresh(piece)
        ids = self.bare.get(piece)
        if ids is None:
            ids = self.bare[piece] = self._fresh(piece) if piece else b""
        return ids

    def _fresh(self, piece: str) -> bytes:
        """Matches of the pre-tokeniser are encoded by the model, spelled in its letters.

        A word is one match, and so is a comma or full stop after it; ASCII pieces
        are matched by the pre-tokeniser's own pattern; the library does the rest.
        """
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha():
            return self._one(piece)
        if word[-1:] in (",", ".") and word[:-1].isalpha():
            return self._piece(piece[:-1]) + self._piece(word[-1])
        if piece.isascii():
            matches = _MATCH.findall(piece)
            return self._one(piece) if len(matches) == 1 else b"".join(map(self._piece, matches))
        return array("I", self.library.encode(piece, add_special_tokens=False).ids).tobytes()

    def _one(self, match: str) -> bytes:
        return self._model(self._spell(match))

    def _spell(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.letters)

    def _model(self, spelled: str) -> bytes:
        """Ids of one match."""
        ids = [t.id for t in self.tokenize(spelled)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else array("I", ids).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """The process's encoder; collections of garbage, of which every task of ``lean`` has one, don't go through its words."""
    made = PieceEncoder(path)
    gc.freeze()
    return made


def write_shards(docs: DataFrame, path: str, end_id: int = 2, label: str = "id-shards") -> DataFrame:
    """Encode ``docs`` in ascending doc_id order and write shards; returns the table that holds them.

    Rows: first_id, part, seq (order of the shards), doc_ids, n_ids, shard.
    """
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    parts = max(slim.sparkSession.sparkContext.defaultParallelism, int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = slim.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        rows: list[bytes] = []
        held = 0

        def shard():
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.int64()), pa.array([write_shard(rows)], pa.binary())],
                names=["part", "seq", "doc_ids", "n_ids", "shard"],
            )

        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                cut = batch.slice(begin, 512)
                for i, row in zip(cut.column("doc_id").to_pylist(), model.encode(cut.column("text").to_pylist(), end)):
                    if rows and held + len(row) // 4 > SHARD_IDS:
                        yield shard()
                        ids, rows, held, seq = [], [], 0, seq + 1
                    ids.append(i)
                    rows.append(row)
                    held += len(row) // 4
        if rows:
            yield shard()

    return materialize(ordered.mapInArrow(run, "part int, seq int, doc_ids array<long>, n_ids long, shard binary"), label)


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the shards' bytes: doc_id, start, n_tokens, ids_crc32.

    Offsets of shards are running sums over one small row per shard, within each
    part and over the parts' totals; the shards themselves are read in place.
    """
    def run(batches):
        for batch in batches:
            for part, seq, doc_ids, blob in zip(*(batch.column(c) for c in ("part", "seq", "doc_ids", "shard"))):
                shard = Shard(blob.as_py())
                begins, sizes, crc = zip(*((begin, n, zlib.crc32(ids)) for begin, n, ids in shard.documents())) if shard.n else ((), (), ())
                yield pa.record_batch(
                    [pa.repeat(part, shard.n), pa.repeat(seq, shard.n), doc_ids.values, pa.array(begins, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "begin", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "seq", "doc_ids", "shard").mapInArrow(lean(run), "part int, seq int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy(F.col("part").alias("p")).agg(F.sum("n_ids").alias("n")).withColumn("before_part", F.coalesce(F.sum("n").over(over), F.lit(0)))
    starts = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("before_seq")).join(parts, F.col("part") == F.col("p"))
    starts = starts.select("part", "seq", (F.col("before_part") + F.col("before_seq")).alias("before"))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
