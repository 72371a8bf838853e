"""Encodings against the libraries themselves, round trips of the shard format."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladescope.llm import id_shards, piece_codec
from cladescope.llm.queries import op8_id_shards, tokenizer_path

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  two  spaces ", "a\n\nb \n c", "tab\tand\x0b\x0c\r\n", "naïve 日本語 🙂 don't it's", "x" * 5000, "<|endoftext|> end", "a b" * 3000, " nbsp  em", "same", "same", "\x1c sep \x85 nel"]


def odd(spark, extra=False):
    rows = [(i if i != 3 else None, t, "x", "y") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, part string")


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_shards_equal_the_library(spark, whole, table):
    docs = odd(spark) if table == "odd" else spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in id_shards.read_shards(id_shards.write_shards(docs, tokenizer_path("byte_bpe_50k.json"))).collect()}
    start, want = 0, {}
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id, start] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_words_equal_the_library_in_any_surroundings(whole):
    """Short texts of all kinds of neighbours, by the cached words and by the library."""
    rng = np.random.default_rng(0)
    parts = ["word", "Word", "éa", "日本", "x1", "12", "don't", "'s", ",", ".", "!?", "\"", "-", "\n", "\n\n", " ", " ", " ", "\t", "\0", "<|endoftext|>"]
    model = id_shards.PieceEncoder(tokenizer_path("byte_bpe_50k.json"))
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts) - 1, rng.integers(1, 10))) for _ in range(4000)]
    texts += ["".join(parts[i] for i in rng.integers(0, len(parts), 6)) for _ in range(300)]
    texts += ["a.\nB c,\nD", "\nA b", "a b\n", "a\n\nb c", "a.\n,b c", "x, y. z,, w.."]
    for text, ids in zip(texts, model.encode(texts, b"")):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_query_matches_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = ["before", f"a {mark} b", mark, f"{mark}{mark}", f"x{mark}y  {mark}\n", f"don't {mark[:-1]} é {mark}z", "after", *[t or "" for t in ODD]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    start, want = 0, []
    for i, t in enumerate(texts):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert library.encode(texts[1], add_special_tokens=False).ids == [64, 220, 50256, 275]
    assert sorted(tuple(r) for r in op8_id_shards(spark, str(tmp_path)).collect()) == want


def test_empty_table(spark):
    docs = odd(spark).limit(0)
    assert id_shards.read_shards(id_shards.write_shards(docs, tokenizer_path("byte_bpe_50k.json"))).count() == 0
    assert piece_codec.digests(piece_codec.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 3000])
def test_elias_fano(n):
    sizes = np.random.default_rng(n).integers(0, 900, n)
    sizes[n // 2 :: 7] = 0
    ends = np.cumsum(sizes)
    shard = id_shards.Shard(id_shards.write_shard([np.full(k, 7, "<u4").tobytes() for k in sizes]))
    assert [v for _, block in shard.ends.blocks() for v in block.tolist()] == ends.tolist()
    assert [(len(ids) // 4, begin) for begin, _, ids in shard.documents()] == list(zip(sizes.tolist(), [0, *ends.tolist()]))
    assert [shard.ends.select(k) for k in range(n)] == ends.tolist()
    assert all(len(shard.document(k)) == sizes[k] for k in range(n))
    if n > 100:
        bits = 8 * (shard.ends.low.nbytes + shard.ends.high.nbytes + shard.ends.directory.nbytes) / n
        assert bits < 2.5 + np.log2(ends[-1] / n) + 64 / id_shards.STEP
    # nothing is kept for each boundary
    assert shard.ends.directory.nbytes == 4 * -(-n // id_shards.STEP) and all(np.asarray(v).nbytes < 8 * max(n, 100) for v in vars(shard.ends).values())


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_pieces_equal_the_library(spark, table):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    docs = odd(spark) if table == "odd" else spark.read.parquet(f"{SMALL}/documents.parquet")
    encoded = piece_codec.encode_documents(docs, tokenizer_path("piece_bpe_32k.model")).cache()
    texts = sorted((r.text or "") for r in docs.collect())
    want = sorted((len(i := model.encode(t)), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(model.decode(i).encode()).hexdigest()) for t in texts)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_codec.digests(encoded).collect()) == want
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in encoded.collect():
        proto = model.encode(known[r.doc_id], return_type="proto")
        assert [(p.begin, p.end) for p in proto.pieces] == list(zip(r.starts, r.ends))
    spans = {r.doc_id: r.spans_hash for r in piece_codec.digests(encoded).collect()}
    moved = encoded.withColumn("ends", F.transform("ends", lambda x: x + 1))
    assert all(r.spans_hash != spans[r.doc_id] for r in piece_codec.digests(moved).where("n_tokens > 0").collect())
    encoded.unpersist()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_character_map_walk_equals_the_library(rule):
    import sentencepiece
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    ours = piece_codec.Normalizer(**piece_codec.normalizer_spec(library.serialized_model_proto()))
    for text in [t for t in ODD if t] + ["ﬁﬂ ① Ａ㌀ é é", " ｶﾞ  x ", "ÄÖ ß"]:
        normal, back = ours(text.encode())
        assert normal.decode() == library.normalize(text)
        assert len(back) == len(normal) + 1 and (np.diff(back) >= 0).all()


def test_collections_skip_the_encoder():
    """Many words are kept, and aren't gone through by each collection of garbage."""
    import gc

    made = id_shards.encoder.__wrapped__(tokenizer_path("byte_bpe_50k.json"))
    assert not any(x is made for x in gc.get_objects())
    words = [f"w{i}" for i in range(550_000)]
    end = b"\2\0\0\0"
    made.encode([" ".join(words)], end)
    made.encode(["a b"], end)
    assert len(made) >= 550_000 - 1 and not made.older
