"""A training-data pipeline over ``documents``.

Toxic documents go, one document of each group of near copies stays, secrets are
masked, sources are mixed to their target weights, and the mix is encoded. Every
stage is a function (spark, docs, sf_dir) -> DataFrame; ``run`` writes each result
to the shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladescope.llm import piece_codec, secret_ownership, shingle_join, source_mixing, toxic_segments
from cladescope.llm.common import materialize, read_table
from cladescope.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic_segments.reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_ownership.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.with_digests(piece_codec.encode_documents(docs, tokenizer_path("piece_bpe_32k.model")))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("source_mixing", mix_sources),
    ("piece_encoding", encode),
]

#: Learned scores and an external tokenizer can't be written in SQL; tests compare stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
