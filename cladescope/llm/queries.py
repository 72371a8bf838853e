"""The registered queries of the subpackage: thin, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladescope.llm import id_shards, language_mixture, main_text, piece_codec, quality_outliers, secret_ownership, shingle_join, source_mixing, toxic_segments, vector_graph
from cladescope.llm.common import read_table


def op3_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return vector_graph.search_index(vector_graph.build_index(vectors), vectors.where("vec_id % 50 = 0"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(read_table(spark, sf_dir, "pages"))


def op5_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.similar_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_outliers.assess(read_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = source_mixing.mixing_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_mixture.predict(docs, language_mixture.learn(docs))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ownership.digests(secret_ownership.find_secrets(read_table(spark, sf_dir, "documents")))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the package is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = id_shards.write_shards(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return id_shards.read_shards(shards)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(piece_codec.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")))


def op10_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxic_segments.score(docs, toxic_segments.learn(docs, read_table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_mixture": op1_language_mixture,
        "op2_secret_ownership": op2_secret_ownership,
        "op3_vector_graph": op3_vector_graph,
        "op4_main_text": op4_main_text,
        "op5_shingle_join": op5_shingle_join,
        "op6_quality_outliers": op6_quality_outliers,
        "op7_source_mixing": op7_source_mixing,
        "op8_id_shards": op8_id_shards,
        "op9_piece_codec": op9_piece_codec,
        "op10_toxic_segments": op10_toxic_segments,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_shingle_join": shingle_join.ORACLE_SQL, "op7_source_mixing": source_mixing.ORACLE_SQL}
