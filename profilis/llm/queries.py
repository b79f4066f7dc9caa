"""The queries of the ten operators over the whole tables they are meant for."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilis.llm import chat, decontaminate, licenses, lm, minhash, quality, secrets, topk
from profilis.llm.common import crc_mod, table
from profilis.llm.oracles import ORACLES  # noqa: F401
from profilis.llm.sentencepiece_codec import encode_documents
from profilis.llm.token_counts import count_tokens

#: A public vocabulary; its file is read in place.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) != 2)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@cache
def secret_model() -> secrets.SecretModel:
    """Trained once a process on generated findings."""
    return secrets.train_secrets()


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has a row for each turn; the added conversation is one record of messages."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.lit("\\### Assistant: </turn> ok")
    messages = F.array(*[F.struct(F.lit(role).alias("role"), hard.alias("content")) for role in ("user", "assistant")])
    extra = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), messages.alias("messages"))
    return chat.digests(chat.format_conversations(rows, "conv_id", extra))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), secret_model())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm": op1_lm,
    "op2_decontaminate": op2_decontaminate,
    "op3_licenses": op3_licenses,
    "op4_token_counts": op4_token_counts,
    "op5_minhash": op5_minhash,
    "op6_quality": op6_quality,
    "op7_chat": op7_chat,
    "op8_topk": op8_topk,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_secrets": op10_secrets,
}
