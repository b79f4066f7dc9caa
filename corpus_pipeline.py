"""A cleaning pipeline over documents: each stage works on all that the one before kept.

1. quality: texts that the compression classifier rejects go
2. near_duplicates: of each group of near duplicates (five-word shingles, a similarity of 0.8
   or more) the document with the least id stays
3. decontamination: documents that hold a benchmark item, even with a few edits, go
4. secrets: findings are masked in the texts, and n_chars follows
5. encoding: SentencePiece ids of what is left, with their digests, beside all other columns

Stages 1 to 4 return the columns they were given, whatever else these hold. Rows with a null
id are never near duplicates; null texts are empty and stay null; of rows that repeat an id
one stays, that of the least text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilis.llm import decontaminate, minhash, secrets
from profilis.llm import quality as classifier
from profilis.llm.common import by_ids, cut, table
from profilis.llm.queries import PIECE_MODEL, secret_model
from profilis.llm.sentencepiece_codec import encode_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = classifier.fit_quality(docs, table(spark, sf_dir, "labels"), ~classifier.held_out(F.col("doc_id")))
    return classifier.keep_good(docs, model)


#: Common shingles, in percent, from which on documents are near duplicates.
SIMILAR = 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = cut(minhash.near_duplicates(docs, SIMILAR).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    left = by_ids(docs, found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("kept and n > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = by_ids(left, repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))).alias("row"))
    return by_ids(left, repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.mask_secrets(docs, secret_model())
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = ("text", "n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return encode_documents(docs, PIECE_MODEL, keep_ids=True, keep=[c for c in docs.columns if c not in made])


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", mask),
    ("encoding", encoding),
]

#: No stage can be said in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))  # stages read their input more than once
    return STAGES[-1][1](spark, docs, sf_dir)
