"""A training-data pipeline over ``documents``: each stage is one corpus operator, written as Parquet and read again.

Every stage but the last returns the columns of ``documents``, of any names and however many. Null texts score as empty ones in the first stage and pass the
others untouched; rows without a doc_id are kept by the near-duplicate stage, those without words too, and come out of the last one with a null id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampwise.llm import bpe, decontam, linededup, minhash, quality
from rampwise.llm.common import columns, table, unused, written

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, learned from ``labels.quality``, scores below ``LEAST_QUALITY``."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    name = unused(docs, "quality")
    return docs.withColumn(name, quality.quality(model, docs)).filter(F.col(name) >= LEAST_QUALITY).select(*columns(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; documents of which nothing but blank lines is left go."""
    name = unused(docs, "lines")
    got = linededup.dedup_lines(docs, info=name)
    got = got.filter(~F.coalesce(F.col(name)["emptied"], F.lit(False))).select(*columns(docs))
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else got


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8)."""
    return minhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words (or all of a shorter item) of ``benchmark``."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids as little-endian unsigned 32-bit integers, and the digest of what they decode to."""
    import public_tokenizers

    ranks = bpe.read_ranks(spark, public_tokenizers.path(TOKENIZER))
    got = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return got.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("line dedup", drop_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("tokens", tokenize),
]

#: The first stage's model can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
