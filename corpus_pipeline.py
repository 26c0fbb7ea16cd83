"""Corpus pipeline: quality, near duplicates, repeated passages, personal data, packing.

Each stage takes the rows that the stage before it kept, and all but the last return the columns of ``documents``.
Null texts count as empty; rows with a null id are kept by the two duplicate stages. An empty table passes through.
Every stage sets the session's limit of an Arrow batch to ``BATCH_BYTES``, since its last pass runs when the caller writes the
rows: buffers that large batches leave behind in executors and Python workers stay there for all later stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleworks.llm import ngram_jaccard, packing, pii, quality, suffix_dedup
from sampleworks.llm._shared import BATCH_LIMIT, written

#: texts of a batch on their way to a Python worker
BATCH_BYTES = "2m"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _recounted(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """``changed`` with ``n_chars``, if there is such a column, counted anew; 0 for a null text."""
    if "n_chars" not in docs.columns:
        return changed.select(*docs.columns)
    count = F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return changed.withColumn("n_chars", count).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    return quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word shingles at 0.8; wordless texts stay."""
    spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    found = ngram_jaccard.join_components(docs, size=5, percent=80)
    gone = written(found.filter("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    if gone.count() <= suffix_dedup.BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 bytes or more that start in an earlier document; ``n_chars`` follows."""
    spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    cut = suffix_dedup.deduplicated(docs)
    return _recounted(cut, docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind; ``n_chars`` follows."""
    spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    redacted = pii.redact(docs)
    return _recounted(redacted, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("passages", cut_repeated_passages),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: resampling, byte-exact passage removal and tokenizer ids can't be put into SQL; tests hold the stages against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
