"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on what the stage before it kept; all but the last return the columns
of `documents`, and no others.  Null texts pass as they are until packing, which takes them as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import bagminhash, line_spread, packing, pii_boost, quality_fm

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(df: DataFrame) -> DataFrame:
    """The columns of `documents`, with the length of the text as it is now."""
    return df.select(*COLUMNS[:-1], F.length("text").cast("long").alias("n_chars"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject."""
    docs = docs.select(*COLUMNS)
    machine = quality_fm.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_fm.score(docs, machine, out=("__score", "__good")).where(F.col("__good") == 1).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sites share."""
    return _columns(line_spread.remove_boilerplate(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return bagminhash.keep_one(docs.select(*COLUMNS))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced by their kind."""
    return _columns(pii_boost.redact(pii_boost.find(docs.select(*COLUMNS))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("PII", pii),
    ("packing", pack),
]

#: No SQL: a fitted classifier, signatures and a tokenizer take part.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet to the shared folder and read again by the next."""
    from tracewell.llm.common import materialise

    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if k < len(STAGES) - 1:
            df = materialise(df, f"stage{k}")
    return df
