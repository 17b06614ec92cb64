"""The corpus pipeline: quality rules, near-copies, secrets, packing.

Each stage reads the table that the one before has written and applies one
operator of loreweave.llm to all of it. Columns besides those of documents are
ignored, whatever their names. An empty table gives an empty result in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm import jaccard, packing, quality, secrets
from loreweave.llm.common import Scratch
from loreweave.llm.queries import CAPACITY, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Null and empty texts have no words and go. Repeated rows are judged alike, ties
    don't occur, a null doc_id doesn't matter. Very long texts are judged whole.
    """
    return quality.judged(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-copies one document: the one of the least doc_id.

    Links are proposed by SimHash over five-word shingles and by an exact prefix
    filter, and hold where 0.8 or more of the shingles are shared, by exact Jaccard.
    Rows are told apart by doc_id and text, so one doc_id on two texts is two
    documents; a null doc_id comes last. Of repeated rows one stays. Null and
    blank texts are copies of each other. No rows: no rows.
    """
    return jaccard.first_of_each(docs.select(*COLUMNS))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark, and n_chars of the new text.

    Null texts stay null; texts without a secret stay as they are. Copies share one
    scan, repeated rows stay, ties don't occur, a null doc_id doesn't matter. Very
    long texts are scanned whole.
    """
    found = secrets.find_secrets(docs.select(*COLUMNS))
    return found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans"))).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    Null and empty texts are one piece, the end mark alone. A very long text is cut
    into pieces of CAPACITY. Pieces of equal length are placed in the order of
    doc_id and piece, with null ids first; repeated rows each get a place.
    """
    pieces = packing.cut_documents(docs.select("doc_id", "text"), tokenizer_path(), CAPACITY)
    return packing.pack(pieces, CAPACITY).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("secrets", secret_redaction), ("packing", best_fit_packing)]

#: SQL has no tokenizer and no fingerprint; a test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before is written to the shared folder, and dropped when the next one is."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
