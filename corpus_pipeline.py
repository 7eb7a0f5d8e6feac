"""The training-data pipeline: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
into the shared folder and reads it again as the next stage's documents. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.bpe import bpe_round_trip, tokenizer_file
from tracewright.llm.common import Scratch, ensure_importable, table
from tracewright.llm.decontam import remove_contamination
from tracewright.llm.minhash import without_near
from tracewright.llm.quality import keep_good
from tracewright.llm.substrings import remove_repeats

#: A document goes if more than this share of its words is benchmark text; else the passages are cut out.
MOST_COVER = 0.5


def _begin(spark: SparkSession) -> None:
    """A stage's predecessor has been written by now, so what it left in the shared folder can go."""
    ensure_importable(spark)
    Scratch.drop("pipeline")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is accepted. A null doc_id has no label and no verdict, and stays."""
    _begin(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"), "pipeline")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group of near-duplicates; repeated and null doc_ids are told apart by row."""
    _begin(spark)
    return without_near(docs, "pipeline")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that also stand elsewhere; those left without any word go.

    A cut may split a character: what is left of it goes too.
    """
    _begin(spark)
    read = remove_repeats(docs, "pipeline")
    # what a cut leaves of a character reads as the replacement character
    text = F.when(F.col("n_removed") > 0, F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))).otherwise(F.col("text"))
    kept = read.withColumn("text", text).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return _recounted(kept.select(*docs.columns), docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly such passages go."""
    _begin(spark)
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"), max_cover=MOST_COVER)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with a digest of what they decode to."""
    _begin(spark)
    read = bpe_round_trip(docs, tokenizer_file())
    return read.select("row.doc_id", "row.source", "row.lang", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


def _recounted(kept: DataFrame, docs: DataFrame) -> DataFrame:
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark),
    ("BPE encoding and decoding", encode),
]

#: The quality model and the sketches are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = Scratch.write(docs, "pipeline-stages", f"stage{k}")
    return docs
