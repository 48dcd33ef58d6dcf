"""The corpus pipeline: language ID, quality, near-duplicates, repeated passages, packing.

Each stage works on all rows its predecessor kept and takes (spark, docs, sf_dir); all but the last return
the columns of documents. ``run`` writes each stage's rows as Parquet in the shared folder and reads them
again, so a lost executor costs at most the stage it was in.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.llm import langid, packing, paragraphs, quality, shingles
from cellgrove.llm.common import crc_mod, stage, unused


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learnt languages; those without letters or with no language above chance go."""
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    return langid.keep_identified(docs, model)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more; labels are learnt from the rows that op1 may learn from."""
    stats = quality.document_statistics(docs)
    model = quality.fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 3) != 1)
    return quality.keep_good(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; rows of one id are told apart by their text."""
    (h,) = unused(docs, "text_hash")
    gone = shingles.near_duplicates(docs, hashed=h).where(~F.col("kept")).select("doc_id", h)
    return docs.withColumn(h, F.xxhash64("text")).join(stage(gone, "near-duplicates-gone"), ["doc_id", h], "left_anti").select(docs.columns)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the paragraphs that an earlier one has; n_chars follows the text."""
    cut = paragraphs.remove_repeated(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("repeated passages", repeated_passage_stage),
    ("packing", packing_stage),
]

#: The stages learn models and hash signatures: no SQL gives their rows; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
