"""The queries opN_<name> and pipeline: thin calls of the operators on the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrove.llm import hosts, interplay, langid, media, nearest, oracles, packing, paragraphs, pieces, quality, shingles, vectors, warc, whitening
from cellgrove.llm.common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.document_statistics(_table(spark, sf_dir, "documents"))
    model = quality.fit(stats, _table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    scored = quality.score(stats, model)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(_table(spark, sf_dir, "documents"))
    return media.digests(media.sniff(stored, "media", "declared"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_checked(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    found = langid.detect(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(_table(spark, sf_dir, "pages"))
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    # a page is labelled by the document that it shows: the number in its url
    shown = pages.select("url", F.regexp_extract("url", "/([0-9]+)", 1).try_cast("long").alias("doc_id"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    outcomes = shown.join(labels, "doc_id").select("url", "bad")
    return hosts.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(_table(spark, sf_dir, "documents"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_interplay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interplay.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_media": op2_media,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_language": op4_language,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_paragraphs": op7_paragraphs,
    "op8_hosts": op8_hosts,
    "op9_vectors": op9_vectors,
    "op10_minhash": op10_minhash,
    "op11_nearest": op11_nearest,
    "op12_whitening": op12_whitening,
    "op13_interplay": op13_interplay,
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
