"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import bitplanes, classifier, curriculum, line_quality, merge_tree, pieces, runs, sharding
from tandem.llm import shingle_join, style_tree, topk, warc, whitening
from tandem.llm.common import table
from tandem.sources.workspace import fresh_path


def op1_curriculum(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are read, in training order, then those that are not."""
    found = curriculum.assign(table(spark, sf, "documents"), keep=["doc_id"]).select(
        F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken",
        F.get("places", F.lit(0)).alias("place"),
    )
    read = found.filter("taken > 0").orderBy("place", "doc_id")
    return read.unionByName(found.filter("taken = 0"))


def op2_jump_hash(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(table(spark, sf, "documents"), 24)


def op3_line_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return line_quality.quality_rules(table(spark, sf, "documents"))


def op4_bit_planes(spark: SparkSession, sf: str) -> DataFrame:
    folder = bitplanes.ids_folder(spark)
    manifest = bitplanes.write_ids(
        table(spark, sf, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2
    )
    return bitplanes.read_ids(manifest, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op5_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encode(
        table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    ).select("doc_id", "n_tokens", "ids_crc32", "round_trip")


def op6_fourier_quality(spark: SparkSession, sf: str) -> DataFrame:
    return classifier.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_uniform_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"))


def op8_shingle_join(spark: SparkSession, sf: str) -> DataFrame:
    return shingle_join.jaccard_components(table(spark, sf, "documents"))


def op9_style_tree(spark: SparkSession, sf: str) -> DataFrame:
    return style_tree.extract(table(spark, sf, "pages"))


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    warc.write_pages(table(spark, sf, "pages"), folder)
    found = warc.read_records(spark, folder, payload=False, verify=True)
    return found.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op11_merge_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Ids by joins of halves, then their bytes. Null and empty texts: no ids, the digests of nothing."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = merge_tree.encode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)
    return merge_tree.decode(ids, ranks).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_chebyshev_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


def op13_tiled_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.find_runs(table(spark, sf, "documents"), runs.planted)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_curriculum, op2_jump_hash, op3_line_frequency, op4_bit_planes, op5_sentencepiece,
        op6_fourier_quality, op7_uniform_threshold, op8_shingle_join, op9_style_tree, op10_warc,
        op11_merge_tree, op12_chebyshev_whitening, op13_tiled_runs,
    )
}
