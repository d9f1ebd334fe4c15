"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import classifier, curriculum, line_quality, pieces, shingle_join
from tandem.llm.common import table, word_count
from tandem.sources.workspace import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones of these, does not reject."""
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = classifier.score(docs.select(*COLUMNS), model)
    return scored.filter(F.col("score") >= classifier.THRESHOLD).select("doc.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep enough words without their hosts' common lines, and
    without these lines; ``n_chars`` is counted anew."""
    kept = line_quality.keep_documents(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Near copies share 80 % of their shingles of five words. Rows are told apart by doc_id and a hash of
    their columns: of rows that share a doc_id only those in a group with a smaller one go, of equal
    rows one stays, and a row without doc_id stays if it is the only one of its group, or the one with
    the smallest hash in a group without any. Rows without words are near no other and stay.
    """
    values = [x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*values).alias("version"))
    rows = docs.select(*COLUMNS, row.alias("row"))
    groups = stage(
        shingle_join.jaccard_components(rows.select(F.col("row").alias("doc_id"), "text"), size=5, percent=80),
        "groups",
    )
    gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("row")).distinct()
    again = stage(
        groups.filter("n_shingles > 0 and doc_id = component_id").groupBy(F.col("doc_id").alias("row"))
        .count().filter("count > 1").select("row"),
        "again",
    )
    kept = rows.join(stage(gone, "copies"), "row", "left_anti")
    if not again.isEmpty():
        # Equal rows are folded in every task before they are dealt out.
        wordless = word_count(F.col("text")) == 0
        kept = kept.filter(wordless).unionByName(kept.filter(~wordless).dropDuplicates(["row"]))
    return kept.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, a row for each time one is read."""
    return curriculum.mix(docs.select(*COLUMNS))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip, ids of each reading."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_tokens", "ids_crc32", "round_trip", "ids"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: No SQL: the stages hold a fitted model, components, and an encoder. Tests restate them plainly.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between two is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
