"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkgrid.llm import (
    centroids,
    language,
    lines,
    mixing,
    negatives,
    ngram_join,
    ordermin,
    pieces,
    quality,
    radix,
    repetition,
    secrets,
    segmentation,
    tokencount,
)
from linkgrid.llm.common import table

PIECES = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def domain_of() -> Column:
    """The tables name no domain; the last digit of the source stands for it."""
    return (
        F.when(F.col("source").rlike("[0-4]$"), "web")
        .when(F.col("source").rlike("[5-7]$"), "reference")
        .otherwise("forum")
    )


TARGETS = mixing.Targets(
    domain={"web": 5, "reference": 3, "forum": 2},
    lang={"en": 5, "de": 2, "fr": 2},
    source={"src0": 3},
)


@query
def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf, "documents"), TARGETS, domain_of())


@query
def op2_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf, "documents"))


@query
def op3_token_counts(spark: SparkSession, sf: str, model: str = PIECES) -> DataFrame:
    return tokencount.token_counts(table(spark, sf, "documents"), pieces.load(model))


@query
def op4_sentencepiece(spark: SparkSession, sf: str, model: str = PIECES) -> DataFrame:
    return segmentation.encoded_documents(table(spark, sf, "documents"), pieces.load(model))


@query
def op5_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf, "documents"))


@query
def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_report(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return radix.exact_report(table(spark, sf, "documents"))


@query
def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    report = lines.line_report(table(spark, sf, "documents"))
    return report.withColumn("removed", F.concat_ws(",", F.col("removed").cast("array<string>")))


@query
def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language.language_report(table(spark, sf, "documents"))


@query
def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.repetition_report(table(spark, sf, "documents"))


@query
def op11_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return ordermin.fingerprint_report(table(spark, sf, "documents"))


@query
def op12_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf, "embeddings"))


@query
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("bigint")
    # The contract moves the label of every seventh vector.
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(
        table(spark, sf, "embeddings"), is_anchor=vec_id % 100 == 0, label=moved)
