"""Queries of the text problems, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, ship
from .leaks import leaked
from .packing import WINDOW, packed
from .toxicity import KINDS, THRESHOLD, flagged, judged_texts, score, train


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packed(load(spark, sf_dir, "documents"))


def p6_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, tokens and the share of room used."""
    s = p6_packing(spark, sf_dir).groupBy("sequence").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("n"))
    return s.agg(F.count("*").alias("windows"), F.sum("n").alias("tokens"), F.round(F.sum("n") / (F.count("*") * WINDOW), 4).alias("used"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return leaked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item, with the number of documents that hold it."""
    found = p7_found(spark, sf_dir).groupBy("eval_id").agg(F.count("*").alias("n"))
    return load(spark, sf_dir, "eval_items").select("eval_id", "suite").join(found, "eval_id", "left").select("eval_id", "suite", F.coalesce("n", F.lit(0)).alias("documents"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = load(spark, sf_dir, "documents")
    return score(docs, train(judged_texts(docs, load(spark, sf_dir, "review_labels"))))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(p8_scores(spark, sf_dir))


def p8_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source, the share of reviews with each kind."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "source").join(p8_scores(spark, sf_dir), "doc_id")
    rate = lambda k: F.round(F.avg((F.col(k) > THRESHOLD).cast("int")), 6).alias(f"{k}_rate")
    return rows.groupBy("source").agg(F.count("*").alias("reviews"), *[rate(k) for k in KINDS[1:]])


QUERIES = {"p6_packing": p6_packing, "p6_use": p6_use, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_scores": p8_scores, "p8_source_rates": p8_source_rates}
SQL: dict[str, str] = {}
