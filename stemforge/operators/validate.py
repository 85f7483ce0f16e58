"""Checks of keys, required values and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated(rows: DataFrame, key: str, what: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(F.lit("repeated").alias("problem"), F.lit(what).alias("what"), F.col(key).cast("string").alias("key"))


def missing(rows: DataFrame, key: str, column: str, what: str) -> DataFrame:
    return rows.where(F.col(column).isNull() | (F.col(column).cast("string") == "")).select(F.lit("missing").alias("problem"), F.lit(what).alias("what"), F.col(key).cast("string").alias("key"))


def dangling(rows: DataFrame, key: str, target: DataFrame, target_key: str, what: str) -> DataFrame:
    gone = rows.select(F.col(key).alias(target_key)).distinct().join(target.select(target_key).distinct(), target_key, "left_anti")
    return gone.select(F.lit("dangling").alias("problem"), F.lit(what).alias("what"), F.col(target_key).cast("string").alias("key"))


# Repeated keys and dangling links fail a build, values that are missing only warn.
HARD = ["repeated", "dangling"]


def report(parts: list[DataFrame]) -> DataFrame:
    """All problems; those of keys and links are hard, missing values are soft."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("hard", F.col("problem").isin(HARD))


def summary(problems: DataFrame) -> DataFrame:
    return problems.groupBy("problem", "what", "hard").agg(F.count("*").alias("n"))


def apart_from(problems: DataFrame, others: DataFrame) -> DataFrame:
    """Distinct problems that are not among others."""
    return problems.select("problem", "what", "key").subtract(others.select("problem", "what", "key"))
