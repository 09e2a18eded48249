"""Reads: whole tables, single rows, probes, counts, and SQL that passes through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colmerge.operators.ordering import placed
from colmerge.sources.tables import register_views


def point_lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """One row with the key, or none."""
    return rows.filter(F.col(key) == F.lit(value)).limit(1)


def existing(keys: DataFrame, rows: DataFrame, on: str) -> DataFrame:
    """Those of many keys that ``rows`` has, in one join."""
    return keys.join(rows.select(on), on, "left_semi")


def row_count(rows: DataFrame, where: Column | None = None) -> DataFrame:
    return (rows if where is None else rows.filter(where)).agg(F.count("*").alias("n"))


def passthrough(spark: SparkSession, sf_dir: str, sql: str, tables: list[str]) -> DataFrame:
    """Any statement over the tables, planned by Spark."""
    register_views(spark, sf_dir, tables)
    return spark.sql(sql)


def without_soft_deleted(rows: DataFrame, flag: str = "deleted") -> DataFrame:
    """Rows whose flag column isn't set: what applications use where they can't delete."""
    return rows.filter(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def by_key(rows: DataFrame, key: str = "pk") -> DataFrame:
    """Rows with ``place``, in the order of the bytes of their keys (texts)."""
    return placed(rows, [key], "place").orderBy("place")


def newest_first(rows: DataFrame, created: Column, key: str) -> DataFrame:
    """Rows with ``place``, by the time of their creation (whole seconds), newest first, then by key."""
    return placed(rows.withColumn("__ago", -created), ["__ago", key], "place").drop("__ago").orderBy("place")
