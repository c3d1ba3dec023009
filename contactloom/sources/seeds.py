"""Seed lists of sites and of business directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.functions.urls import is_http

CHAMBER_DDL = "url STRING, chamber_name STRING, state STRING, city STRING, expected_businesses INT"
SAMPLE_CHAMBERS = tuple((f"https://www.chamber-{c.lower()}.org", f"{c} Chamber of Commerce", s, c, 500) for c, s in (("Springdale", "AR"), ("Riverton", "WY"), ("Lakewood", "CO"), ("Hillsboro", "OR"), ("Fairview", "TN")))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return rows.toDF(*[c.removeprefix("﻿").strip() for c in rows.columns])


def seed_urls(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a seed file whose trimmed url is http(s); other columns as text. A file without a url column, or without such a row, is an error."""
    rows = _csv(spark, path)
    if "url" not in rows.columns:
        raise ValueError(f"{path} has no column named url")
    kept = rows.where(is_http(F.col("url"))).withColumn("url", F.trim("url"))
    if kept.isEmpty():
        raise ValueError(f"{path} has no http(s) url")
    return kept


def chamber_urls(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a directory list whose url is http(s); a missing file gives a sample of five."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame(SAMPLE_CHAMBERS, CHAMBER_DDL)
    rows = _csv(spark, path)
    names = [f.split()[0] for f in CHAMBER_DDL.split(", ")]
    typed = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in names]).withColumn("expected_businesses", F.expr("try_cast(expected_businesses AS INT)"))
    return typed.where(is_http(F.col("url"))).withColumn("url", F.trim("url"))


def chamber_source(spark: SparkSession, urls: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Directories from a list, taken as it is, or else from a file."""
    if urls:
        return spark.createDataFrame([(u,) for u in urls], "url STRING")
    if path:
        return chamber_urls(spark, path).select("url")
    raise ValueError("neither urls nor a file of them")
