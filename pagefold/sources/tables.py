"""A1 and friends: reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PAGES_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def stream_path(sf_dir: str, name: str) -> str:
    """Where a stream finds an input table, be it one file or a folder of part files: a pattern with one
    alternative, as a file stream takes a plain path for a folder only."""
    return f"{sf_dir.rstrip('/')}/{{{name}}}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table from ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the corpus of fetched pages ``(page_id, url, html)`` with a fixed schema."""
    return spark.read.schema(PAGES_SCHEMA).parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
