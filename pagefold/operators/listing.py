"""Listing → detail pipeline with a resumable completed-URL set.

The completed set is a table ``completed(url)``.  Each run reads the
newest version, anti-joins it away from the listings, and writes a new
version (old ∪ newly parsed) — versions are immutable folders, so a failed
run never corrupts the state and reruns are idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefold.sources.versions import newest_version, write_version

COMPLETED_SCHEMA = T.StructType([T.StructField("url", T.StringType())])


def listing_limit(listings: DataFrame, limit: int | None) -> DataFrame:
    """First ``limit`` listings of each listing page (by ``pos``), before the completed test; 0/None = all."""
    if not limit:
        return listings
    return listings.filter(F.col("pos") < limit)


def pending_urls(listings: DataFrame, completed: DataFrame) -> DataFrame:
    """Listings whose URL is not in the completed set (anti-join)."""
    return listings.join(completed.select("url").distinct(), "url", "left_anti")


def completed_from_urls(spark: SparkSession, urls: DataFrame | None) -> DataFrame:
    """A completed-set DataFrame (empty with schema when ``urls`` is None)."""
    if urls is None:
        return spark.createDataFrame([], COMPLETED_SCHEMA)
    return urls.select(F.col("url").cast("string")).distinct()


def mark_completed(completed: DataFrame, parsed: DataFrame) -> DataFrame:
    """New completed set = old ∪ URLs parsed without error (idempotent)."""
    ok = parsed
    if "_error" in parsed.columns:
        ok = parsed.filter(F.col("_error").isNull())
    return completed.select("url").unionByName(ok.select("url")).distinct()


def reset_state(spark: SparkSession) -> DataFrame:
    """An empty completed set (written as the next state version; data stay)."""
    return completed_from_urls(spark, None)


def write_state(completed: DataFrame, path: str, updated_at) -> str:
    """Write the completed set as the next version below ``path``; ``updated_at`` (a timestamp value
    or column) is kept as an additional row without a URL, so that an empty state has its time too."""
    stamp = completed.sparkSession.range(1).select(F.lit(None).cast("string").alias("url"))
    rows = completed.select("url").unionByName(stamp)
    return write_version(rows.withColumn("updated_at", F.lit(updated_at).cast("timestamp")), path)


def read_state(spark: SparkSession, path: str) -> tuple[DataFrame, bool, DataFrame]:
    """The newest version's completed set, whether there is a version, and its time (one row)."""
    folder = newest_version(spark, path)
    if not folder:
        return completed_from_urls(spark, None), False, spark.range(1).select(F.lit(None).cast("timestamp").alias("last_updated"))
    rows = spark.read.parquet(folder)
    return rows.filter("url IS NOT NULL").select("url"), True, rows.agg(F.max("updated_at").alias("last_updated"))


def stored_state_stats(spark: SparkSession, path: str) -> DataFrame:
    """E5 of the state stored below ``path``."""
    completed, exists, updated = read_state(spark, path)
    # two one-row tables, side by side
    return completed.agg(F.count("*").alias("completed_count")).join(updated, F.lit(True)).select(
        "completed_count", F.col("completed_count").alias("total_completed"), F.lit(exists).alias("state_exists"), "last_updated")


def state_stats(completed: DataFrame, exists: bool = True, last_updated=None) -> DataFrame:
    """E5: completed_count / total_completed, whether a state exists, last update."""
    return completed.agg(F.count("*").alias("completed_count")).select(
        "completed_count",
        F.col("completed_count").alias("total_completed"),
        F.lit(exists).alias("state_exists"),
        F.lit(last_updated).cast("timestamp").alias("last_updated"),
    )


def listing_detail_join(pending: DataFrame, details: DataFrame) -> DataFrame:
    """Each pending listing with its fetched detail page ``(page_id, url, html)``.

    Inner equi-join on URL; the listing's category travels with the page.
    Listings without a page come back from :func:`unfetched_listings`.
    """
    keep = [c for c in pending.columns if c not in ("page_id", "html")]
    return pending.select(*keep).join(details.select("page_id", "url", "html"), "url")


def unfetched_listings(pending: DataFrame, details: DataFrame) -> DataFrame:
    """Listings whose detail page is missing from the corpus (the failures of E6)."""
    return pending.join(details.select("url"), "url", "left_anti")


