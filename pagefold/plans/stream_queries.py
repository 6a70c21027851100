"""Registered streaming queries (H1–H3): each runs its stream to completion
(``availableNow``) into the checkpoint folder and returns the output table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import jobs as J
from pagefold.operators.dom import has_attr, is_elem
from pagefold.operators.junk import strip_junk_generic
from pagefold.operators.nodes import html_nodes, parsed_pages
from pagefold.operators.text import plain_text, region, title_generic
from pagefold.plans.parse_queries import _ORACLE_RAW_TEXT, _ORACLE_TITLE
from pagefold.plans.registry import register
from pagefold.plans.serve_queries import _JOBS_SQL
from pagefold.session import materialize, scratch_path
from pagefold.sources.tables import PAGES_SCHEMA, stream_path, table
from pagefold.streaming.stream import stream_dedupe_url, stream_job_latest, stream_pages


def page_summary_batch(pages):
    """The flagship summary for one batch of pages (used per micro-batch)."""
    nodes = materialize(html_nodes(pages, "generic"), "stream-nodes", sort=["page_id", "pre"])
    n_links = nodes.filter(is_elem() & (F.col("tag") == "a") & has_attr("href")).groupBy("page_id").agg(
        F.count("*").alias("n_links"))
    kept = strip_junk_generic(nodes)
    return (
        parsed_pages(nodes).join(title_generic(pages, kept), "page_id", "left")
        .join(plain_text(kept, region(kept)), "page_id", "left").join(n_links, "page_id", "left")
        .select("page_id", "title", F.length("raw_text").alias("n_chars"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )


@register("stream_pages", f"""SELECT page_id, {_ORACLE_TITLE} AS title, length({_ORACLE_RAW_TEXT}) AS n_chars,
         CAST(len(regexp_extract_all(html,'<a href="([^"]*)"',1)) AS BIGINT) AS n_links FROM pages""")
def q_stream_pages(spark, sf_dir):
    """H1: page files parsed incrementally (foreachBatch, checkpointed) — equal to the batch result."""
    out, ckpt = scratch_path(spark, "stream-pages-out"), scratch_path(spark, "stream-pages-ckpt")
    stream_pages(spark, stream_path(sf_dir, "pages"), out, ckpt, page_summary_batch, PAGES_SCHEMA)
    return spark.read.parquet(out).select("page_id", "title", "n_chars", "n_links")


@register("stream_dedupe_url", "SELECT DISTINCT url FROM pages")
def q_stream_dedupe_url(spark, sf_dir):
    """H2: each URL once across micro-batches (streaming dropDuplicates)."""
    out, ckpt = scratch_path(spark, "stream-dedupe-out"), scratch_path(spark, "stream-dedupe-ckpt")
    stream_dedupe_url(spark, stream_path(sf_dir, "pages"), out, ckpt, PAGES_SCHEMA)
    return spark.read.parquet(out).select("url")


@register("stream_dedupe_watermark", "SELECT DISTINCT event_id, ts FROM events")
def q_stream_dedupe_watermark(spark, sf_dir):
    """H2 with bounded state: event-time watermark over the events (RocksDB state store), each event once."""
    out, ckpt = scratch_path(spark, "stream-watermark-out"), scratch_path(spark, "stream-watermark-ckpt")
    schema = table(spark, sf_dir, "events").schema
    stream_dedupe_url(spark, stream_path(sf_dir, "events"), out, ckpt, schema, key="event_id", watermark=("ts", "1 hour"))
    return spark.read.parquet(out).select("event_id", F.col("ts").cast(schema["ts"].dataType).alias("ts"))


@register("stream_job_latest", _JOBS_SQL + """
SELECT job_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM lt""")
def q_stream_job_latest(spark, sf_dir):
    """H3: the job status table maintained by a stateful streaming aggregation with upserts."""
    out, ckpt = scratch_path(spark, "stream-jobs-out"), scratch_path(spark, "stream-jobs-ckpt")
    schema = table(spark, sf_dir, "events").schema
    lt = stream_job_latest(spark, stream_path(sf_dir, "events"), out, ckpt, schema, J.job_events)
    return lt.select("job_id", "status", J.format_date(F.col("created_at")).alias("created_at"),
                     J.format_date(F.col("updated_at")).alias("updated_at"))
