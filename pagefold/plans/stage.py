"""Staging: parse the corpus once, store the node table bucketed by ``page_id``.

Every parse operator reads the node table several times (title, text,
links, sections …).  Re-running the Python tokenizer per branch would
multiply the only expensive step, and Catalyst cannot reuse the exchange
because each branch prunes different columns.  So the node table is written
once, as parquet bucketed (and sorted) by ``page_id`` into the shared folder
named by ``spark.checkpoint.dir``.  Reading it back gives a scan whose output
is already hash-partitioned by ``page_id``: later windows, group-bys and
joins on ``page_id`` need no shuffle, each branch reads only its columns,
and the lineage is cut (a lost executor re-reads files, it does not re-parse).
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from pagefold.operators.nodes import by_page, deal, html_nodes
from pagefold.session import bucket_count, materialize_in_order, materialize_table
from pagefold.sources.tables import scan_pages

_STAGED: dict[tuple, str] = {}


def stage_table(spark: SparkSession, df: DataFrame, name: str, key: str = "page_id", sort: list[str] | None = None) -> str:
    """Write ``df`` bucketed by ``key`` under the checkpoint folder; return the table name."""
    return materialize_table(df, name, key, sort)


def _file_stamp(path: str):
    try:
        st = os.stat(path)
        return (st.st_mtime_ns, st.st_size)
    except OSError:
        return None


def _staged_name(spark: SparkSession, key: tuple) -> str | None:
    table = _STAGED.get((id(spark._jsparkSession),) + key)
    return table if table is not None and spark.catalog.tableExists(table) else None


def staged(spark: SparkSession, key: tuple, build, name: str, sort: list[str] | None = None, write=None) -> DataFrame:
    """Stage ``build()`` once per session and ``key`` as a table bucketed by ``page_id``."""
    table = _staged_name(spark, key)
    if table is None:
        df = build()
        table = write(df, name) if write else stage_table(spark, df, name, "page_id", sort)
        _STAGED[(id(spark._jsparkSession),) + key] = table
    return spark.table(table)


def parse_table(pages: DataFrame, mode: str, name: str, junk: str | None = None) -> str:
    """Parse ``pages(page_id, html)`` into a staged node table, without ``junk`` ('generic' / 'detail') when
    it is given; return the table name.

    Pages are dealt by bucket before the parse, so node rows go straight into their bucket's file, in order: they
    are neither exchanged nor sorted, and the tree with junk is not stored.  With fewer buckets than cores the parse
    would idle cores: then pages are dealt over more tasks and the node rows exchanged.
    """
    from pagefold.operators.junk import DETAIL, GENERIC, strip_junk_detail, strip_junk_generic

    spark, order = pages.sparkSession, ["page_id", "pre"]
    n = bucket_count(spark)
    if n < spark.sparkContext.defaultParallelism:
        nodes = html_nodes(pages.select("page_id", "html"), mode)
        strip = {None: lambda df: df, "generic": strip_junk_generic, "detail": strip_junk_detail}[junk]
        return materialize_table(strip(nodes), name, "page_id", order)
    pages = by_page(pages, n)
    nodes = html_nodes(pages, mode, {"generic": GENERIC, "detail": DETAIL}[junk]) if junk else html_nodes(pages, mode)
    return materialize_in_order(nodes, name, n, "page_id", order)


def _parse_stage(spark, key, pages_fn, mode: str, junk: str | None, name: str) -> DataFrame:
    if not junk:
        return staged(spark, key + (None,), pages_fn, name, write=lambda pages, name: parse_table(pages, mode, name))
    raw = _staged_name(spark, key + (None,))
    if raw is None:
        return staged(spark, key + (junk,), pages_fn, f"{name}-kept-{junk}", write=lambda pages, name: parse_table(pages, mode, name, junk))
    from pagefold.operators.junk import strip_junk_detail, strip_junk_generic

    strip = {"generic": strip_junk_generic, "detail": strip_junk_detail}[junk]
    return staged(spark, key + (junk,), lambda: strip(spark.table(raw)), f"{name}-kept-{junk}", ["page_id", "pre"])


def _dealt(rows: DataFrame) -> DataFrame:
    """Source rows dealt over the tasks that build their pages: by ``doc_id``, which is the ``page_id`` of most
    builders, so that the plan sees ``parse_table``'s deal as done; else evenly."""
    n = bucket_count(rows.sparkSession)
    if "doc_id" not in rows.columns or n < rows.sparkSession.sparkContext.defaultParallelism:
        return deal(rows)
    return rows.repartition(n, "doc_id")


def _corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = scan_pages(spark, sf_dir).select("page_id", "html")
    return deal(pages) if bucket_count(spark) < spark.sparkContext.defaultParallelism else pages


def corpus_nodes(spark: SparkSession, sf_dir: str, mode: str = "generic", junk: str | None = None) -> DataFrame:
    """Node table of ``{sf_dir}/pages.parquet``, parsed once per session and source.

    ``junk`` ('generic' / 'detail') returns the table after that junk
    removal, itself staged once, so the many readers of the cleaned tree
    share one scan instead of each re-running the junk window.  A query that
    reads both asks for the whole tree first; the cleaned one is then made from it.
    """
    pages_path = os.path.abspath(f"{sf_dir.rstrip('/')}/pages.parquet")
    key = ("pages", pages_path, _file_stamp(pages_path), mode)
    return _parse_stage(spark, key, lambda: _corpus_pages(spark, sf_dir), mode, junk, f"nodes-{mode}")


def derived_nodes(spark: SparkSession, sf_dir: str, source: str, builder, mode: str, junk: str | None = None) -> DataFrame:
    """Node table of synthetic pages ``builder(table)`` built from ``{sf_dir}/{source}.parquet``."""
    from pagefold.sources.tables import table

    path = os.path.abspath(f"{sf_dir.rstrip('/')}/{source}.parquet")
    key = (source, path, _file_stamp(path), builder.__module__, builder.__qualname__, mode)
    return _parse_stage(spark, key, lambda: builder(_dealt(table(spark, sf_dir, source))), mode, junk, f"nodes-{builder.__name__}-{mode}")


def staged_lines(spark: SparkSession, kept: DataFrame, key: tuple) -> DataFrame:
    """B8 node lines of a staged, junk-stripped node table, staged once per ``key``."""
    from pagefold.operators.generic import node_lines

    return staged(spark, ("lines",) + key, lambda: node_lines(kept), "lines", ["page_id", "pre"])


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages_path = os.path.abspath(f"{sf_dir.rstrip('/')}/pages.parquet")
    return staged_lines(spark, corpus_nodes(spark, sf_dir, "generic", junk="generic"), (pages_path, _file_stamp(pages_path)))


def derived_lines(spark: SparkSession, sf_dir: str, source: str, builder) -> DataFrame:
    path = os.path.abspath(f"{sf_dir.rstrip('/')}/{source}.parquet")
    kept = derived_nodes(spark, sf_dir, source, builder, "generic", junk="generic")
    return staged_lines(spark, kept, (path, _file_stamp(path), builder.__qualname__))
