"""Titles, the main text region and the plain-text walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions.text import clean_text, collapse_ws, pystrip
from pagefold.operators.dom import is_elem, is_string, attr, first_match, has_class, ordered_join


def first_text(nodes: DataFrame, tag: str, name: str, strip: bool = True) -> DataFrame:
    """Per page: whether a first ``tag`` element exists and its text (an interval test on that one element).

    Returns ``(page_id, name)``; pages without a match are absent.
    """
    first = first_match(nodes, F.col("tag") == tag, name)
    s = pystrip("text") if strip else F.col("text")
    inside = (F.col("pre") > F.col(f"{name}_pre")) & (F.col("pre") <= F.col(f"{name}_last"))
    strings = nodes.filter(F.col("kind") == "text").select("page_id", "pre", s.alias("s")).filter("s != ''")
    txt = strings.join(first, "page_id").filter(inside).groupBy("page_id").agg(
        ordered_join(F.collect_list(F.struct("pre", "s")), "").alias("text"))
    return first.select("page_id").join(txt, "page_id", "left").select("page_id", F.coalesce("text", F.lit("")).alias(name))


def title_generic(pages: DataFrame, kept: DataFrame) -> DataFrame:
    """First h1 text (strings stripped, joined with no separator), else <title>, else 'Untitled'.

    ``kept`` is the node table after generic junk removal.  An empty h1 still
    wins over <title>.
    """
    h1 = first_text(kept, "h1", "h1")
    tt = first_text(kept, "title", "ttl")
    return (
        pages.select("page_id")
        .join(h1, "page_id", "left")
        .join(tt, "page_id", "left")
        .select("page_id", F.coalesce("h1", "ttl", F.lit("Untitled")).alias("title"))
    )


def title_detail(pages: DataFrame, kept: DataFrame) -> DataFrame:
    """First h1 ``get_text()`` cleaned by B12; '' when the page has no h1."""
    h1 = first_text(kept, "h1", "h1", strip=False)
    return (
        pages.select("page_id")
        .join(h1, "page_id", "left")
        .select("page_id", F.coalesce(clean_text("h1"), F.lit("")).alias("title"))
    )


def region_priority() -> Column:
    """B6 ranking: main, article, #content, .content, body, the whole document."""
    return (
        F.when(is_elem() & (F.col("tag") == "main"), 1)
        .when(is_elem() & (F.col("tag") == "article"), 2)
        .when(is_elem() & F.coalesce(attr("id") == "content", F.lit(False)), 3)
        .when(is_elem() & has_class("content"), 4)
        .when(is_elem() & (F.col("tag") == "body"), 5)
        .when(F.col("kind") == "root", 6)
    )


def region(nodes: DataFrame, priority: Column | None = None) -> DataFrame:
    """Per page the chosen region ``(page_id, r_pre, r_last)``: best priority, then first."""
    prio = region_priority() if priority is None else priority
    return (
        nodes.withColumn("_prio", prio)
        .filter(F.col("_prio").isNotNull())
        .groupBy("page_id")
        .agg(F.min(F.struct("_prio", "pre", "last")).alias("_r"))
        .select("page_id", F.col("_r.pre").alias("r_pre"), F.col("_r.last").alias("r_last"))
    )


def in_region(nodes: DataFrame, reg: DataFrame, include_self: bool = False) -> DataFrame:
    """Nodes inside each page's region (one region row per page: an equi-join plus an interval test)."""
    lo = F.col("pre") >= F.col("r_pre") if include_self else F.col("pre") > F.col("r_pre")
    return nodes.join(reg, "page_id").filter(lo & (F.col("pre") <= F.col("r_last")))


def plain_text(nodes: DataFrame, reg: DataFrame) -> DataFrame:
    """Every string of the region (comments included), stripped, kept when longer
    than one character, joined by a space, whitespace runs collapsed, stripped."""
    strings = in_region(nodes.filter(is_string()), reg).select("page_id", "pre", pystrip("text").alias("s"))
    strings = strings.filter(F.length("s") > 1)
    agg = strings.groupBy("page_id").agg(ordered_join(F.collect_list(F.struct("pre", "s")), " ").alias("_t"))
    return (
        reg.select("page_id")
        .join(agg, "page_id", "left")
        .select("page_id", pystrip(collapse_ws(F.coalesce("_t", F.lit("")))).alias("raw_text"))
    )
