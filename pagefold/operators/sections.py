"""The detail-page parse (title, summary, sections).

Sections are a sessionization over the region's direct children: a running
count of h2/h3 headings (ordered by ``pre``) is the section id; blocks are
grouped by it and joined.  Block text (B16) is built from the node table
with ordered aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions.text import clean_text
from pagefold.operators.dom import attr, first_match, gather, is_elem, ordered_join, subtree_text
from pagefold.operators.text import in_region, region, title_detail
from pagefold.session import materialize

BLOCK_TAGS = ["p", "ul", "ol", "div", "table"]


def detail_region(nodes: DataFrame) -> DataFrame:
    """main, else article, else body (first of each); pages with none are absent."""
    prio = (
        F.when(is_elem() & (F.col("tag") == "main"), 1)
        .when(is_elem() & (F.col("tag") == "article"), 2)
        .when(is_elem() & (F.col("tag") == "body"), 3)
    )
    return region(nodes, prio)


def _texts(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Cleaned ``get_text()`` of target elements ``(page_id, pre[, last])`` → ``(page_id, pre, text)``."""
    t = subtree_text(nodes, targets, strip=False)
    return t.select("page_id", "pre", clean_text("text").alias("text"))


def block_text(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """B16 for block elements ``(page_id, pre, tag)`` → ``(page_id, pre, text)``.

    ul → "- x" per direct li with text; ol → "i. x" (i counts every direct
    li, empty ones too); table → cells " | "-joined per tr, rows whose cells
    are all empty dropped; anything else → cleaned text.
    """
    span_of = ["last"] if "last" in blocks.columns else []
    blk = blocks.select("page_id", F.col("pre").alias("b_pre"), F.col("tag").alias("b_tag"), *span_of)
    lis = (
        nodes.filter(is_elem() & (F.col("tag") == "li"))
        .select("page_id", "pre", "last", F.col("parent").alias("b_pre"))
        .join(blk.filter(F.col("b_tag").isin("ul", "ol")).select("page_id", "b_pre", "b_tag"), ["page_id", "b_pre"])
    )
    # i = position among the direct li children (non-li siblings do not count)
    lis = lis.withColumn("i", F.row_number().over(Window.partitionBy("page_id", "b_pre").orderBy("pre")))
    li_text = _texts(nodes, lis.select("page_id", "pre", "last"))
    lis = lis.join(li_text, ["page_id", "pre"]).filter(F.col("text") != "")
    li_line = F.when(F.col("b_tag") == "ul", F.concat(F.lit("- "), "text")).otherwise(
        F.concat(F.col("i").cast("string"), F.lit(". "), "text"))
    list_txt = lis.groupBy("page_id", "b_pre").agg(
        ordered_join(F.collect_list(F.struct("pre", li_line.alias("s"))), "\n").alias("text"))

    # tables: every tr inside (nested tables too), cells td/th inside each tr (find_all → descendants)
    tables = nodes.filter(is_elem() & (F.col("tag") == "table")).select("page_id", "pre", "last").join(
        blk.filter(F.col("b_tag") == "table").select("page_id", F.col("b_pre").alias("pre")), ["page_id", "pre"])
    span = ["page_id", "pre", "last"]
    cells = nodes.filter(is_elem() & F.col("tag").isin("td", "th")).select(*span)
    cells = cells.join(_texts(nodes, cells), ["page_id", "pre"], "left").select("page_id", "pre", F.coalesce("text", F.lit("")).alias("v"))
    rows = gather(nodes.filter(is_elem() & (F.col("tag") == "tr")).select(*span), cells,
                  lambda x, t: F.when(F.exists(x, lambda c: c != ""), F.array_join(x, " | ")), "v").filter("v is not null")
    tab_txt = gather(tables.select(*span), rows.select("page_id", "pre", "v"), lambda x, t: F.array_join(x, "\n"), "text").select(
        "page_id", F.col("pre").alias("b_pre"), "text")

    other = blk.filter(~F.col("b_tag").isin("ul", "ol", "table"))
    other_txt = _texts(nodes, other.select("page_id", F.col("b_pre").alias("pre"), *span_of)).withColumnRenamed("pre", "b_pre")

    structured = list_txt.unionByName(tab_txt).unionByName(other_txt)
    return (
        blk.join(structured, ["page_id", "b_pre"], "left")
        .select("page_id", F.col("b_pre").alias("pre"), F.coalesce("text", F.lit("")).alias("text"))
    )


def join_blocks(texts) -> F.Column:
    """Drop blank blocks, join with a blank line."""
    return F.array_join(F.filter(texts, lambda x: F.trim(x) != ""), "\n\n")


def _assemble(blocks: DataFrame, key: list[str]) -> DataFrame:
    return blocks.groupBy(*key).agg(
        join_blocks(F.transform(F.sort_array(F.collect_list(F.struct("pre", F.col("text").alias("s")))), lambda x: x["s"])).alias(
            "content")
    )


def sections(nodes: DataFrame, reg: DataFrame | None = None) -> DataFrame:
    """B14 + B15: ``(page_id, ord, title, content)``.

    Primary: over the region's direct children, h2/h3 opens a section (title
    = cleaned text), p/ul/ol/div/table append B16 text, other tags are
    ignored, content before the first heading is dropped, empty titles and
    empty contents are dropped.  Pages where this yields nothing fall back
    to every h2/h3/h4 anywhere in the region, each with the blocks among its
    following siblings up to the next h2/h3/h4 sibling.
    """
    reg = detail_region(nodes) if reg is None else reg
    kids = nodes.join(reg, "page_id").filter(is_elem() & (F.col("parent") == F.col("r_pre")))
    kids = kids.filter(F.col("tag").isin("h2", "h3", *BLOCK_TAGS)).select("page_id", "pre", "last", "tag")
    w = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kids = kids.withColumn("sec", F.sum(F.col("tag").isin("h2", "h3").cast("int")).over(w)).filter(F.col("sec") > 0)
    kids = materialize(kids, "section-blocks", sort=["page_id", "pre"])
    heads = kids.filter(F.col("tag").isin("h2", "h3"))
    htext = _texts(nodes, heads.select("page_id", "pre", "last"))
    titles = heads.join(htext, ["page_id", "pre"]).select("page_id", "sec", F.col("pre").alias("ord"), F.col("text").alias("title"))
    blocks = kids.filter(~F.col("tag").isin("h2", "h3"))
    btext = block_text(nodes, blocks)
    content = _assemble(blocks.join(btext, ["page_id", "pre"]), ["page_id", "sec"])
    primary = (
        titles.join(content, ["page_id", "sec"], "left")
        .select("page_id", "ord", "title", F.coalesce("content", F.lit("")).alias("content"))
        .filter((F.col("title") != "") & (F.col("content") != ""))
    )
    primary = materialize(primary, "sections-primary", sort=["page_id", "ord"])

    # fallback (B15) for pages without a primary section
    fb_pages = reg.select("page_id").join(primary.select("page_id").distinct(), "page_id", "left_anti")
    fb_pages = materialize(fb_pages, "fallback-pages")  # asked for by each branch below
    nodes = nodes.join(fb_pages, "page_id", "left_semi")  # all below reads these pages only
    inreg = in_region(nodes, reg).filter(is_elem())
    fh = inreg.filter(F.col("tag").isin("h2", "h3", "h4")).select("page_id", "pre", "last", "parent")
    fh_text = _texts(nodes, fh.select("page_id", "pre", "last"))
    fh = fh.join(fh_text, ["page_id", "pre"]).filter(F.col("text") != "")
    # siblings under the same parent, sessionized by the heading before them
    sibs = nodes.join(fh.select("page_id", F.col("parent")).distinct(), ["page_id", "parent"]).filter(
        is_elem()).select("page_id", "parent", "pre", "last", "tag")
    sw = Window.partitionBy("page_id", "parent").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sibs = sibs.withColumn(
        "h_pre", F.max(F.when(F.col("tag").isin("h2", "h3", "h4"), F.col("pre"))).over(sw)
    ).filter(F.col("h_pre").isNotNull() & F.col("tag").isin(*BLOCK_TAGS))
    fb_text = block_text(nodes, sibs.select("page_id", "pre", "last", "tag"))
    fb_content = _assemble(sibs.join(fb_text, ["page_id", "pre"]), ["page_id", "h_pre"])
    fallback = (
        fh.join(fb_content, (fh.page_id == fb_content.page_id) & (fh.pre == fb_content.h_pre), "left")
        .select(fh.page_id, fh.pre.alias("ord"), fh.text.alias("title"), F.coalesce("content", F.lit("")).alias("content"))
        .filter(F.col("content") != "")
    )
    return primary.unionByName(fallback)


def summary(nodes: DataFrame, reg: DataFrame | None = None) -> DataFrame:
    """``(page_id, summary)``.

    If the region has an h1: the next p in document order (it may lie outside
    the region) when its cleaned text is longer than 20; otherwise the first
    of the region's first five p's longer than 20; else ''.
    """
    reg = detail_region(nodes) if reg is None else reg
    h1 = first_match(in_region(nodes, reg), F.col("tag") == "h1", "h1")
    ps = nodes.filter(is_elem() & (F.col("tag") == "p")).select("page_id", "pre", "last")
    nxt = (
        ps.join(h1, "page_id").filter(F.col("pre") > F.col("h1_pre"))
        .groupBy("page_id").agg(F.min(F.struct("pre", "last")).alias("_p")).select("page_id", "_p.pre", "_p.last")
    )
    first5 = in_region(ps, reg).withColumn("_k", F.row_number().over(Window.partitionBy("page_id").orderBy("pre")))
    first5 = first5.filter(F.col("_k") <= 5).select("page_id", "pre", "last")
    txt = _texts(nodes, nxt.unionByName(first5).distinct())
    after_h1 = nxt.join(txt, ["page_id", "pre"]).filter(F.length("text") > 20).select("page_id", F.col("text").alias("_a"))
    fallback = (
        first5.join(txt, ["page_id", "pre"]).filter(F.length("text") > 20)
        .groupBy("page_id").agg(F.min(F.struct("pre", "text")).alias("_f"))
        .select("page_id", F.col("_f.text").alias("_b"))
    )
    return (
        reg.select("page_id").join(after_h1, "page_id", "left").join(fallback, "page_id", "left")
        .select("page_id", F.coalesce("_a", "_b", F.lit("")).alias("summary"))
    )


def detail_page(nodes: DataFrame, pages: DataFrame, category: DataFrame | None = None, stripped: bool = False) -> DataFrame:
    """One ``ContentData`` row per page.

    ``nodes`` must come from ``html_nodes(mode='detail')``; junk (B3) is
    removed here unless ``stripped`` says it already was.  ``category`` optionally supplies ``(page_id, category)``.
    Columns: page_id, title, category, summary, sections array<struct<title,
    content>>, source_url, total_text_length.
    """
    from pagefold.operators.junk import strip_junk_detail

    kept = nodes if stripped else strip_junk_detail(nodes)
    reg = detail_region(kept)
    secs = sections(kept, reg)
    sec_arr = secs.groupBy("page_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "title", "content"))),
                    lambda x: F.struct(x["title"].alias("title"), x["content"].alias("content"))).alias("sections")
    )
    base = pages.select("page_id", F.col("url").alias("source_url"))
    if category is not None:
        base = base.join(category, "page_id", "left")
    else:
        base = base.withColumn("category", F.lit(""))
    out = (
        base.join(title_detail(pages, kept), "page_id", "left")
        .join(summary(kept, reg), "page_id", "left")
        .join(sec_arr, "page_id", "left")
    )
    secs_col = F.coalesce("sections", F.array().cast("array<struct<title:string,content:string>>"))
    return out.select(
        "page_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        secs_col.alias("sections"),
        "source_url",
        F.aggregate(secs_col, F.lit(0), lambda acc, s: acc + F.length(s["content"])).alias("total_text_length"),
    )
