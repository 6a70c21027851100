"""Links as rows of the node table.

``categorize_links`` runs on the full page (before junk removal), in three
stages whose order decides which occurrence of a URL survives: tile links,
card links, then every other anchor in document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions.text import cut
from pagefold.functions.urls import follow_from_parts, normalize_url, with_resolved_url, with_url_parts
from pagefold.operators.dom import is_elem, attr, first_match, gather, has_attr, has_class, inside_flag, subtree_text
from pagefold.session import materialize

# Fixed values for link classification.
IGNORED_HREF_PREFIXES = ["javascript:", "mailto:", "tel:", "sms:", "ftp:"]
STRUCTURAL_CLASS_WORDS = ["section", "tab", "accordion", "nav", "tile", "card"]
STRUCTURAL_HREF_PARTS = ["/section/", "/category/", "/topic/"]
# Fixed values: ``X a`` selectors of the structural list (any of the X), and ``X button``.
STRUCTURAL_HOLDER_CLASSES = ["nav-tabs", "section-menu", "sidebar-nav", "table-of-contents", "next-section", "related-section", "sub-section"]
BUTTON_HOLDER_CLASS = "accordion-header"


def link_scan(nodes: DataFrame, texts: bool = True) -> DataFrame:
    """Every ``a[href]`` in document order with its ``get_text(strip=True)``.

    Output ``(page_id, pre, last, href, text, classes, ctx)``; without ``texts`` no ``text``, which costs
    one filtered scan only.
    """
    anchors = nodes.filter(is_elem() & (F.col("tag") == "a") & has_attr("href")).select(
        "page_id", "pre", "last", attr("href").alias("href"), "classes", "ctx"
    )
    if not texts:
        return anchors
    found = subtree_text(nodes, anchors)
    return anchors.join(found, ["page_id", "pre"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def ignore_flag(href: Column) -> Column:
    """Href empty, '#', or a javascript/mailto/tel/sms/ftp scheme."""
    out = (href == "") | (href == "#")
    for p in IGNORED_HREF_PREFIXES:
        out = out | href.startswith(p)
    return out


def _contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | (F.instr(c, w) > 0)
    return out


def _holds_structural_links() -> Column:
    """Elements X of the ``X a`` selectors."""
    tag = F.col("tag")
    out = ((tag == "li") & F.coalesce(attr("role") == "tab", F.lit(False))) | ((tag == "nav") & has_class("section-nav"))
    for c in STRUCTURAL_HOLDER_CLASSES:
        out = out | has_class(c)
    return out


def _matches_compound() -> Column:
    """Elements that match a structural selector of one compound."""
    tag = F.col("tag")
    return (
        ((tag == "button") & has_attr("data-tab"))
        | ((tag == "a") & F.coalesce(attr("role") == "tab", F.lit(False)))
        | has_class("tab-button")
        | ((tag == "button") & has_attr("aria-expanded"))
        | (tag == "summary")
        | has_class("accordion-button")
        | (has_class("card") & has_class("clickable"))
        | ((tag == "a") & has_class("section-card"))
        | ((tag == "a") & has_class("tile"))
    )


def structural_matches(nodes: DataFrame) -> DataFrame:
    """Elements ``(page_id, pre)`` that match a selector of the structural list, right to left: the element
    itself, then (for ``X a`` and ``X button``) any ancestor, wherever it stands."""
    holds_links, holds_buttons, tag = _holds_structural_links(), has_class(BUTTON_HOLDER_CLASS), F.col("tag")
    some = nodes.filter(is_elem() & (tag.isin("a", "button") | _matches_compound() | holds_links | holds_buttons))
    some = some.withColumn("_in_x", inside_flag(holds_links, include_self=False)).withColumn("_in_b", inside_flag(holds_buttons, include_self=False))
    return some.filter(_matches_compound() | ((tag == "a") & F.col("_in_x")) | ((tag == "button") & F.col("_in_b"))).select("page_id", "pre")


def structural_flag(nodes: DataFrame, anchors: DataFrame, follow_all: bool = False) -> DataFrame:
    """Per anchor ``(page_id, pre, structural)``.

    Effective rule: a descendant matches a structural selector (whose
    ancestor part may lie outside the link); or an ancestor is ``summary``;
    or a class token contains section/tab/accordion/nav/tile/card as a
    substring ('table' counts); or the href contains /section/, /category/
    or /topic/; or (unless following all links) the href is an in-page
    anchor ``#x``.  ``anchors`` has ``(page_id, pre, last, href, classes)``.
    """
    matches = structural_matches(nodes).withColumn("v", F.lit(True))
    flagged = gather(anchors.select("page_id", "pre", "last", "href", "classes"), matches, lambda x, t: F.size(x) > 0, "_desc")
    summaries = nodes.filter(is_elem() & (F.col("tag") == "summary")).select("page_id", "pre", "last")
    held = gather(summaries, anchors.select("page_id", "pre", F.col("pre").alias("v")), lambda x, t: x, "held")
    held = held.select("page_id", F.explode("held").alias("pre")).distinct().withColumn("_in_summary", F.lit(True))
    href = F.col("href")
    flag = (
        F.col("_desc")
        | F.coalesce(F.col("_in_summary"), F.lit(False))
        | F.coalesce(F.exists("classes", lambda c: _contains_any(c, STRUCTURAL_CLASS_WORDS)), F.lit(False))
        | _contains_any(href, STRUCTURAL_HREF_PARTS)
    )
    if not follow_all:
        flag = flag | (href.startswith("#") & (F.length(href) > 1))
    return flagged.join(held, ["page_id", "pre"], "left").select("page_id", "pre", flag.alias("structural"))


def link_context(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """C11: text of the nearest p/li/td/div ancestor, cut at 200 chars + '...'; '' if none."""
    near = anchors.select("page_id", "pre", F.col("ctx").alias("ctx_pre"))
    texts = subtree_text(
        nodes, near.filter(F.col("ctx_pre").isNotNull()).select("page_id", F.col("ctx_pre").alias("pre")),
    ).withColumnRenamed("pre", "ctx_pre")
    return near.join(texts, ["page_id", "ctx_pre"], "left").select(
        "page_id", "pre", F.coalesce(cut("text", 200, "..."), F.lit("")).alias("context")
    )


def _first_desc_link(anchors: DataFrame, holders: DataFrame) -> DataFrame:
    """For each holder element ``(page_id, pre, last)``: its first descendant anchor (not itself)."""
    links = anchors.select("page_id", "pre", F.struct("pre", "href").alias("v"))
    first = gather(holders, links, lambda x, t: F.get(x, F.lit(0)), "_f").filter("_f is not null")
    return first.select("page_id", F.col("pre").alias("h_pre"), F.col("_f.pre").alias("a_pre"), F.col("_f.href").alias("href"))


def tile_links(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """C9 candidates ``(page_id, stage, ord, href)``.

    Stage 1: in the first ``.tiles-container``, each ``.tile``'s first
    descendant ``a[href]`` (duplicates kept).  Stage 2: each element whose
    class attribute contains 'card' or 'tile' — its first descendant
    ``a[href]`` (an ``<a class=tile>`` does not match itself).
    """
    tc = first_match(nodes, has_class("tiles-container"), "tc")
    tiles = (
        nodes.filter(is_elem() & has_class("tile"))
        .join(tc, "page_id")
        .filter((F.col("pre") > F.col("tc_pre")) & (F.col("pre") <= F.col("tc_last")))
        .select("page_id", "pre", "last")
    )
    cls = F.coalesce(attr("class"), F.lit(""))
    cards = nodes.filter(is_elem() & has_attr("class") & ((F.instr(cls, "card") > 0) | (F.instr(cls, "tile") > 0))).select(
        "page_id", "pre", "last"
    )
    s1 = _first_desc_link(anchors, tiles).select("page_id", F.lit(1).alias("stage"), F.col("h_pre").alias("ord"), "a_pre", "href")
    s2 = _first_desc_link(anchors, cards).select("page_id", F.lit(2).alias("stage"), F.col("h_pre").alias("ord"), "a_pre", "href")
    return s1.unionByName(s2)


def link_candidates(nodes: DataFrame, pages: DataFrame, modes: list[str], anchors: DataFrame | None = None) -> DataFrame:
    """Resolved link candidates of C10 before bucketing.

    One row per tile link, card link and non-ignored anchor with its
    absolute ``url``, a ``follow_<mode>`` flag per requested filter mode,
    and ``_first``: whether this occurrence survives the URL dedupe
    (tiles keep duplicates; otherwise the first occurrence in stage order,
    skipped when a tile produced the URL).  Followability depends on the
    URL only, so the dedupe is computed once for all modes.
    """
    anchors = link_scan(nodes) if anchors is None else anchors
    base = pages.select("page_id", F.col("url").alias("page_url"))
    cands = tile_links(nodes, anchors).unionByName(
        anchors.filter(~ignore_flag(F.col("href"))).select(
            "page_id", F.lit(3).alias("stage"), F.col("pre").alias("ord"), F.col("pre").alias("a_pre"), "href"
        )
    )
    cands = with_resolved_url(cands.join(base, "page_id"), "href", "page_url", "url", keep_base_parts="_pp")
    cands = with_url_parts(cands, "url", "_lp")
    for mode in modes:
        cands = cands.withColumn(f"follow_{mode}", follow_from_parts(F.col("_lp"), F.col("_pp"), mode))
    by_url = Window.partitionBy("page_id", "url")
    cands = cands.withColumn("_min_stage", F.min("stage").over(by_url)).withColumn(
        "_rn", F.row_number().over(by_url.orderBy("stage", "ord"))
    )
    return cands.withColumn("_first", (F.col("stage") == 1) | ((F.col("_min_stage") > 1) & (F.col("_rn") == 1)))


def categorize_links(
    nodes: DataFrame, pages: DataFrame, link_filter: str = "same_path", follow_all: bool = False
) -> DataFrame:
    """Followable links of each page, split into ``structural`` and ``referenced``.

    ``pages`` supplies ``(page_id, url)``.  Output ``(page_id, stage, ord,
    bucket, url, text, context)``; ``(stage, ord)`` is the discovery order.
    A URL is kept once: its first occurrence (tiles keep their duplicates),
    and an anchor whose URL a tile or card already produced is skipped.
    The anchor table feeds five branches, so it is written once.
    """
    anchors = materialize(link_scan(nodes), "anchors", sort=["page_id", "pre"])
    cands = link_candidates(nodes, pages, [link_filter], anchors)
    kept = cands.filter(F.col(f"follow_{link_filter}") & F.col("_first"))
    structural = structural_flag(nodes, anchors, follow_all)
    kept = kept.join(structural.withColumnRenamed("pre", "a_pre"), ["page_id", "a_pre"], "left")
    is_struct = (F.col("stage") < 3) | F.lit(follow_all) | F.coalesce(F.col("structural"), F.lit(False))
    if follow_all:
        kept = kept.filter(~((F.col("stage") == 3) & (F.col("_lp.fragment") != "") & (F.col("_lp.path") == "")))
    ctx = link_context(nodes, anchors.select("page_id", "pre", "ctx")).withColumnRenamed("pre", "a_pre")
    txt = anchors.select("page_id", F.col("pre").alias("a_pre"), "text")
    out = kept.withColumn("bucket", F.when(is_struct, "structural").otherwise("referenced"))
    ref = out.filter(F.col("bucket") == "referenced").join(txt, ["page_id", "a_pre"], "left").join(ctx, ["page_id", "a_pre"], "left")
    st = out.filter(F.col("bucket") == "structural").withColumn("text", F.lit(None).cast("string")).withColumn(
        "context", F.lit(None).cast("string")
    )
    cols = ["page_id", "stage", "ord", "bucket", "url", "text", "context"]
    return ref.select(*cols).unionByName(st.select(*cols))


def listing_links(nodes: DataFrame, pages: DataFrame, link_pattern: str | None = None) -> DataFrame:
    """C2 + C3: listing items ``(page_id, pos, category, title, url)`` of a listing page.

    Per ``a[href]`` in document order: href stripped; skip empty; optional
    regex *search* on the stripped href; fragment, query and trailing '/'
    cut; URL normalized (C4) against the page URL; skip empty link text;
    category = nearest preceding h2/h3/h4 (enclosing counts) with text,
    looking back at most 10 headings — when the headings run out first the
    link is dropped, after 10 empty headings the category is ''.  Then the
    first occurrence of each URL wins.
    """
    anchors = link_scan(nodes)
    href = F.regexp_replace(F.col("href"), r"(?U)^\s+|\s+$", "")
    links = anchors.select("page_id", "pre", href.alias("href"), "text").filter(F.col("href") != "")
    if link_pattern:
        links = links.filter(F.regexp_like(F.col("href"), F.lit(link_pattern)))
    clean = F.regexp_replace(F.split(F.split(F.col("href"), "#", 2)[0], r"\?", 2)[0], "/+$", "")
    links = links.join(pages.select("page_id", F.col("url").alias("page_url")), "page_id").select(
        "page_id", "pre", normalize_url(clean, F.col("page_url")).alias("url"), F.col("text").alias("title")
    ).filter(F.col("title") != "")

    heads = nodes.filter(is_elem() & F.col("tag").isin("h2", "h3", "h4")).select("page_id", "pre", "last")
    htext = heads.join(subtree_text(nodes, heads), ["page_id", "pre"], "left").select(
        "page_id", "pre", F.coalesce("text", F.lit("")).alias("text"))
    # one ordered stream of headings and links; headings numbered in order
    stream = htext.select("page_id", "pre", F.lit(True).alias("is_h"), F.col("text").alias("htext"),
                          F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("title")).unionByName(
        links.select("page_id", "pre", F.lit(False).alias("is_h"), F.lit(None).cast("string").alias("htext"), "url", "title")
    )
    w = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stream = stream.withColumn("_hn", F.sum(F.col("is_h").cast("int")).over(w)).withColumn(
        "_last_nonempty", F.max(F.when(F.col("is_h") & (F.col("htext") != ""), F.struct("_hn", "htext"))).over(w)
    )
    # headings before a link are numbered 1.._hn; an enclosing heading has a smaller pre, so it is counted too
    items = stream.filter(~F.col("is_h"))
    hn, ln = F.col("_hn"), F.col("_last_nonempty")
    category = (
        F.when(ln.isNotNull() & (hn - ln["_hn"] < 10), ln["htext"])
        .when(hn >= 10, F.lit(""))
    )
    items = items.withColumn("category", category).filter(F.col("category").isNotNull())
    first = Window.partitionBy("page_id", "url").orderBy("pre")
    items = items.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1)
    pos = Window.partitionBy("page_id").orderBy("pre")
    return items.select("page_id", (F.row_number().over(pos) - 1).alias("pos"), "category", "title", "url")
