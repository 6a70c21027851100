"""The generic-page parse.

``node_lines`` gives every node its own output line (strings, list items, headings, paragraphs,
tables) once; ``structured_text`` assembles the text of any set of root elements from the slices of
their page's lines (``dom.gather``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions.text import pystrip
from pagefold.operators.dom import attr, gather, has_attr, has_class, is_elem, is_string, subtree_text
from pagefold.session import materialize

HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


def _text_of(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """``get_text(strip=True)`` of targets, '' for targets without strings."""
    t = subtree_text(nodes, targets)
    return targets.select("page_id", "pre").join(t, ["page_id", "pre"], "left").select(
        "page_id", "pre", F.coalesce("text", F.lit("")).alias("text"))


def table_text(nodes: DataFrame, tables: DataFrame) -> DataFrame:
    """``(page_id, pre) → text``: cells of each tr (td/th, stripped) joined ' | ',
    rows joined '\\n', wrapped in '\\n' … '\\n'; rows without cells dropped; nested rows included."""
    span = ["page_id", "pre", "last"]
    cells = _text_of(nodes, nodes.filter(is_elem() & F.col("tag").isin("td", "th")).select(*span))
    rows = gather(nodes.filter(is_elem() & (F.col("tag") == "tr")).select(*span), cells.select("page_id", "pre", F.col("text").alias("v")),
                  lambda x, t: F.when(F.size(x) > 0, F.array_join(x, " | ")), "v").filter("v is not null")
    body = gather(tables.select(*span), rows.select("page_id", "pre", "v"),
                  lambda x, t: F.when(F.size(x) > 0, F.concat(F.lit("\n"), F.array_join(x, "\n"), F.lit("\n"))).otherwise(F.lit("")), "text")
    return body.select("page_id", "pre", "text")


def markup(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """A fingerprint of each target's whole subtree ``(page_id, pre, sig)``: tags, attributes (in any order),
    strings and nesting, its own tag and attributes included.  Equal fingerprints mean equal markup."""
    attrs = F.to_json(F.sort_array(F.map_entries("attrs")))
    node = F.when(is_elem(), F.concat(F.lit("<"), "tag", F.lit(" "), F.coalesce(attrs, F.lit("")))).otherwise(F.concat(F.lit("="), "text"))
    parts = nodes.filter(is_elem() | is_string()).select("page_id", "pre", F.struct("depth", node.alias("m")).alias("v"))
    own = targets.select("page_id", "pre", "last", "depth").withColumn("pre", F.col("pre") - 1)  # the element itself, too
    inside = lambda x, t: F.md5(F.to_json(F.transform(x, lambda e: F.struct((e["depth"] - t["depth"]).alias("d"), e["m"].alias("m")))))
    return gather(own, parts, inside, "sig").select("page_id", (F.col("pre") + 1).alias("pre"), "sig")


def node_lines(nodes: DataFrame) -> DataFrame:
    """Every node's own line for B8: ``(page_id, pre, line)``.

    string → stripped string (if non-empty); li → "- t" or "n. t" (n from
    the nearest ol ancestor's direct li children, the first one of equal
    markup winning); h1–h6 → "\\n## t\\n"; p → "\\nt\\n"; table → B9 (always,
    even when empty).  Elements with empty text give no line (tables excepted).
    """
    strings = nodes.filter(is_string()).select("page_id", "pre", pystrip("text").alias("line")).filter(F.col("line") != "")
    elems = nodes.filter(is_elem() & F.col("tag").isin("li", "p", *HEADINGS)).select("page_id", "pre", "last", "tag")
    elems = elems.join(subtree_text(nodes, elems), ["page_id", "pre"])
    # ordered-list index for li
    lis = nodes.filter(is_elem() & (F.col("tag") == "li") & F.col("ol").isNotNull()).select("page_id", "pre", "last", "depth", "parent", "ol")
    lis = lis.join(markup(nodes, lis), ["page_id", "pre"])
    direct = lis.filter(F.col("parent") == F.col("ol")).withColumn(
        "k", F.row_number().over(Window.partitionBy("page_id", "ol").orderBy("pre")))
    first_k = direct.groupBy("page_id", "ol", "sig").agg(F.min("k").alias("idx"))
    lis = lis.join(first_k, ["page_id", "ol", "sig"], "left").select("page_id", "pre", F.coalesce("idx", F.lit(1)).alias("idx"))
    elems = elems.join(lis, ["page_id", "pre"], "left")
    tag = F.col("tag")
    level = F.regexp_extract(tag, "h([1-6])", 1)
    line = (
        F.when((tag == "li") & F.col("idx").isNotNull(), F.concat(F.col("idx").cast("string"), F.lit(". "), "text"))
        .when(tag == "li", F.concat(F.lit("- "), "text"))
        .when(tag == "p", F.concat(F.lit("\n"), "text", F.lit("\n")))
        .otherwise(F.concat(F.lit("\n"), F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), "text", F.lit("\n")))
    )
    elines = elems.select("page_id", "pre", line.alias("line"))
    tables = nodes.filter(is_elem() & (tag == "table")).select("page_id", "pre", "last")
    tlines = table_text(nodes, tables).select("page_id", "pre", F.col("text").alias("line"))
    return strings.unionByName(elines).unionByName(tlines)


def mark_removed(lines: DataFrame, removed: DataFrame) -> DataFrame:
    """``lines`` with ``gone_at``: the first ``at`` of the ``removed(page_id, pre, last, at)`` subtrees that hold the
    line, NULL when none does."""
    own = removed.select("page_id", (F.col("pre") - 1).alias("pre"), "last", "at")
    held = gather(own, lines.select("page_id", "pre", F.col("pre").alias("v")), lambda x, t: x, "held")
    gone = held.select("page_id", F.explode("held").alias("pre"), "at").groupBy("page_id", "pre").agg(F.min("at").alias("gone_at"))
    return lines.join(gone, ["page_id", "pre"], "left")


def structured_text(lines: DataFrame, roots: DataFrame, in_order: bool = False) -> DataFrame:
    """B8 for root elements ``roots(page_id, pre, last)`` → ``(page_id, pre, text)``.

    Lines of all descendants (not the root itself) in document order,
    joined by '\\n', runs of 3+ newlines squeezed to 2, stripped.  Lines that
    ``mark_removed`` marked are left out; with ``in_order`` only those that
    were removed no later than the root's turn.
    """
    r = roots.select("page_id", "pre", "last").distinct()
    if "gone_at" not in lines.columns:
        items, kept = lines.select("page_id", "pre", F.col("line").alias("v")), lambda x, t: x
    elif not in_order:
        items, kept = lines.filter("gone_at is null").select("page_id", "pre", F.col("line").alias("v")), lambda x, t: x
    else:
        items = lines.select("page_id", "pre", F.struct("line", "gone_at").alias("v"))
        kept = lambda x, t: F.transform(F.filter(x, lambda e: F.coalesce(e["gone_at"] > t["pre"], F.lit(True))), lambda e: e["line"])
    text = lambda x, t: F.array_join(kept(x, t), "\n")
    return gather(r, items, text, "t").select("page_id", "pre", pystrip(F.regexp_replace("t", "\n{3,}", "\n\n")).alias("text"))


# ------------------------------------------------------------------ selectors
def selector_pred(selector: str) -> Column:
    """Predicate for one compound selector: tag, .class, #id, [attr], [attr=v], [attr*=v]."""
    import re

    pred = is_elem()
    pos = 0
    tok = re.compile(r"""([a-zA-Z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:(\*?=)\s*["']?([^"'\]]*)["']?)?\s*\]""")
    for m in tok.finditer(selector.strip()):
        if m.start() != pos:
            raise ValueError(f"unsupported selector: {selector!r}")
        pos = m.end()
        tag, cls, idv, an, op, av = m.groups()
        if tag:
            pred = pred & (F.col("tag") == tag.lower())
        elif cls:
            pred = pred & has_class(cls)
        elif idv:
            pred = pred & F.coalesce(attr("id") == idv, F.lit(False))
        elif op == "=":
            pred = pred & F.coalesce(attr(an) == av, F.lit(False))
        elif op == "*=":
            pred = pred & F.coalesce(F.instr(attr(an), av) > 0, F.lit(False))
        else:
            pred = pred & has_attr(an)
    if pos != len(selector.strip()):
        raise ValueError(f"unsupported selector: {selector!r}")
    return pred


def content_area(nodes: DataFrame, selector: str | None) -> DataFrame:
    """Per page the area ``(page_id, a_pre, a_last)``: first match of ``selector``, else the document."""
    root = nodes.filter(F.col("kind") == "root").select("page_id", F.col("pre").alias("a_pre"), F.col("last").alias("a_last"))
    if not selector:
        return root
    first = nodes.filter(selector_pred(selector)).groupBy("page_id").agg(F.min(F.struct("pre", "last")).alias("_m"))
    return root.join(first, "page_id", "left").select(
        "page_id", F.coalesce("_m.pre", "a_pre").alias("a_pre"), F.coalesce("_m.last", "a_last").alias("a_last"))


def within_area(nodes: DataFrame, area: DataFrame, include_self: bool = True) -> DataFrame:
    lo = F.col("pre") >= F.col("a_pre") if include_self else F.col("pre") > F.col("a_pre")
    return nodes.join(area, "page_id").filter(lo & (F.col("pre") <= F.col("a_last"))).drop("a_pre", "a_last")


def raw_text_region(nodes: DataFrame, area: DataFrame) -> DataFrame:
    """B6 inside the area: first main/article/#content/.content/body among its descendants, else the area."""
    from pagefold.operators.text import region_priority

    inside = within_area(nodes, area, include_self=False).withColumn("_prio", region_priority()).filter(
        F.col("_prio").isNotNull() & (F.col("_prio") < 6))
    best = inside.groupBy("page_id").agg(F.min(F.struct("_prio", "pre", "last")).alias("_r"))
    return area.join(best, "page_id", "left").select(
        "page_id", F.coalesce("_r.pre", "a_pre").alias("r_pre"), F.coalesce("_r.last", "a_last").alias("r_last"))


def main_region(nodes: DataFrame, area: DataFrame) -> DataFrame:
    """B10 region: first main; else first article/div with a class token containing 'content'
    (case-insensitive); else the area itself.  ``(page_id, pre, last)``."""
    inside = within_area(nodes, area, include_self=False).filter(is_elem())
    prio = F.when(F.col("tag") == "main", 1).when(
        F.col("tag").isin("article", "div")
        & F.coalesce(F.exists("classes", lambda c: F.instr(F.lower(c), "content") > 0), F.lit(False)), 2)
    best = inside.withColumn("_p", prio).filter(F.col("_p").isNotNull()).groupBy("page_id").agg(
        F.min(F.struct("_p", "pre", "last")).alias("_m"))
    return area.join(best, "page_id", "left").select(
        "page_id", F.coalesce("_m.pre", "a_pre").alias("pre"), F.coalesce("_m.last", "a_last").alias("last"))


# ------------------------------------------------------------- interactive
def _take_summaries(batches):
    """Per page, in document order: each ``details`` takes the first ``summary`` inside it that none before
    took, and that stands in none taken before (its subtree is gone, like the ``details`` in it)."""
    import pyarrow as pa

    names, kinds = ["page_id", "d_pre", "pre", "last"], [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    for batch in batches:
        out = [[], [], [], []]
        for page, details, summaries in zip(*(batch.column(c).to_pylist() for c in ("page_id", "d", "s"))):
            free = list(range(len(summaries) + 1))  # the next summary that is not gone

            def first(k):
                while free[k] != k:
                    free[k] = free[free[k]]
                    k = free[k]
                return k

            k = 0
            for d in details:
                while k < len(summaries) and summaries[k]["pre"] <= d["pre"]:
                    k += 1
                at = first(k)
                if at == len(summaries) or summaries[at]["pre"] > d["last"]:
                    continue
                s = summaries[at]
                j = at
                while j < len(summaries) and summaries[j]["pre"] <= s["last"]:
                    free[j], j = j + 1, j + 1
                for column, x in zip(out, (page, d["pre"], s["pre"], s["last"])):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)


def removed_summaries(nodes: DataFrame, area: DataFrame) -> DataFrame:
    """B19 side effect: ``(page_id, d_pre, pre, last)``, the ``summary`` that each ``details`` removes.

    In document order each ``details`` removes the first ``summary`` that is still inside it, so of nested
    ones the outer may take the inner's.  One row per page with its few intervals goes through
    a small helper, since each choice depends on the ones before.
    """
    inside = within_area(nodes, area).filter(is_elem() & F.col("tag").isin("details", "summary"))
    spans = lambda tag: F.sort_array(F.collect_list(F.when(F.col("tag") == tag, F.struct("pre", "last"))))
    of_page = inside.groupBy("page_id").agg(spans("details").alias("d"), spans("summary").alias("s"))
    of_page = of_page.filter((F.size("d") > 0) & (F.size("s") > 0))
    return of_page.mapInArrow(_take_summaries, "page_id long, d_pre int, pre int, last int")


def interactive_sections(nodes: DataFrame, lines: DataFrame, area: DataFrame, removed: DataFrame) -> DataFrame:
    """B18 + B19 + B20 → B21: ``(page_id, kind_order, pre, section_type, section_name, content, selector)``.

    Accordions are read before any summary is removed, each ``details`` after its own and all earlier
    removals, tabs after all of them.
    """
    inside = within_area(nodes, area).filter(is_elem())
    # The panel is the element that aria-controls names, else the next element sibling
    after = Window.partitionBy("page_id", "parent").orderBy("pre")
    btn = inside.withColumn("next", F.lead(F.struct("pre", "last")).over(after))
    btn = btn.filter(((F.col("tag") == "button") & has_attr("aria-expanded")) | has_class("accordion-button"))
    btn = btn.select("page_id", "pre", "last", "next", attr("aria-controls").alias("controls"))
    bname = _text_of(nodes, btn.select("page_id", "pre", "last"))
    ids = inside.filter(has_attr("id")).groupBy("page_id", attr("id").alias("controls")).agg(F.min(F.struct("pre", "last")).alias("named"))
    named = F.coalesce(F.col("controls") != "", F.lit(False))
    acc = btn.join(ids, ["page_id", "controls"], "left").withColumn("panel", F.when(named, F.col("named")).otherwise(F.col("next")))
    acc = acc.filter("panel is not null").select(
        "page_id", "pre", F.col("panel.pre").alias("panel"), F.col("panel.last").alias("panel_last"),
        F.when(named, F.concat(F.lit("#"), "controls")).alias("selector"))
    acc_txt = structured_text(lines, acc.select("page_id", F.col("panel").alias("pre"), F.col("panel_last").alias("last")))
    acc = (
        acc.join(bname, ["page_id", "pre"])
        .join(acc_txt.withColumnRenamed("pre", "panel").withColumnRenamed("text", "content"), ["page_id", "panel"])
        .select("page_id", F.lit(1).alias("kind_order"), "pre", F.lit("accordion").alias("section_type"),
                F.col("text").alias("section_name"), "content", "selector")
    )
    marked = mark_removed(lines, removed.withColumnRenamed("d_pre", "at"))
    # B19 details: name = the text of the summary that it removed
    det = inside.filter(F.col("tag") == "details").select("page_id", "pre", "last")
    sname = _text_of(nodes, removed.select("page_id", "pre", "last")).select(
        "page_id", F.col("pre").alias("s_pre"), F.col("text").alias("sname"))
    named_by = removed.select("page_id", F.col("d_pre").alias("pre"), F.col("pre").alias("s_pre")).join(sname, ["page_id", "s_pre"])
    det = det.join(named_by, ["page_id", "pre"], "left")
    d_txt = structured_text(marked, det, in_order=True)
    details = det.join(d_txt, ["page_id", "pre"]).select(
        "page_id", F.lit(2).alias("kind_order"), "pre", F.lit("details").alias("section_type"),
        F.coalesce("sname", F.lit("Details")).alias("section_name"),
        F.col("text").alias("content"), F.lit(None).cast("string").alias("selector"))
    # B20 tabs: name from the first button (else a) whose aria-controls is the panel id
    panels = inside.filter(F.coalesce(attr("role") == "tabpanel", F.lit(False))).select("page_id", "pre", "last", attr("id").alias("pid"))
    ctl = inside.filter(F.col("tag").isin("button", "a") & has_attr("aria-controls"))
    span = F.struct("pre", "last")
    ctl = ctl.groupBy("page_id", attr("aria-controls").alias("pid")).agg(
        F.min(F.when(F.col("tag") == "button", span)).alias("b"), F.min(F.when(F.col("tag") == "a", span)).alias("a"))
    panels = panels.join(ctl, ["page_id", "pid"], "left").withColumn("ctl", F.when(F.coalesce(F.col("pid") != "", F.lit(False)), F.coalesce("b", "a")))
    cname = _text_of(nodes, panels.filter("ctl is not null").select("page_id", "ctl.pre", "ctl.last").distinct())
    cname = cname.select("page_id", F.col("pre").alias("c_pre"), F.col("text").alias("cname"))
    p_txt = structured_text(marked, panels)
    tabs = panels.withColumn("c_pre", F.col("ctl.pre")).join(cname, ["page_id", "c_pre"], "left").join(p_txt, ["page_id", "pre"]).select(
        "page_id", F.lit(3).alias("kind_order"), "pre", F.lit("tab").alias("section_type"),
        F.when(F.col("c_pre").isNull(), F.lit("Tab")).otherwise(F.col("cname")).alias("section_name"),
        F.col("text").alias("content"),
        F.when(F.coalesce(F.col("pid") != "", F.lit(False)), F.concat(F.lit("#"), "pid")).alias("selector"))
    return acc.unionByName(details).unionByName(tabs)


def expandable_elements(nodes: DataFrame) -> DataFrame:
    """Collapsed elements ``(page_id, kind_order, pre, tag, kind)``; an element may appear once per kind."""
    e = nodes.filter(is_elem())
    kinds = F.array(
        F.when((F.col("tag") == "button") & F.coalesce(attr("aria-expanded") == "false", F.lit(False)), F.lit("1accordion")),
        F.when((F.col("tag") == "details") & ~has_attr("open"), F.lit("2details")),
        F.when(has_class("collapse") & ~has_class("show"), F.lit("3collapse")),
        F.when(F.coalesce(attr("role") == "tab", F.lit(False)) & F.coalesce(attr("aria-selected") == "false", F.lit(False)),
               F.lit("4tab")),
    )
    out = e.select("page_id", "pre", "tag", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return out.select("page_id", F.substring("k", 1, 1).cast("int").alias("kind_order"), "pre", "tag",
                      F.expr("substring(k, 2)").alias("kind"))


def generic_page(nodes: DataFrame, pages: DataFrame, link_filter: str = "same_path", follow_all: bool = False,
                 content_area_selector: str | None = None, depth: int | None = None, parent_url: str | None = None,
                 kept: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """One ``GenericPageData`` row per page.

    Order as in the reference: links on the full page; junk removal; title;
    content area; raw text; interactive sections (details remove their
    summaries); main content without those summaries.  ``kept`` (nodes
    after junk removal) and ``lines`` (their B8 lines) may be passed in
    when already staged.
    """
    from pagefold.operators.junk import strip_junk_generic
    from pagefold.operators.links import categorize_links
    from pagefold.operators.text import plain_text, title_generic

    links = categorize_links(nodes, pages, link_filter, follow_all)
    if kept is None:
        kept = materialize(strip_junk_generic(nodes), "generic-kept", sort=["page_id", "pre"])
    title = title_generic(pages, kept)
    area = content_area(kept, content_area_selector)
    raw = plain_text(kept, raw_text_region(kept, area))
    if lines is None:
        lines = materialize(node_lines(kept), "generic-lines", sort=["page_id", "pre"])
    removed = removed_summaries(kept, area)
    inter = interactive_sections(kept, lines, area, removed)
    main = structured_text(mark_removed(lines, removed.withColumnRenamed("d_pre", "at")), main_region(kept, area))
    inter_arr = inter.groupBy("page_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("kind_order", "pre", "section_type", "section_name", "content", "selector"))),
        lambda x: F.struct(x["section_type"].alias("section_type"), x["section_name"].alias("section_name"),
                           x["content"].alias("content"), x["selector"].alias("selector"))).alias("interactive_sections"))
    ref = links.filter(F.col("bucket") == "referenced").groupBy("page_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("stage", "ord", "text", "url", "context"))),
        lambda x: F.struct(x["text"].alias("text"), x["url"].alias("url"), x["context"].alias("context"))).alias("referenced_links"))
    disc = links.filter(F.col("bucket") == "structural").groupBy("page_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("stage", "ord", "url"))), lambda x: x["url"]).alias("discovered_links"))
    empty_inter = F.array().cast("array<struct<section_type:string,section_name:string,content:string,selector:string>>")
    return (
        pages.select("page_id", "url")
        .join(title, "page_id", "left").join(raw, "page_id", "left")
        .join(main.select("page_id", F.col("text").alias("main_content")), "page_id", "left")
        .join(inter_arr, "page_id", "left").join(ref, "page_id", "left").join(disc, "page_id", "left")
        .select(
            "page_id", "url", "title", "raw_text", F.coalesce("main_content", F.lit("")).alias("main_content"),
            F.coalesce("interactive_sections", empty_inter).alias("interactive_sections"),
            F.coalesce("referenced_links", F.array().cast("array<struct<text:string,url:string,context:string>>")).alias(
                "referenced_links"),
            F.coalesce("discovered_links", F.array().cast("array<string>")).alias("discovered_links"),
            F.lit(parent_url).cast("string").alias("parent_url"),
            F.lit(depth).cast("int").alias("depth"),
        )
    )
