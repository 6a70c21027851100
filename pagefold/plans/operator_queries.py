"""Single-operator keys of SURVEY §2 that the composite queries also exercise:
each reads the whole input table and has its own oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import generic as G
from pagefold.operators.dom import has_attr, is_elem
from pagefold.operators.junk import strip_junk_detail
from pagefold.operators.links import link_scan, listing_links
from pagefold.operators.listing import mark_completed, read_state, reset_state, write_state
from pagefold.operators.sections import summary
from pagefold.operators.text import plain_text, region, title_generic
from pagefold.plans import synth
from pagefold.plans.detail_queries import _COMPLETED_SQL, _LINES, _LISTING_SQL, _SUMMARY_SQL, _completed, _listing
from pagefold.plans.generic_queries import _CONV
from pagefold.plans.parse_queries import _ORACLE_RAW_TEXT, _ORACLE_TITLE
from pagefold.plans.registry import register
from pagefold.plans.stage import corpus_nodes, derived_nodes
from pagefold.session import scratch_path
from pagefold.sources.tables import scan_pages, table

# time of the states written by these queries (any value; a run passes its own)
_LATEST = "2024-01-01 00:00:00"
_COUNT = "CAST(len(regexp_extract_all(html, '{re}')) AS BIGINT)"


@register("scan_pages", "SELECT page_id, url, CAST(length(html) AS INTEGER) AS n_chars FROM pages")
def q_scan_pages(spark, sf_dir):
    """A1: the page corpus with a fixed schema."""
    return scan_pages(spark, sf_dir).select("page_id", "url", F.length("html").alias("n_chars"))


def _tag_counts(nodes):
    return nodes.groupBy("page_id").agg(
        F.count_if(is_elem() & (F.col("tag") == "p")).alias("n_p"),
        F.count_if(is_elem() & (F.col("tag") == "a")).alias("n_a"),
        F.count_if(is_elem() & (F.col("tag") == "li")).alias("n_li"),
        F.count_if(F.col("kind") == "comment").alias("n_comments"),
        F.count_if(is_elem() & (F.col("tag") == "script")).alias("n_script"),
    )


@register("html_nodes", "SELECT page_id, " + ", ".join(
    f"{_COUNT.format(re=r)} AS {n}" for r, n in (("<p>", "n_p"), ("<a ", "n_a"), ("<li>", "n_li"), ("<!--", "n_comments"),
                                                 ("<script>", "n_script"))) + " FROM pages")
def q_html_nodes(spark, sf_dir):
    """B1: element and comment counts per page from the node table."""
    return _tag_counts(corpus_nodes(spark, sf_dir, "generic"))


@register("strip_junk_generic", "SELECT page_id, " + _COUNT.format(re="<p>") + """ AS n_p, CAST(0 AS BIGINT) AS n_a,
  CAST(0 AS BIGINT) AS n_li, """ + _COUNT.format(re="<!--") + " AS n_comments, CAST(0 AS BIGINT) AS n_script FROM pages")
def q_strip_junk_generic(spark, sf_dir):
    """B2: what remains after generic junk removal (nav, scripts, … gone; comments stay)."""
    return _tag_counts(corpus_nodes(spark, sf_dir, "generic", junk="generic"))


@register("strip_junk_detail", "SELECT page_id, " + _COUNT.format(re="<p>") + """ AS n_p, CAST(0 AS BIGINT) AS n_a,
  CAST(0 AS BIGINT) AS n_li, """ + _COUNT.format(re="<!--") + " AS n_comments, " + _COUNT.format(re="<script>") + " AS n_script FROM pages")
def q_strip_junk_detail(spark, sf_dir):
    """Detail junk removal keeps scripts (left out later by get_text); on the lxml-style tree."""
    nodes = corpus_nodes(spark, sf_dir, "detail", junk="detail")
    return _tag_counts(nodes)


@register("title_generic", f"SELECT page_id, {_ORACLE_TITLE} AS title FROM pages")
def q_title_generic(spark, sf_dir):
    """First h1 (strings stripped and joined), else <title>, else 'Untitled'."""
    return title_generic(scan_pages(spark, sf_dir), corpus_nodes(spark, sf_dir, "generic", junk="generic"))


@register("plain_text", f"SELECT page_id, {_ORACLE_RAW_TEXT} AS raw_text FROM pages")
def q_plain_text(spark, sf_dir):
    """B6 + B7: the region's strings (comments included) joined and collapsed."""
    kept = corpus_nodes(spark, sf_dir, "generic", junk="generic")
    return plain_text(kept, region(kept))


@register("table_text", "WITH " + _LINES + """
SELECT doc_id AS page_id, chr(10) || array_to_string(w, ' | ') || chr(10) || chr(10) AS text FROM cl""")
def q_table_text(spark, sf_dir):
    """Table text (rows of cells, a row of one empty cell kept) of every table."""
    nodes = derived_nodes(spark, sf_dir, "documents", synth.blocks_pages_generic, "generic", junk="generic")
    tables = nodes.filter(is_elem() & (F.col("tag") == "table")).select("page_id", "pre", "last")
    return G.table_text(nodes, tables).select("page_id", "text")


@register("summary", "WITH d AS (" + _SUMMARY_SQL + ") SELECT page_id, summary FROM d")
def q_summary(spark, sf_dir):
    """Next p after the region's h1 if longer than 20, else the first long p of the first five."""
    nodes = derived_nodes(spark, sf_dir, "documents", synth.section_pages_primary, "detail", junk="detail")
    return summary(nodes)


def _interactive(spark, sf_dir):
    from pagefold.plans.stage import derived_lines

    nodes = derived_nodes(spark, sf_dir, "conversations", synth.conversation_pages, "generic", junk="generic")
    area = G.content_area(nodes, None)
    lines = derived_lines(spark, sf_dir, "conversations", synth.conversation_pages)
    return G.interactive_sections(nodes, lines, area, G.removed_summaries(nodes, area))


@register("accordions", _CONV + """
SELECT conv_id * 1000000 + turn AS page_id, 'Q' || turn AS section_name, content,
  CASE WHEN turn % 5 = 4 THEN NULL ELSE '#p' || conv_id || '-' || turn END AS selector
FROM c WHERE turn % 5 = 4 OR turn % 3 <> 2""")
def q_accordions(spark, sf_dir):
    """Accordion buttons with their panels (by aria-controls, else next sibling; missing panel → none)."""
    return _interactive(spark, sf_dir).filter(F.col("section_type") == "accordion").select(
        "page_id", "section_name", "content", "selector")


@register("details_sections", _CONV + """
SELECT conv_id * 1000000 + turn AS page_id, regexp_replace(role, '^\\s+|\\s+$', '', 'g') AS section_name, content FROM c""")
def q_details_sections(spark, sf_dir):
    """Details with their summary as name; the summary is removed from the content."""
    return _interactive(spark, sf_dir).filter(F.col("section_type") == "details").select("page_id", "section_name", "content")


@register("tab_panels", _CONV + """
SELECT conv_id * 1000000 + turn AS page_id, 'Tab ' || turn AS section_name, content, '#t' || conv_id || '-' || turn AS selector FROM c""")
def q_tab_panels(spark, sf_dir):
    """Tab panels named by the button whose aria-controls is their id."""
    return _interactive(spark, sf_dir).filter(F.col("section_type") == "tab").select("page_id", "section_name", "content", "selector")


@register("link_scan", r"""SELECT page_id, unnest(regexp_extract_all(html,'<a href="([^"]*)">',1)) AS href,
  replace(replace(unnest(regexp_extract_all(html,'<a href="[^"]*">([^<]*)</a>',1)),'&quot;','"'),'&amp;','&') AS text FROM pages""")
def q_link_scan(spark, sf_dir):
    """Every a[href] with its stripped text."""
    return link_scan(corpus_nodes(spark, sf_dir, "generic")).select("page_id", "href", "text")


@register("link_category", "WITH q AS (" + _LISTING_SQL + ") SELECT page_id, title, category FROM q")
def q_link_category(spark, sf_dir):
    """Category of each listing link from the nearest preceding non-empty heading (10 back)."""
    return _listing(spark, sf_dir)[1].select("page_id", "title", "category")


@register("mark_completed", _COMPLETED_SQL + """, q2 AS (SELECT url FROM q WHERE category <> '')
SELECT DISTINCT url FROM (SELECT url FROM done UNION ALL SELECT url FROM q2)""")
def q_mark_completed(spark, sf_dir):
    """Completed set ∪ newly parsed URLs (this run parsed the listings that carry a category), over stored
    versions: a second run that reads the first one's state changes nothing."""
    lst = _listing(spark, sf_dir)[1]
    parsed = lst.filter(F.col("category") != "").select("url")
    path = scratch_path(spark, "state")
    write_state(_completed(spark, sf_dir), path, _LATEST)
    for _ in range(2):
        write_state(mark_completed(read_state(spark, path)[0], parsed), path, _LATEST)
    return read_state(spark, path)[0]


@register("reset_state", _COMPLETED_SQL + """ SELECT CAST(0 AS BIGINT) AS n, (SELECT count(DISTINCT url) FROM done) AS n_before,
  (SELECT count(*) FROM q) AS n_listings""")
def q_reset_state(spark, sf_dir):
    """The stored state after a reset is empty; the version before it and the parsed data stay."""
    path = scratch_path(spark, "state")
    before = write_state(_completed(spark, sf_dir), path, _LATEST)
    write_state(reset_state(spark), path, _LATEST)
    n = read_state(spark, path)[0].agg(F.count("*").alias("n"))
    old = spark.read.parquet(before).agg(F.count("url").alias("n_before"))
    data = _listing(spark, sf_dir)[1].agg(F.count("*").alias("n_listings"))
    return n.join(old, F.lit(True)).join(data, F.lit(True))


_LINKS_SQL = "WITH " + _LINES + r""",
k AS (SELECT doc_id, i, i % 6 AS h, i % 4 AS c,
   regexp_replace(line, '^\s+|\s+$', '', 'g') || 'L' || i AS ctx FROM cl),
t AS (SELECT doc_id AS page_id, 'structural' AS bucket, 'https://docs.example.org/links/t' || doc_id AS url,
        CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS context FROM documents),
r AS (SELECT doc_id AS page_id,
   CASE WHEN h = 1 OR h = 4 OR (h = 5 AND c IN (1, 2)) THEN 'structural' ELSE 'referenced' END AS bucket,
   CASE WHEN h = 1 THEN 'https://docs.example.org/links/' || doc_id || '#x' || i
        WHEN h = 4 THEN 'https://docs.example.org/links/topic/' || i ELSE 'https://docs.example.org/links/p/' || i END AS url,
   CASE WHEN h = 5 AND c IN (0, 3) THEN 'L' || i END AS text,
   CASE WHEN h = 5 AND c IN (0, 3) THEN CASE WHEN length(ctx) > 200 THEN substr(ctx, 1, 200) || '...' ELSE ctx END END AS context
   FROM k WHERE h IN (1, 4, 5))
SELECT * FROM t UNION ALL SELECT * FROM t UNION ALL SELECT * FROM r"""


@register("link_classes", _LINKS_SQL)
def q_link_classes(spark, sf_dir):
    """C7 + C8 + C9 + C11 through C10: ignored hrefs, structural classes/hrefs/anchors, tile duplicates, context."""
    from pagefold.operators.links import categorize_links

    nodes = derived_nodes(spark, sf_dir, "documents", synth.link_pages, "generic")
    pages = synth.link_pages(table(spark, sf_dir, "documents")).select("page_id", "url")
    return categorize_links(nodes, pages, "same_path").select("page_id", "bucket", "url", "text", "context")
