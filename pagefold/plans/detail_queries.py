"""Registered detail-parse and listing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.functions.text import clean_text
from pagefold.operators.junk import strip_junk_detail
from pagefold.operators.links import listing_links
from pagefold.operators.sections import detail_page, sections, summary
from pagefold.operators.text import title_detail
from pagefold.operators.listing import completed_from_urls, listing_detail_join, listing_limit, pending_urls, stored_state_stats, write_state
from pagefold.plans import synth
from pagefold.plans.registry import register
from pagefold.plans.stage import corpus_nodes, derived_nodes, parse_table
from pagefold.session import materialize, scratch_path
from pagefold.sources.tables import scan_pages, table

# DuckDB forms of the cleaner (B12) and of the synthetic page layout
_JUNK = ["back to top", "skip to content", "skip to main content", "print this page", "share this page"]


def _sql_clean(x: str) -> str:
    out = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    for j in _JUNK:
        out = f"regexp_replace({out}, '(?i){j}', '', 'g')"
    return f"trim({out})"


_LINES = """lines AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS i,
    unnest(string_split(text, chr(10))) AS line FROM documents),
cl AS (SELECT *, """ + _sql_clean("line") + """ AS content,
    string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ')[1:5] AS w FROM lines)"""


def _section_nodes(spark, sf_dir, variant):
    docs = table(spark, sf_dir, "documents")
    pages = synth.section_pages(docs, variant)
    builder = {"primary": synth.section_pages_primary, "fallback": synth.section_pages_fallback,
               "blocks": synth.section_pages_blocks}[variant]
    return pages, derived_nodes(spark, sf_dir, "documents", builder, "detail", junk="detail")


@register("sections", "WITH " + _LINES + """
SELECT doc_id AS page_id, 'S' || i AS title, content FROM cl WHERE content <> ''""")
def q_sections(spark, sf_dir):
    """B14 (+B12, B16, B17) on h2/p section pages built from documents."""
    _, nodes = _section_nodes(spark, sf_dir, "primary")
    return sections(nodes).select("page_id", "title", "content")


@register("sections_fallback", "WITH " + _LINES + """
SELECT doc_id AS page_id, 'S' || i AS title, content FROM cl WHERE content <> ''""")
def q_sections_fallback(spark, sf_dir):
    """The same sections wrapped in one div, found by the sibling walk."""
    _, nodes = _section_nodes(spark, sf_dir, "fallback")
    return sections(nodes).select("page_id", "title", "content")


@register("block_text", "WITH " + _LINES + """,
b AS (SELECT doc_id, i, content,
   array_to_string(list_transform(list_filter(w, lambda x: x <> ''), lambda x: '- ' || x), chr(10)) AS ul,
   array_to_string(list_filter(list_transform(w, lambda x, k: CASE WHEN x <> '' THEN k || '. ' || x END), lambda x: x IS NOT NULL), chr(10)) AS ol,
   CASE WHEN len(list_filter(w, lambda x: x <> '')) > 0 THEN array_to_string(w, ' | ') ELSE '' END AS tb FROM cl)
SELECT doc_id AS page_id, 'S' || i AS title,
  array_to_string(list_filter([content, ul, ol, tb], lambda x: trim(x) <> ''), chr(10) || chr(10)) AS content
FROM b WHERE array_to_string(list_filter([content, ul, ol, tb], lambda x: trim(x) <> ''), chr(10) || chr(10)) <> ''""")
def q_block_text(spark, sf_dir):
    """B16 + B17: p, ul, ol and table blocks of each section, joined by blank lines."""
    _, nodes = _section_nodes(spark, sf_dir, "blocks")
    return sections(nodes).select("page_id", "title", "content")


_SUMMARY_SQL = "WITH " + _LINES + """,
f AS (SELECT doc_id, source, content, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM cl),
s AS (SELECT doc_id, coalesce(
    max(CASE WHEN k = 1 AND length(content) > 20 THEN content END),
    arg_min(CASE WHEN k <= 5 AND length(content) > 20 THEN content END, CASE WHEN k <= 5 AND length(content) > 20 THEN k END),
    '') AS summary FROM f GROUP BY doc_id),
t AS (SELECT doc_id, count(*) FILTER (content <> '') AS n_sections,
    CAST(coalesce(sum(length(content)) FILTER (content <> ''), 0) AS INTEGER) AS total_text_length FROM cl GROUP BY doc_id)
SELECT d.doc_id AS page_id, """ + _sql_clean("d.source") + """ AS title, s.summary, t.n_sections, t.total_text_length,
  'https://docs.example.org/primary/' || d.doc_id AS source_url
FROM documents d JOIN s USING (doc_id) JOIN t USING (doc_id)"""


@register("detail_page", _SUMMARY_SQL)
def q_detail_page(spark, sf_dir):
    """B24 with B5 title and B13 summary (after h1: the next p if longer than 20)."""
    pages, nodes = _section_nodes(spark, sf_dir, "primary")
    d = detail_page(nodes, pages, stripped=True)
    return d.select("page_id", "title", "summary", F.size("sections").cast("long").alias("n_sections"),
                    "total_text_length", "source_url")


@register("clean_text", "SELECT doc_id, " + _sql_clean("text") + " AS cleaned FROM documents")
def q_clean_text(spark, sf_dir):
    """B12 on whole document texts."""
    return table(spark, sf_dir, "documents").select("doc_id", clean_text("text").alias("cleaned"))


@register("title_detail", r"""SELECT page_id, trim(regexp_replace(replace(replace(
  regexp_extract(html,'(?s)<h1>(.*?)</h1>',1),'&quot;','"'),'&amp;','&'), '\s+', ' ', 'g')) AS title FROM pages""")
def q_title_detail(spark, sf_dir):
    """B3 + B5 on the corpus: first h1 text, cleaned, after detail junk removal."""
    pages = scan_pages(spark, sf_dir)
    kept = corpus_nodes(spark, sf_dir, "detail", junk="detail")
    return title_detail(pages, kept)


# ------------------------------------------------------------------ listings
_LISTING_SQL = "WITH " + _LINES + """,
h AS (SELECT doc_id, i, coalesce(w[1], '') AS head FROM cl),
r AS (SELECT doc_id, i, head,
   max(CASE WHEN head <> '' THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS j FROM h),
c AS (SELECT r.doc_id, r.i, CASE WHEN r.j IS NOT NULL AND r.i - r.j < 10 THEN h2.head WHEN r.i >= 10 THEN '' END AS category
   FROM r LEFT JOIN h h2 ON h2.doc_id = r.doc_id AND h2.i = r.j)
SELECT doc_id AS page_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, category,
  'L' || i AS title, 'https://docs.example.org/list/' || doc_id || '/d/' || doc_id || '/' || i AS url
FROM c WHERE category IS NOT NULL"""


def _listing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pages = synth.listing_pages(docs)
    return pages, listing_links(derived_nodes(spark, sf_dir, "documents", synth.listing_pages, "detail"), pages)


@register("listing_links", _LISTING_SQL)
def q_listing_links(spark, sf_dir):
    """C2 + C3: listing items with category from the nearest preceding heading."""
    return _listing(spark, sf_dir)[1]


@register("listing_pattern", _LISTING_SQL + " AND regexp_matches('/d/' || doc_id || '/' || i || '?x=1#f', '/[0-9]*[05][?]x')")
def q_listing_pattern(spark, sf_dir):
    """C2 with ``link_pattern``: only links whose href a regular expression finds (a search, not a full match)."""
    pages = synth.listing_pages(table(spark, sf_dir, "documents"))
    return listing_links(derived_nodes(spark, sf_dir, "documents", synth.listing_pages, "detail"), pages, link_pattern=r"/[0-9]*[05][?]x")


@register("listing_limit", "WITH q AS (" + _LISTING_SQL + ") SELECT * FROM q WHERE pos < 3")
def q_listing_limit(spark, sf_dir):
    """First N=3 listings of every listing page, in document order."""
    return listing_limit(_listing(spark, sf_dir)[1], 3)


def _completed(spark, sf_dir) -> DataFrame:
    """Completed set of the listing pipeline: the listings of labelled documents are done."""
    lst = _listing(spark, sf_dir)[1]
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    return completed_from_urls(spark, lst.join(labels, "page_id", "left_semi").select("url"))


_COMPLETED_SQL = "WITH q AS (" + _LISTING_SQL + "), done AS (SELECT url FROM q WHERE page_id IN (SELECT doc_id FROM labels))"


@register("pending_urls", _COMPLETED_SQL + " SELECT * FROM q WHERE url NOT IN (SELECT url FROM done)")
def q_pending_urls(spark, sf_dir):
    """Listings not yet completed (anti-join against the completed set)."""
    return pending_urls(_listing(spark, sf_dir)[1], _completed(spark, sf_dir))


@register("state_stats", _COMPLETED_SQL + """ SELECT count(DISTINCT url) AS completed_count, count(DISTINCT url) AS total_completed,
  true AS state_exists, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events) AS last_updated FROM done""")
def q_state_stats(spark, sf_dir):
    """E5 over the stored completed set; it was updated at the latest event's time."""
    path = scratch_path(spark, "state")
    updated = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]  # one scalar
    write_state(_completed(spark, sf_dir), path, updated)
    return stored_state_stats(spark, path).withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss"))


@register("listing_detail_join", "WITH q AS (" + _LISTING_SQL.replace("'https://docs.example.org/list/' || doc_id || '/d/'", "'https://docs.example.org/d/'") + "), " + _LINES + """,
s AS (SELECT doc_id, count(*) FILTER (content <> '') AS n_sections FROM cl GROUP BY doc_id)
SELECT q.page_id AS listing_page, q.category, d.doc_id * 2 + 1 AS page_id, 'S' AS marker, s.n_sections
FROM q JOIN documents d ON q.url = 'https://docs.example.org/d/' || d.doc_id || '/1' JOIN s ON s.doc_id = d.doc_id""")
def q_listing_detail_join(spark, sf_dir):
    """E6 + B24: listings joined with the detail pages they point to; the page gets the category."""
    docs = table(spark, sf_dir, "documents")
    pages = synth.listing_pages(docs).withColumn("url", F.regexp_replace("url", "/list/[0-9]+$", ""))
    nodes = derived_nodes(spark, sf_dir, "documents", synth.listing_pages, "detail")
    lst = listing_links(nodes, pages).withColumnRenamed("page_id", "listing_page")
    details = synth.detail_targets(docs)
    joined = materialize(listing_detail_join(lst.select("listing_page", "url", "category"), details), "listing-detail")
    dnodes = spark.table(parse_table(joined.select("page_id", "html"), "detail", "detail-nodes", junk="detail"))
    dp = detail_page(dnodes, joined.select("page_id", "url"), joined.select("page_id", "category"), stripped=True)
    return joined.select("listing_page", "page_id").join(dp, "page_id").select(
        "listing_page", "category", "page_id", F.lit("S").alias("marker"), F.size("sections").cast("long").alias("n_sections"))
