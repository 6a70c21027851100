"""Registered crawl queries (D1–D5) over URL-derived edges of the pages table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagefold.functions.urls import url_filename, url_netloc, with_resolved_url
from pagefold.operators.graph import bfs_over_links, bfs_pages, crawl_metadata, failed_urls
from pagefold.operators.links import link_scan
from pagefold.plans.registry import register
from pagefold.plans.stage import corpus_nodes, derived_nodes
from pagefold.sources.tables import scan_pages, table

# Crawl job parameters used by the registered queries (limits: depth ≤ 5, max_pages ≤ 500; the default budget is 50).
CRAWL_DEPTH = 5
CRAWL_MAX_PAGES = 50


def start_url(pages: DataFrame) -> str:
    """Start page: lowest page_id of the largest host (ties: smallest host name)."""
    hosts = pages.select("page_id", "url", url_netloc("url").alias("host"))
    sizes = hosts.groupBy("host").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "url")).alias("first"))
    row = sizes.orderBy(F.desc("n"), "host").select("first.url").first()
    return row["url"]


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = scan_pages(spark, sf_dir).select("page_id", "url")
    return bfs_pages(pages, pages.select("page_id"), start_url(pages), CRAWL_DEPTH, CRAWL_MAX_PAGES)


def _levels_sql(depth: int, max_pages: int) -> str:
    parts = [r"""WITH pg AS (SELECT page_id, url, regexp_extract(url,'^https?://([^/?#]*)',1) AS host,
       rtrim(regexp_extract(url,'^https?://[^/?#]*([^?#]*)',1),'/') AS path FROM pages),
pgx AS (SELECT *, regexp_replace(path,'/[^/]*$','') AS parent FROM pg),
hs AS (SELECT host, count(*) AS n, min(page_id) AS first_id FROM pgx GROUP BY host),
st AS (SELECT p.* FROM pgx p JOIN (SELECT first_id FROM hs ORDER BY n DESC, host LIMIT 1) s ON p.page_id = s.first_id),
l0 AS (SELECT page_id, url, 0 AS depth, [page_id] AS rank, CAST(NULL AS VARCHAR) AS via_url FROM st),
v0 AS (SELECT url FROM l0)"""]
    for k in range(1, depth + 1):
        parts.append(f"""c{k} AS (SELECT b.page_id, b.url, list_append(min(a.rank), b.page_id) AS rank, arg_min(a.url, a.rank) AS via_url
  FROM l{k-1} a JOIN pgx ap ON ap.page_id = a.page_id
  JOIN pgx b ON b.host = ap.host AND starts_with(b.path, ap.parent)
  WHERE b.url NOT IN (SELECT url FROM v{k-1}) GROUP BY b.page_id, b.url),
l{k} AS (SELECT page_id, url, {k} AS depth, rank, via_url FROM c{k}
  QUALIFY row_number() OVER (ORDER BY rank) <= {max_pages} - (SELECT count(*) FROM v{k-1})),
v{k} AS (SELECT url FROM v{k-1} UNION ALL SELECT url FROM l{k})""")
    union = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(depth + 1))
    return ",\n".join(parts) + f""",
allv AS ({union})
SELECT CAST(row_number() OVER (ORDER BY depth, rank) - 1 AS INTEGER) AS seq, page_id, url, depth, rank, 'ok' AS status,
  CASE WHEN depth = 0 THEN NULL ELSE (SELECT url FROM st) END AS parent_url, via_url FROM allv"""


_BFS_SQL = _levels_sql(CRAWL_DEPTH, CRAWL_MAX_PAGES)


@register("bfs_pages", _BFS_SQL)
def q_bfs_pages(spark, sf_dir):
    """D1 + D2 + D4: crawl log in FIFO order with depth, rank, status, recorded and true parent."""
    return crawl(spark, sf_dir)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src_url, dst_url, pos)``: every page's parsed links, resolved, each at its first position."""
    pages = scan_pages(spark, sf_dir)
    links = link_scan(corpus_nodes(spark, sf_dir), texts=False).join(pages.select("page_id", "url"), "page_id")
    resolved = with_resolved_url(links, "href", "url", "dst_url").filter(F.regexp_like("dst_url", F.lit("^https?://")))
    return resolved.groupBy(F.col("url").alias("src_url"), "dst_url").agg(F.min("pre").alias("pos"))


def link_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl along parsed links at the default depth of 1: what isn't in the corpus is a failed fetch."""
    pages = scan_pages(spark, sf_dir).select("page_id", "url")
    return bfs_over_links(page_links(spark, sf_dir), pages.groupBy("url").agg(F.min("page_id").alias("page_id")),
                          start_url(pages), 1, CRAWL_MAX_PAGES)


# depth 1: the start page, then its links by first position; successes beyond the budget are cut with what follows them
_LINK_CRAWL_SQL = r"""WITH pg AS (SELECT min(page_id) AS page_id, url FROM pages GROUP BY url),
hs AS (SELECT regexp_extract(url,'^https?://([^/?#]*)',1) AS host, count(*) AS n, min(page_id) AS first_id FROM pages GROUP BY 1),
st AS (SELECT url FROM pages WHERE page_id = (SELECT first_id FROM hs ORDER BY n DESC, host LIMIT 1)),
h AS (SELECT page_id, unnest(regexp_extract_all(html,'<a href="([^"]*)"',1)) AS href,
        generate_subscripts(regexp_extract_all(html,'<a href="([^"]*)"',1), 1) AS pos FROM pages WHERE url = (SELECT url FROM st)),
l AS (SELECT regexp_extract((SELECT url FROM st),'^https?://[^/?#]*',0) || href AS url, min(pos) AS pos FROM h GROUP BY 1),
c AS (SELECT 0 AS depth, 0 AS pos, (SELECT url FROM st) AS url, 'ok' AS status
  UNION ALL SELECT 1, l.pos, l.url, CASE WHEN pg.url IS NULL THEN 'failed' ELSE 'ok' END FROM l LEFT JOIN pg USING (url)
  WHERE l.url <> (SELECT url FROM st)),
w AS (SELECT *, sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) OVER (ORDER BY depth, pos) AS n_ok FROM c),
q AS (SELECT CAST(row_number() OVER (ORDER BY depth, pos) - 1 AS INTEGER) AS seq, * FROM w
  WHERE n_ok < """ + str(CRAWL_MAX_PAGES) + " OR (n_ok = " + str(CRAWL_MAX_PAGES) + """ AND status = 'ok'))
"""


@register("bfs_links", _LINK_CRAWL_SQL + "SELECT seq, url, depth, status FROM q")
def q_bfs_links(spark, sf_dir):
    """D1 over the links that the parser found: crawl log with successes and failures."""
    return link_crawl(spark, sf_dir).select("seq", "url", "depth", "status")


# A graph that the parsed links do hit: page d links to 2d+1, to a page that isn't there, to 2d+2 and back to d/2.
_DEEP_HREFS = ["'/n/' || (2 * {d} + 1)", "'/x/' || {d}", "'/n/' || (2 * {d} + 2)", "'/n/' || ({d} // 2)"]


def graph_pages(documents: DataFrame) -> DataFrame:
    """A page ``/n/{doc_id}`` per document with the four links above."""
    d = F.col("doc_id")
    hrefs = [F.concat(F.lit("/n/"), 2 * d + 1), F.concat(F.lit("/x/"), d), F.concat(F.lit("/n/"), 2 * d + 2),
             F.concat(F.lit("/n/"), F.floor(d / 2))]
    html = F.concat(*(F.concat(F.lit('<p><a href="'), h, F.lit('">x</a></p>')) for h in hrefs))
    return documents.select(d.alias("page_id"), F.concat(F.lit("https://h.org/n/"), d).alias("url"), html.alias("html"))


def _deep_sql(depth: int, max_pages: int) -> str:
    links = "unnest([" + ", ".join(h.format(d="d") for h in _DEEP_HREFS) + "]) AS href, unnest([0, 1, 2, 3]) AS pos"
    parts = ["""WITH pg AS (SELECT doc_id, '/n/' || doc_id AS href FROM documents),
l0 AS (SELECT href, 0 AS depth, [CAST(0 AS BIGINT)] AS rank, 1 AS ok, doc_id AS d FROM pg ORDER BY doc_id LIMIT 1),
v0 AS (SELECT href, ok FROM l0)"""]
    for k in range(1, depth + 1):
        parts.append(f"""e{k} AS (SELECT rank, {links} FROM l{k-1} WHERE ok = 1),
c{k} AS (SELECT e.href, min(list_append(rank, CAST(pos AS BIGINT))) AS rank, CAST(any_value(pg.href) IS NOT NULL AS INTEGER) AS ok, any_value(doc_id) AS d
  FROM e{k} e LEFT JOIN pg ON pg.href = e.href WHERE e.href NOT IN (SELECT href FROM v{k-1}) GROUP BY e.href),
s{k} AS (SELECT *, sum(ok) OVER (ORDER BY rank) AS n, {max_pages} - (SELECT sum(ok) FROM v{k-1}) AS rest FROM c{k}),
l{k} AS (SELECT href, {k} AS depth, rank, ok, d FROM s{k} WHERE n < rest OR (n = rest AND ok = 1)),
v{k} AS (SELECT * FROM v{k-1} UNION ALL SELECT href, ok FROM l{k})""")
    union = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(depth + 1))
    return ",\n".join(parts) + f""", a AS ({union})
SELECT CAST(row_number() OVER (ORDER BY depth, rank) - 1 AS INTEGER) AS seq, 'https://h.org' || href AS url, depth,
  CASE WHEN ok = 1 THEN 'ok' ELSE 'failed' END AS status FROM a"""


@register("bfs_links_deep", _deep_sql(CRAWL_DEPTH, CRAWL_MAX_PAGES))
def q_bfs_links_deep(spark, sf_dir):
    """D1 + D2 + D3 over parsed links, five levels deep, with failures inside the queue and a budget that cuts a level."""
    pages = graph_pages(table(spark, sf_dir, "documents")).select("page_id", "url")
    links = link_scan(derived_nodes(spark, sf_dir, "documents", graph_pages, "generic"), texts=False).join(pages, "page_id")
    resolved = with_resolved_url(links, "href", "url", "dst_url").groupBy(F.col("url").alias("src_url"), "dst_url").agg(F.min("pre").alias("pos"))
    start = pages.orderBy("page_id").first()["url"]
    return bfs_over_links(resolved, pages, start, CRAWL_DEPTH, CRAWL_MAX_PAGES).select("seq", "url", "depth", "status")


@register("failed_urls", _LINK_CRAWL_SQL + "SELECT seq, url, depth FROM q WHERE status = 'failed'")
def q_failed_urls(spark, sf_dir):
    """D3: URLs dequeued in the link crawl but not in the corpus."""
    return failed_urls(link_crawl(spark, sf_dir))


@register("crawl_metadata", "WITH c AS (" + _BFS_SQL + """)
SELECT CAST(count(*) AS BIGINT) AS total_pages, list(url ORDER BY seq) AS visited_urls,
  CAST([] AS VARCHAR[]) AS failed_urls, CAST(0 AS BIGINT) AS successful_enrichments, CAST(NULL AS VARCHAR) AS error FROM c""")
def q_crawl_metadata(spark, sf_dir):
    """D5 for the crawl above (no enrichment step in this query)."""
    return crawl_metadata(crawl(spark, sf_dir))


@register("numbered_pages", "WITH c AS (" + _BFS_SQL + """)
SELECT seq, url, printf('page_%03d_%s', seq, left(replace(replace(replace(replace(replace(url,'https://',''),'http://',''),
  '/','_'),'?','_'),'&','_'),100)) AS file_stem FROM c WHERE status = 'ok'""")
def q_numbered_pages(spark, sf_dir):
    """A4: raw-page file names ``page_{i:03d}_{urlname}``, i = position among stored pages."""
    # at most max_pages successes: the window over them is bounded
    c = crawl(spark, sf_dir).filter(F.col("status") == "ok").withColumn("seq", F.row_number().over(Window.orderBy("seq")) - 1)
    return c.select("seq", "url", F.format_string("page_%03d_%s", F.col("seq"), url_filename("url")).alias("file_stem"))
