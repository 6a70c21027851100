"""Registered queries over the page corpus: HTML → nodes → titles / text / links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.operators.dom import is_elem, has_attr
from pagefold.operators.text import plain_text, region, title_generic
from pagefold.plans.registry import register
from pagefold.plans.stage import corpus_nodes
from pagefold.sources.tables import scan_pages

# raw_text of the pages table: the region is <article>, which holds no junk or comment
_ORACLE_RAW_TEXT = r"""
trim(regexp_replace(array_to_string(list_filter(list_transform(
  regexp_split_to_array(regexp_extract(html,'(?s)<article>(.*)</article>',1),'<[^>]*>'),
  lambda x: regexp_replace(replace(replace(x,'&quot;','"'),'&amp;','&'),'^\s+|\s+$','','g')),
  lambda x: length(x)>1),' '),'\s+',' ','g'))"""
_ORACLE_TITLE = r"""replace(replace(trim(regexp_extract(html,'(?s)<h1>(.*?)</h1>',1)),'&quot;','"'),'&amp;','&')"""


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum slice: A1 → B1 → C1 (links before junk) → B2 → B4 → B6 → B7."""
    pages = scan_pages(spark, sf_dir)
    nodes = corpus_nodes(spark, sf_dir, "generic")
    n_links = (
        nodes.filter(is_elem() & (F.col("tag") == "a") & has_attr("href"))
        .groupBy("page_id")
        .agg(F.count("*").alias("n_links"))
    )
    kept = corpus_nodes(spark, sf_dir, "generic", junk="generic")
    title = title_generic(pages, kept)
    text = plain_text(kept, region(kept))
    return (
        pages.select("page_id")
        .join(title, "page_id", "left")
        .join(text, "page_id", "left")
        .join(n_links, "page_id", "left")
        .select(
            "page_id",
            "title",
            F.length("raw_text").alias("n_chars"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )


register(
    "page_summary",
    f"""SELECT page_id, {_ORACLE_TITLE} AS title, length({_ORACLE_RAW_TEXT}) AS n_chars,
         CAST(len(regexp_extract_all(html,'<a href="([^"]*)"',1)) AS BIGINT) AS n_links FROM pages""",
)(page_summary)


# ---------------------------------------------------------------- URL columns
from pagefold.functions import urls as U  # noqa: E402
from pagefold.operators.links import categorize_links, link_candidates, link_scan  # noqa: E402

_HOST = r"regexp_extract(url,'^https?://([^/?#]*)',1)"
_PATH = r"regexp_extract(url,'^https?://[^/?#]*([^?#]*)',1)"
_HREFS = r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html,'<a href="([^"]*)">',1)) AS href,
  unnest(regexp_extract_all(html,'<a href="[^"]*">([^<]*)</a>',1)) AS atext FROM pages)"""


@register("url_slug", f"""SELECT page_id, trim(lower(regexp_replace(regexp_replace(trim({_PATH},'/'),
  '[^\\p{{L}}\\p{{N}}_\\-]','_','g'),'_+','_','g')),'_') AS slug FROM pages""")
def q_url_slug(spark, sf_dir):
    """C13 over the corpus."""
    return scan_pages(spark, sf_dir).select("page_id", U.url_slug("url").alias("slug"))


@register("url_filename", """SELECT page_id, left(replace(replace(replace(replace(replace(url,'https://',''),
  'http://',''),'/','_'),'?','_'),'&','_'),100) AS filename FROM pages""")
def q_url_filename(spark, sf_dir):
    """C14 over the corpus."""
    return scan_pages(spark, sf_dir).select("page_id", U.url_filename("url").alias("filename"))


@register("in_scope", f"""SELECT page_id, ({_HOST} = 'thther.example.org' AND starts_with({_PATH}, '/en/')) AS in_scope
  FROM pages""")
def q_in_scope(spark, sf_dir):
    """C12 with domain and prefix as parameters."""
    return scan_pages(spark, sf_dir).select("page_id", U.in_scope("url", "thther.example.org", "/en/").alias("in_scope"))


@register("normalize_url", _HREFS + """ SELECT page_id, href, rtrim(url,'/') || href AS norm_url FROM l""")
def q_normalize_url(spark, sf_dir):
    """C4 on every link of every page (page URL as base)."""
    pages = scan_pages(spark, sf_dir)
    links = link_scan(corpus_nodes(spark, sf_dir))
    return links.join(pages, "page_id").select("page_id", "href", U.normalize_url("href", "url").alias("norm_url"))


@register("resolve_url", _HREFS + """ SELECT page_id, href, regexp_extract(url,'^https?://[^/?#]*',0) || href AS abs_url,
  replace(replace(atext,'&quot;','"'),'&amp;','&') AS text FROM l""")
def q_resolve_url(spark, sf_dir):
    """C1 + C5: every a[href] with its text and its URL resolved against the page URL."""
    pages = scan_pages(spark, sf_dir)
    links = link_scan(corpus_nodes(spark, sf_dir))
    joined = U.with_resolved_url(links.join(pages, "page_id"), "href", "url", "abs_url")
    return joined.select("page_id", "href", "abs_url", "text")


_LINK_COUNTS = r"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html,'<a href="([^"]*)"',1)) AS href FROM pages),
r AS (SELECT DISTINCT page_id, regexp_extract(url,'^https?://([^/?#]*)',1) AS host,
        rtrim(regexp_extract(url,'^https?://[^/?#]*([^?#]*)',1),'/') AS ppath,
        regexp_extract(url,'^https?://[^/?#]*',0)||href AS abs_url FROM l WHERE href LIKE '/%'),
q AS (SELECT *, regexp_extract(abs_url,'^https?://([^/?#]*)',1) AS lhost,
        rtrim(regexp_extract(abs_url,'^https?://[^/?#]*([^?#]*)',1),'/') AS lpath FROM r)
SELECT page_id, count(*) AS n_all, count(*) FILTER (lhost=host) AS n_domain,
  count(*) FILTER (lhost=host AND (starts_with(lpath, regexp_replace(ppath,'/[^/]*$','')) OR lpath=ppath)) AS n_path
FROM q GROUP BY page_id"""


@register("link_filters", _LINK_COUNTS)
def q_link_filters(spark, sf_dir):
    """C6 in all three modes through C10: followable links per page after first-occurrence dedupe.

    Candidates are resolved and deduplicated once; each mode is a flag on them.
    """
    pages = scan_pages(spark, sf_dir)
    cands = link_candidates(corpus_nodes(spark, sf_dir), pages, ["all", "same_domain", "same_path"])
    counts = cands.filter(F.col("_first")).groupBy("page_id").agg(
        *[F.count_if(F.col(f"follow_{m}")).alias(n) for m, n in (("all", "n_all"), ("same_domain", "n_domain"), ("same_path", "n_path"))])
    return counts.filter(F.col("n_all") > 0)


@register("categorize_links", _HREFS + """,
r AS (SELECT page_id, url, href, replace(replace(atext,'&quot;','"'),'&amp;','&') AS text,
        regexp_extract(url,'^https?://[^/?#]*',0) || href AS abs_url,
        rtrim(regexp_extract(url,'^https?://[^/?#]*([^?#]*)',1),'/') AS ppath FROM l),
d AS (SELECT DISTINCT ON (page_id, abs_url) * FROM r)
SELECT page_id, 'referenced' AS bucket, abs_url AS url, text, text AS context FROM d
WHERE starts_with(rtrim(regexp_extract(abs_url,'^https?://[^/?#]*([^?#]*)',1),'/'), regexp_replace(ppath,'/[^/]*$',''))
   OR rtrim(regexp_extract(abs_url,'^https?://[^/?#]*([^?#]*)',1),'/') = ppath""")
def q_categorize_links(spark, sf_dir):
    """C10 (same_path, default): followable links with bucket, text and context (C11)."""
    pages = scan_pages(spark, sf_dir)
    out = categorize_links(corpus_nodes(spark, sf_dir), pages, "same_path")
    return out.select("page_id", "bucket", "url", "text", "context")


_FOLLOWED = _LINK_COUNTS.rsplit("SELECT page_id, count(*)", 1)[0]


@register("categorize_follow_all", _FOLLOWED + """SELECT page_id, 'structural' AS bucket, abs_url AS url FROM q WHERE lhost = host""")
def q_categorize_follow_all(spark, sf_dir):
    """C10 with ``follow_all`` (same_domain): every followable link is structural, whatever it looks like."""
    pages = scan_pages(spark, sf_dir)
    out = categorize_links(corpus_nodes(spark, sf_dir), pages, "same_domain", follow_all=True)
    return out.select("page_id", "bucket", "url")


#: One link for each selector of the structural list (holders may stand outside the link, and a selector with an
#: ancestor needs a descendant of the link), and links that only look alike: markup around ``{a}``, inside the link, flag.
STRUCTURAL_LINKS = [
    ("{a}", "<button data-tab=1>x</button>", True), ("{a}", "<button>x</button>", False),
    ("{a}", "<a role=tab>x</a>", True), ("{a}", "<i role=tab>x</i>", False),
    ("<li role=tab>{a}</li>", "<a>x</a>", True), ("<li role=tab>{a}</li>", "x", False), ("<li role=row>{a}</li>", "<a>x</a>", False),
    ("{a}", "<i class=tab-button>x</i>", True), ("{a}", "<i class=tab-buttons>x</i>", False),
    ("<ul class=nav-tabs>{a}</ul>", "<a>x</a>", True), ("<ul class=nav-tab>{a}</ul>", "<a>x</a>", False),
    ("{a}", "<button aria-expanded=true>x</button>", True), ("{a}", "<div aria-expanded=true>x</div>", False),
    ("{a}", "<summary>x</summary>", True), ("<details><summary>{a}</summary></details>", "x", True), ("<details>{a}</details>", "x", False),
    ("{a}", "<i class=accordion-button>x</i>", True),
    ("<div class=accordion-header>{a}</div>", "<button>x</button>", True), ("{a}", "<p class=accordion-header><button>x</button></p>", True),
    ("<div class=accordion-header>{a}</div>", "<i>x</i>", False), ("<div class=accordion>{a}</div>", "<button>x</button>", False),
    ("<nav class=section-nav>{a}</nav>", "<a>x</a>", True), ("<div class=section-nav>{a}</div>", "<a>x</a>", False),
    ("<div class=section-menu>{a}</div>", "<a>x</a>", True), ("<div class=sidebar-nav><p>{a}</p></div>", "<b><a>x</a></b>", True),
    ("<div class=table-of-contents>{a}</div>", "<a>x</a>", True), ("<div class=table-of-contents></div>{a}", "<a>x</a>", False),
    ("{a}", "<i class='card clickable'>x</i>", True), ("{a}", "<i class=card>x</i>", False),
    ("{a}", "<a class=section-card>x</a>", True), ("{a}", "<i class=section-card>x</i>", False),
    ("{a}", "<a class=tile>x</a>", True), ("{a}", "<i class=tile>x</i>", False),
    ("<p class=next-section>{a}</p>", "<a>x</a>", True), ("<p class=related-section>{a}</p>", "<a>x</a>", True),
    ("<p class=sub-section>{a}</p>", "<a>x</a>", True), ("<p class=subsection>{a}</p>", "<a>x</a>", False),
]


def structural_pages(documents):
    """A page per document that holds each of ``STRUCTURAL_LINKS`` in a div of its own."""
    did = F.col("doc_id").cast("string")
    parts = []
    for k, (around, inside, _) in enumerate(STRUCTURAL_LINKS):
        before, after = around.split("{a}")
        parts += [F.lit(f'<div>{before}<a href="/p/{k}/'), did, F.lit(f'">{inside}</a>{after}</div>')]
    return documents.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://h.org/p/"), did).alias("url"), F.concat(*parts).alias("html"))


@register("structural_flag", "SELECT doc_id AS page_id, '/p/' || k || '/' || doc_id AS href, structural FROM documents, (VALUES "
          + ", ".join(f"({k}, {flag})" for k, (_, _, flag) in enumerate(STRUCTURAL_LINKS)) + ") v(k, structural)")
def q_structural_flag(spark, sf_dir):
    """C8(a): selectors with combinators, each with counter-examples, on a page per document."""
    from pagefold.operators.links import structural_flag
    from pagefold.plans.stage import derived_nodes

    nodes = derived_nodes(spark, sf_dir, "documents", structural_pages, "generic")
    anchors = link_scan(nodes)
    return structural_flag(nodes, anchors).join(anchors.select("page_id", "pre", "href"), ["page_id", "pre"]).select("page_id", "href", "structural")
