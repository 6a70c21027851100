"""Registered enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.operators import enrich as EN
from pagefold.operators import generic as G
from pagefold.operators.graph import crawl_metadata
from pagefold.operators.nodes import html_nodes
from pagefold.operators.sections import sections
from pagefold.plans import synth
from pagefold.plans.detail_queries import _LINES
from pagefold.plans.graph_queries import _BFS_SQL, crawl
from pagefold.plans.registry import register
from pagefold.plans.stage import corpus_lines, corpus_nodes, derived_lines, derived_nodes
from pagefold.session import materialize
from pagefold.sources.tables import scan_pages, table

_TYPES_SQL = "[" + ", ".join(f"'{t}'" for t in EN.SECTION_TYPES) + "]"
_KW_SQL = "[" + ", ".join(f"{{'k': '{k}', 't': '{t}'}}" for k, t in EN._KEYWORDS) + "]"


def _synth_sections(spark, sf_dir):
    nodes = derived_nodes(spark, sf_dir, "documents", synth.section_pages_primary, "detail", junk="detail")
    return materialize(sections(nodes), "sections", sort=["page_id", "ord"])


@register("classify_requests", "WITH " + _LINES + """
SELECT doc_id AS page_id, 'S' || i AS title, substr(content, 1, 300) AS preview FROM cl WHERE content <> ''""")
def q_classify_requests(spark, sf_dir):
    """one classification request per section, 300-character preview."""
    return EN.classify_requests(_synth_sections(spark, sf_dir)).select("page_id", "title", "preview")


@register("section_type", f"""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN ' ' || upper(event_type) || ' '
  WHEN 2 THEN ' Fees' ELSE NULL END AS response FROM events)
SELECT event_id, response, CASE WHEN list_contains({_TYPES_SQL}, lower(trim(response))) THEN lower(trim(response)) ELSE 'other' END
  AS section_type FROM r""")
def q_section_type(spark, sf_dir):
    """response → canonical section type ('other' for anything else, NULL included)."""
    ev = table(spark, sf_dir, "events")
    r = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).when(
        F.col("event_id") % 4 == 1, F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "))).when(
        F.col("event_id") % 4 == 2, F.lit(" Fees"))
    return ev.select("event_id", r.alias("response")).select("event_id", "response", EN.section_type(F.col("response")).alias("section_type"))


@register("section_type_counts", "WITH " + _LINES + f""",
s AS (SELECT doc_id, lower(substr(content, 1, 300)) AS pv FROM cl WHERE content <> ''),
l AS (SELECT doc_id, coalesce(list_filter({_KW_SQL}, lambda x: contains(pv, x.k))[1].t, 'other') AS section_type FROM s)
SELECT doc_id AS page_id, section_type, count(*) AS n FROM l GROUP BY ALL""")
def q_section_type_counts(spark, sf_dir):
    """F1 → scorer (F8) → F2/F3 → F4: section types per page with the keyword scorer."""
    secs = _synth_sections(spark, sf_dir)
    resp = EN.score(EN.classify_requests(secs))
    return EN.section_type_counts(EN.enrich_sections(secs, resp))


def _responses(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.col("event_type").alias("content_type"), F.col("props").alias("summary"),
                              F.struct(F.col("value").alias("k"), F.col("user_id").alias("u")).alias("structured_data")))
    case = F.col("event_id") % 8
    # half of two cases in JSON that only a lenient reader takes: repeated keys (the last one counts) and NaN
    odd = F.col("event_id") % 16 < 8
    twice = F.concat(F.lit('{"content_type": 7, "summary": "old", '), F.substring(body, 2, 1 << 30))
    nan = F.regexp_replace(body, '"k":[^,}]*', '"k": NaN')
    resp = (
        F.when(case == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(case == 1, F.concat(F.lit("```\n"), F.when(odd, nan).otherwise(body), F.lit("\n```")))
        .when(case == 2, F.when(odd, twice).otherwise(body))
        .when(case == 3, F.concat(F.lit("```json\n"), body, F.lit(" .")))
        .when(case == 4, F.concat(F.lit("{not json "), F.col("event_type")))
        .when(case == 5, F.lit("[1, 2, 3]"))
        .when(case == 6, F.to_json(F.struct(F.col("event_type").alias("content_type"), F.lit(None).cast("string").alias("structured_data")),
                                   {"ignoreNullFields": "false"}))
        .otherwise(F.concat(F.lit('{"content_type": "x", "structured_data": [1, 2]}')))
    )
    return ev.select("event_id", resp.alias("response"))


@register("extract_fields", """SELECT event_id,
  CASE WHEN event_id % 8 IN (0,1,2,3) THEN event_type WHEN event_id % 8 = 4 THEN NULL ELSE 'unknown' END AS content_type,
  CASE WHEN event_id % 8 IN (0,1,2,3) THEN props WHEN event_id % 8 = 4 THEN NULL ELSE '' END AS summary,
  CASE WHEN event_id % 8 IN (0,1,2,3) THEN 2 ELSE 0 END AS n_keys
FROM events WHERE event_id % 8 <> 7""")
def q_extract_fields(spark, sf_dir):
    """F6 + F7: fenced / bare / unclosed / bad / non-object responses; list structured_data is dropped."""
    f = EN.extract_fields(_responses(spark, sf_dir)).filter(~F.col("_drop"))
    return f.select("event_id", "content_type", "summary",
                    F.size(F.json_object_keys(F.to_json("structured_data"))).alias("n_keys"))


_RAW = r"""trim(regexp_replace(array_to_string(list_filter(list_transform(
  regexp_split_to_array(regexp_extract(html,'(?s)<article>(.*)</article>',1),'<[^>]*>'),
  lambda x: regexp_replace(replace(replace(x,'&quot;','"'),'&amp;','&'),'^\s+|\s+$','','g')),
  lambda x: length(x)>1),' '),'\s+',' ','g'))"""
_CONTENT = f"CASE WHEN length({_RAW}) > 8000 THEN substr({_RAW}, 1, 8000) || chr(10) || '...(content truncated)...' ELSE {_RAW} END"


@register("extract_requests", f"SELECT page_id, {_CONTENT} AS content FROM pages")
def q_extract_requests(spark, sf_dir):
    """extraction content per page (raw text, cut at 8000 characters with a marker)."""
    gp = G.generic_page(corpus_nodes(spark, sf_dir, "generic"), scan_pages(spark, sf_dir),
                        kept=corpus_nodes(spark, sf_dir, "generic", junk="generic"), lines=corpus_lines(spark, sf_dir))
    return EN.extract_requests(gp).select("page_id", "content")


@register("enrich_pages", f"""WITH c AS (SELECT page_id, string_split_regex(trim({_CONTENT} || chr(10) || chr(10) || 'JSON Output:'), '\\s+') AS w FROM pages)
SELECT page_id, 'general_information' AS content_type, array_to_string(w[1:12], ' ') AS summary, len(w) AS n_words FROM c""")
def q_enrich_pages(spark, sf_dir):
    """F5 → F8 (keyword scorer, Arrow batches) → F6/F7 for every page of the corpus."""
    gp = G.generic_page(corpus_nodes(spark, sf_dir, "generic"), scan_pages(spark, sf_dir),
                        kept=corpus_nodes(spark, sf_dir, "generic", junk="generic"), lines=corpus_lines(spark, sf_dir))
    e = EN.enrich_pages(gp)
    return e.select("page_id", "content_type", "summary",
                    F.try_variant_get("structured_data", "$.n_words", "int").alias("n_words"))


_NL = "chr(10)"
_COMBINE_SQL = r"""WITH cv AS (SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t,
   regexp_replace(role, '^\s+|\s+$', '', 'g') AS r FROM conversations),
b AS (SELECT *, CASE WHEN t = '' THEN [] ELSE [chr(10) || t || chr(10), t] END AS pl,
   regexp_replace(CASE WHEN t = '' THEN '' ELSE chr(10) || t || chr(10) || chr(10) || t END, '\n{3,}', chr(10) || chr(10), 'g') AS c0,
   (turn % 5 = 4 OR turn % 3 <> 2) AS has_acc FROM cv),
c AS (SELECT *, regexp_replace(c0, '^\s+|\s+$', '', 'g') AS content,
   regexp_replace(regexp_replace(array_to_string(list_concat(['Q' || turn], CASE WHEN has_acc THEN pl ELSE [] END, pl,
     ['Tab ' || turn], pl), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS main FROM b)
SELECT conv_id * 1000000 + turn AS page_id, array_to_string(list_concat(
   CASE WHEN main <> '' THEN ['=== Main Content ===', main] ELSE [] END,
   [chr(10) || '=== Interactive Sections ==='],
   CASE WHEN has_acc THEN [chr(10) || '[ACCORDION] Q' || turn, content] ELSE [] END,
   [chr(10) || '[DETAILS] ' || r, content, chr(10) || '[TAB] Tab ' || turn, content]), chr(10)) AS combined FROM c"""


@register("combine_content", _COMBINE_SQL)
def q_combine_content(spark, sf_dir):
    """main content + interactive sections + first 10 referenced links, on conversation pages."""
    nodes = derived_nodes(spark, sf_dir, "conversations", synth.conversation_pages, "generic")
    pages = synth.conversation_pages(table(spark, sf_dir, "conversations")).select("page_id", "url")
    gp = G.generic_page(nodes, pages, kept=derived_nodes(spark, sf_dir, "conversations", synth.conversation_pages, "generic", junk="generic"),
                        lines=derived_lines(spark, sf_dir, "conversations", synth.conversation_pages))
    return gp.select("page_id", EN.combine_content(gp).alias("combined"))


def _crawl_job(spark, sf_dir):
    c = crawl(spark, sf_dir).filter(F.col("status") == "ok")
    pages = scan_pages(spark, sf_dir).join(c.select("page_id", "seq", "depth", "parent_url"), "page_id")
    # only the crawled pages (max_pages at most) are parsed
    nodes = materialize(html_nodes(pages.select("page_id", "html"), "generic"), "crawl-nodes", sort=["page_id", "pre"])
    gp = G.generic_page(nodes, pages.select("page_id", "url"))
    gp = gp.drop("depth", "parent_url").join(pages.select("page_id", "seq", "depth", "parent_url"), "page_id")
    enriched = materialize(EN.enrich_pages(gp).withColumn("job", F.lit(1)), "enriched")
    start = c.filter(F.col("depth") == 0).select("url").first()["url"]
    jobs = spark.createDataFrame([(1, "crawl", start, True)], "job int, job_name string, start_url string, final_synthesis boolean")
    return c, enriched, jobs


@register("synthesis_request", "WITH c AS (" + _BFS_SQL + """) SELECT 1 AS job, CAST(count(*) AS BIGINT) AS n_pages FROM c HAVING count(*) > 1""")
def q_synthesis_request(spark, sf_dir):
    """the per-job synthesis request, gated on final_synthesis and more than one enriched page."""
    _, enriched, jobs = _crawl_job(spark, sf_dir)
    return EN.synthesis_request(enriched, jobs).select("job", "n_pages")


@register("crawl_result", "WITH c AS (" + _BFS_SQL + """)
SELECT 1 AS job, CAST(count(*) AS BIGINT) AS total_pages, CAST(count(*) AS BIGINT) AS successful_enrichments,
  max(url) FILTER (depth = 0) AS main_url, CAST(count(*) FILTER (depth > 0) AS INTEGER) AS n_children,
  'general_information' AS synthesized_type FROM c""")
def q_crawl_result(spark, sf_dir):
    """F10 + F12 (+ D5): one nested result per job; flat fields of it."""
    c, enriched, jobs = _crawl_job(spark, sf_dir)
    meta = crawl_metadata(c, enriched).withColumn("job", F.lit(1))
    syn = EN.score(EN.synthesis_request(enriched, jobs)).join(
        EN.synthesis_request(enriched, jobs).select("request_id", "job"), "request_id")
    res = EN.crawl_result(jobs, enriched, meta, syn)
    return res.select("job", "total_pages", "successful_enrichments", F.col("main_page.url").alias("main_url"),
                      F.size("child_pages").alias("n_children"),
                      F.get_json_object("structured_data", "$.content_type").alias("synthesized_type"))
