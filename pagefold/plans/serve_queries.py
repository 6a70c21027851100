"""Registered record-stage, validation and job-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagefold.functions.urls import url_slug
from pagefold.operators import jobs as J
from pagefold.operators import validate as V
from pagefold.operators.sections import detail_page
from pagefold.plans import synth
from pagefold.plans.detail_queries import _COMPLETED_SQL, _SUMMARY_SQL, _completed
from pagefold.plans.graph_queries import _BFS_SQL, crawl
from pagefold.plans.registry import register
from pagefold.plans.stage import derived_nodes
from pagefold.session import bucket_count, materialize, scratch_path
from pagefold.sources import records as R
from pagefold.sources.tables import scan_pages, table


def _records(spark, sf_dir):
    """Parsed stage: detail records of the section pages built from documents, keyed by slug."""
    docs = table(spark, sf_dir, "documents")
    pages = synth.section_pages(docs, "primary").select("page_id", "url")
    nodes = derived_nodes(spark, sf_dir, "documents", synth.section_pages_primary, "detail", junk="detail")
    recs = detail_page(nodes, pages, stripped=True).withColumn("slug", url_slug("source_url"))
    return materialize(recs, "records")


_REC_SQL = "WITH d AS (" + _SUMMARY_SQL + ")"


@register("validate_records", _REC_SQL + """
SELECT page_id, total_text_length, CASE WHEN n_sections = 0 THEN 'no_sections_extracted'
  WHEN total_text_length < 100 THEN 'text_too_short' END AS reason,
  n_sections > 0 AND total_text_length >= 100 AS valid FROM d""")
def q_validate_records(spark, sf_dir):
    """G1: first failing rule per parsed record."""
    return V.validate_records(_records(spark, sf_dir)).select("page_id", "total_text_length", "reason", "valid")


@register("validation_summary", _REC_SQL + """
SELECT count(*) AS total, count(*) FILTER (n_sections > 0 AND total_text_length >= 100) AS valid,
  count(*) FILTER (NOT (n_sections > 0 AND total_text_length >= 100)) AS invalid FROM d""")
def q_validation_summary(spark, sf_dir):
    """Totals over the parsed stage."""
    v = V.validate_records(_records(spark, sf_dir))
    return V.validation_summary(v)


@register("validation_reasons", _REC_SQL + """
SELECT CASE WHEN n_sections = 0 THEN 'no_sections_extracted' ELSE 'text_too_short' END AS reason, count(*) AS n
FROM d WHERE NOT (n_sections > 0 AND total_text_length >= 100) GROUP BY 1""")
def q_validation_reasons(spark, sf_dir):
    """G2 breakdown by reason."""
    return V.reasons(V.validate_records(_records(spark, sf_dir)))


@register("stage_counts", """SELECT 'raw' AS stage, count(*) AS n FROM pages UNION ALL SELECT 'parsed', count(*) FROM documents
UNION ALL SELECT 'enriched', count(*) FROM labels""")
def q_stage_counts(spark, sf_dir):
    """Records per stage (raw pages, parsed records, enriched records)."""
    recs = _records(spark, sf_dir)
    enriched = recs.join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "page_id"), "page_id")
    return V.stage_counts(scan_pages(spark, sf_dir), recs, enriched)


def _stages(spark, sf_dir, recs=None):
    recs = _records(spark, sf_dir) if recs is None else recs
    parsed = recs.select("slug", F.struct("title", F.lit(None).cast("int").alias("quality")).alias("record"))
    lab = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "page_id")
    enriched = recs.join(lab, "page_id").select("slug", F.struct("title", F.col("quality")).alias("record"))
    return parsed, enriched


_G4_SQL = _REC_SQL + """
SELECT 'primary_' || d.page_id AS slug, CASE WHEN l.doc_id IS NULL THEN 'parsed' ELSE 'enriched' END AS source,
  d.title, l.quality FROM d LEFT JOIN labels l ON l.doc_id = d.page_id"""


@register("prefer_enriched", _G4_SQL)
def q_prefer_enriched(spark, sf_dir):
    """Every parsed slug once, the enriched record when there is one."""
    parsed, enriched = _stages(spark, sf_dir)
    return V.prefer_enriched(parsed, enriched).select("slug", "source", "record.title", "record.quality")


@register("lookup_slug", _G4_SQL)
def q_lookup_slug(spark, sf_dir):
    """Merged lookup over both stages (full outer join; enriched-only slugs would appear too)."""
    parsed, enriched = _stages(spark, sf_dir)
    return V.lookup_slug(parsed, enriched).select("slug", "source", "record.title", "record.quality")


@register("lookup_either_stage", "WITH p AS (SELECT doc_id FROM documents WHERE lang = 'en' OR doc_id NOT IN (SELECT doc_id FROM labels)) "
          "SELECT 'primary_' || d.doc_id AS slug, CASE WHEN l.doc_id IS NULL THEN 'parsed' ELSE 'enriched' END AS source, "
          "p.doc_id IS NULL AS enriched_only, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN p USING (doc_id) "
          "WHERE p.doc_id IS NOT NULL OR l.doc_id IS NOT NULL")
def q_lookup_either_stage(spark, sf_dir):
    """G5 where a stage lacks records of the other: labelled documents of other languages are enriched only."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    slug = F.concat(F.lit("primary_"), "doc_id").alias("slug")
    both = docs.select("doc_id", "lang").join(labels, "doc_id", "left")
    parsed = both.filter((F.col("lang") == "en") | F.col("quality").isNull()).select(slug, F.struct(F.lit(None).cast("int").alias("quality")).alias("record"))
    enriched = labels.select(slug, F.struct(F.col("quality").cast("int").alias("quality")).alias("record"))
    found = V.lookup_slug(parsed, enriched)
    stage = parsed.select("slug", F.lit(True).alias("_p"))
    return found.join(stage, "slug", "left").select("slug", "source", F.col("_p").isNull().alias("enriched_only"), "record.quality")


@register("sink_by_slug", r"""SELECT trim(lower(regexp_replace(regexp_replace(trim(regexp_extract(url,'^https?://[^/?#]*([^?#]*)',1),'/'),
  '[^\p{L}\p{N}_\-]','_','g'),'_+','_','g')),'_') AS slug, max(page_id) AS page_id FROM pages GROUP BY 1""")
def q_sink_by_slug(spark, sf_dir):
    """A3: one record per slug, the later write (higher page_id) replacing the earlier one; written as parquet."""
    pages = scan_pages(spark, sf_dir).select("page_id", F.col("url").alias("source_url"), F.col("page_id").alias("seq"))
    path = scratch_path(spark, "by-slug")
    R.sink_by_slug(pages, path)
    return spark.read.parquet(path).select("slug", "page_id")


@register("exists_by_slug", _REC_SQL + """
SELECT page_id, n_sections > 0 AS in_parsed, page_id IN (SELECT doc_id FROM labels) AS in_enriched FROM d""")
def q_exists_by_slug(spark, sf_dir):
    """Per record URL, whether its slug exists in the parsed (with sections) and enriched stages."""
    recs = _records(spark, sf_dir)
    parsed_stage = recs.filter(F.size("sections") > 0).select("slug")
    _, enriched = _stages(spark, sf_dir, recs)  # of the same records, not parsed into sections anew
    out = R.exists_by_slug(recs.select("page_id", F.col("source_url").alias("url")), parsed_stage, "in_parsed")
    out = R.exists_by_slug(out.drop("slug"), enriched.select("slug"), "in_enriched")
    return out.select("page_id", "in_parsed", "in_enriched")


@register("scan_records", "SELECT CAST(count(*) AS BIGINT) AS n_good, CAST(1 AS BIGINT) AS n_bad, CAST(count(*) AS BIGINT) AS n_urls FROM documents")
def q_scan_records(spark, sf_dir):
    """A2: records written as JSON, plus one corrupt file, read back in the fixed schema."""
    recs = _records(spark, sf_dir).select("title", "category", "summary", "sections", "source_url",
                                           F.lit(None).cast("string").alias("scraped_at"))
    path = scratch_path(spark, "records-json")
    recs.write.mode("overwrite").json(path + "/part-a", compression="gzip")  # as many files as staged buckets
    spark.createDataFrame([("{ this is not json",)], "value string").coalesce(1).write.mode("overwrite").text(path + "/part-b")
    # one aggregate gives both counts; it reads a data field too, as the corrupt-record column alone can't be read
    got = R.scan_records(spark, path, multi_line=False, glob=None)
    return got.agg(F.count_if(F.col("_bad").isNull()).alias("n_good"), F.count_if(F.col("_bad").isNotNull()).alias("n_bad"),
                   F.count("source_url").alias("n_urls"))


@register("scan_record_files", """SELECT 'conv ' || conv_id AS title, CAST(count(*) AS INTEGER) AS n_sections,
  string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS content, NULL AS problem FROM conversations GROUP BY conv_id
UNION ALL SELECT NULL, NULL, NULL, unnest(['empty', 'malformed'])""")
def q_scan_record_files(spark, sf_dir):
    """A2, one document per file: a record per conversation written to a file of its own, then one cut off in the middle
    and one empty file; fields of the good ones and the list of the bad."""
    path = scratch_path(spark, "record-files")
    section = F.struct("turn", F.struct(F.col("role").alias("title"), F.col("text").alias("content")).alias("s"))
    # files cost far more than their bytes: the writing tasks follow the cores, not the few MB adaptive execution would pack together
    turns = table(spark, sf_dir, "conversations").repartition(max(bucket_count(spark), 2 * spark.sparkContext.defaultParallelism), "conv_id")
    recs = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(section)), lambda x: x["s"]).alias("sections"))
    recs = recs.select(F.to_json(F.struct(F.concat(F.lit("conv "), "conv_id").alias("title"), "sections"), {"pretty": "true"}).alias("value"))
    R.write_record_files(recs, path + "/good")
    R.write_record_files(recs.limit(1).select(F.explode(F.array(F.substring("value", 1, 20), F.lit(""))).alias("value")), path + "/bad")
    got = materialize(R.scan_records(spark, path, glob="*.txt"), "records-read", "file")  # the files are opened once for both branches
    line = F.transform("sections", lambda s: F.concat(s["title"], F.lit(": "), s["content"]))
    good = got.filter("_bad is null").select("title", F.size("sections").alias("n_sections"), F.array_join(line, "\n").alias("content"), F.lit(None).cast("string").alias("problem"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("title", "string"), ("n_sections", "int"), ("content", "string"))]
    return good.unionByName(R.bad_files(got).select(*none, "problem"))


@register("completed_source", _COMPLETED_SQL + """
SELECT 'missing' AS state, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'written', count(DISTINCT url) FROM done""")
def q_completed_source(spark, sf_dir):
    """A7 + E3: a missing state reads as empty; a written state version reads back whole."""
    missing = R.completed_source(spark, scratch_path(spark, "no-state"))
    path = scratch_path(spark, "completed")
    _completed(spark, sf_dir).write.mode("overwrite").parquet(path)
    written = R.completed_source(spark, path)
    return missing.agg(F.count("*").alias("n")).select(F.lit("missing").alias("state"), "n").unionByName(
        written.agg(F.count("*").alias("n")).select(F.lit("written").alias("state"), "n"))


@register("sink_result", "WITH c AS (" + _BFS_SQL + """) SELECT CAST(count(*) AS BIGINT) AS total_pages, 'crawl' AS job_name FROM c""")
def q_sink_result(spark, sf_dir):
    """A5: the one-row crawl result written as JSON and read back."""
    c = crawl(spark, sf_dir)
    res = c.agg(F.count_if(F.col("status") == "ok").alias("total_pages"),
                F.transform(F.array_sort(F.collect_list(F.struct("seq", "url"))), lambda x: x["url"]).alias("visited_urls")
                ).withColumn("job_name", F.lit("crawl"))
    path = scratch_path(spark, "result")
    R.sink_result(res, path)
    return spark.read.json(path).select(F.col("total_pages").cast("long"), "job_name")


# ------------------------------------------------------------------ jobs
def _jobs(spark, sf_dir):
    return J.job_events(table(spark, sf_dir, "events"))


_JOBS_SQL = """WITH je AS (SELECT user_id AS job_id, event_id, ts, value, event_type,
  CASE WHEN event_type = 'signup' THEN 'queued' WHEN event_type IN ('view','click') THEN 'running'
       WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'failed' END AS status FROM events),
lt AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) AS duration_seconds,
  min(ts) AS created_at, max(ts) AS updated_at FROM je GROUP BY job_id)"""


@register("job_requests_check", """WITH r AS (SELECT event_id,
  CASE WHEN event_id % 10 = 0 THEN 'ftp://files.example.com/x' ELSE 'https://u' || user_id || '.example.com/start' END AS url,
  CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS job_name,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) % 8 - 1 END AS depth,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value * 3) AS BIGINT) END AS max_pages,
  CASE event_id % 4 WHEN 0 THEN 'same_path' WHEN 1 THEN 'same_domain' WHEN 2 THEN 'all' ELSE 'bogus' END AS link_filter FROM events),
d AS (SELECT event_id, url, job_name, coalesce(depth, 1) AS depth, coalesce(max_pages, 50) AS max_pages, link_filter FROM r)
SELECT event_id, depth, max_pages, link_filter,
  CASE WHEN NOT regexp_matches(url, '^https?://[^/?#\\s]+') THEN 'invalid_url' WHEN length(job_name) < 1 THEN 'empty_name'
       WHEN depth < 0 OR depth > 5 THEN 'depth_out_of_range' WHEN max_pages < 1 OR max_pages > 1000 THEN 'max_pages_out_of_range'
       WHEN link_filter NOT IN ('same_path','same_domain','all') THEN 'bad_link_filter' END AS reason,
  (url LIKE 'http%' AND NOT (NOT regexp_matches(url, '^https?://[^/?#\\s]+') OR length(job_name) < 1 OR depth < 0 OR depth > 5
     OR max_pages < 1 OR max_pages > 1000 OR link_filter NOT IN ('same_path','same_domain','all')) AND max_pages > 500) AS run_error
FROM d""")
def q_job_requests_check(spark, sf_dir):
    """Job requests derived from events, defaults applied, first failing rule."""
    ev = table(spark, sf_dir, "events")
    req = ev.select(
        "event_id",
        F.when(F.col("event_id") % 10 == 0, F.lit("ftp://files.example.com/x")).otherwise(
            F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.com/start"))).alias("url"),
        F.when(F.col("event_id") % 9 == 0, F.lit("")).otherwise(F.col("event_type")).alias("job_name"),
        F.when(F.col("event_id") % 6 == 0, F.lit(None)).otherwise(F.floor("value").cast("long") % 8 - 1).alias("depth"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.floor(F.col("value") * 3).cast("long")).alias("max_pages"),
        F.element_at(F.array(F.lit("same_path"), F.lit("same_domain"), F.lit("all"), F.lit("bogus")),
                     (F.col("event_id") % 4 + 1).cast("int")).alias("link_filter"),
    )
    return J.job_requests_check(req).select("event_id", "depth", "max_pages", "link_filter", "reason", "run_error")


@register("form_requests", r"""WITH r AS (SELECT event_id,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN event_type WHEN 2 THEN ' ' || event_id % 7 || 'x' ELSE CAST(event_id % 9 - 2 AS VARCHAR) END AS depth,
  CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(floor(value) AS BIGINT) || '.5' END AS max_pages FROM events),
p AS (SELECT event_id, depth, max_pages, TRY_CAST(regexp_extract(depth, '^\s*([+-]?[0-9]+)', 1) AS BIGINT) AS d,
  TRY_CAST(regexp_extract(max_pages, '^\s*([+-]?[0-9]+)', 1) AS BIGINT) AS m FROM r)
SELECT event_id, CASE WHEN depth IS NULL THEN 1 ELSE coalesce(d, 0) END AS depth,
  CASE WHEN max_pages IS NULL THEN 10 WHEN coalesce(m, 0) = 0 THEN 1 ELSE m END AS max_pages FROM p""")
def q_form_requests(spark, sf_dir):
    """The web form's defaults and number coercions."""
    ev = table(spark, sf_dir, "events")
    e = F.col("event_id")
    raw = ev.select(
        "event_id", F.lit(None).cast("string").alias("link_filter"),
        F.when(e % 5 == 0, F.lit(None)).when(e % 5 == 1, F.col("event_type")).when(e % 5 == 2, F.concat(F.lit(" "), (e % 7).cast("string"), F.lit("x")))
        .otherwise((e % 9 - 2).cast("string")).alias("depth"),
        F.when(e % 6 == 0, F.lit(None)).when(e % 6 == 1, F.lit("")).otherwise(F.concat(F.floor("value").cast("string"), F.lit(".5"))).alias("max_pages"))
    return J.form_requests(raw).select("event_id", "depth", "max_pages")


@register("job_latest", _JOBS_SQL + """
SELECT job_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM lt""")
def q_job_latest(spark, sf_dir):
    """G7 (+ G11 dates): the current status row per job."""
    lt = J.job_latest(_jobs(spark, sf_dir))
    return lt.select("job_id", "status", J.format_date(F.col("created_at")).alias("created_at"),
                     J.format_date(F.col("updated_at")).alias("updated_at"))


@register("jobs_recent", _JOBS_SQL + """
SELECT job_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM lt ORDER BY lt.created_at DESC NULLS LAST, job_id""")
def q_jobs_recent(spark, sf_dir):
    """All jobs, the most recently created first."""
    lt = J.jobs_recent(J.job_latest(_jobs(spark, sf_dir)))
    return lt.select("job_id", J.format_date(F.col("created_at")).alias("created_at"))


@register("job_stage", _JOBS_SQL + """,
nw AS (SELECT max(ts) AS now FROM events),
st AS (SELECT job_id, status, CASE WHEN status = 'running' THEN CASE
   WHEN (epoch_us(now) - epoch_us(created_at)) / 1000000.0 < 30 THEN 'crawling'
   WHEN (epoch_us(now) - epoch_us(created_at)) / 1000000.0 < 60 THEN 'enriching' ELSE 'synthesizing' END ELSE status END AS stage
   FROM lt, nw)
SELECT job_id, stage, CAST(coalesce(list_position(['queued','crawling','enriching','synthesizing','completed'], stage), 0) - 1 AS INTEGER)
  AS stage_index FROM st""")
def q_job_stage(spark, sf_dir):
    """Display stage and stage index; 'now' is the latest event time in the table."""
    jobs = _jobs(spark, sf_dir)
    lt = J.job_latest(jobs)
    now = jobs.agg(F.max("ts")).first()[0]  # one scalar: the latest event time
    st = J.job_stage(lt, F.lit(now).cast("timestamp"))
    return st.select("job_id", "stage", F.coalesce("stage_index", F.lit(-1)).cast("int").alias("stage_index"))


@register("activity_tail", _JOBS_SQL + """,
m AS (SELECT job_id, event_id, ts, event_type AS message,
   lag(event_type) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS prev FROM je),
k AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rk FROM m WHERE prev IS NULL OR prev <> message)
SELECT job_id, event_id, message FROM k WHERE rk <= 50""")
def q_activity_tail(spark, sf_dir):
    """Per job, repeated consecutive messages dropped, the last 50 kept."""
    return J.activity_tail(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", "event_type"),
                           F.col("event_type")).select("job_id", "event_id", "message")


# printf rounds the exact binary value (an exact half to even, so halves are taken upwards before)
_TENTH = "CASE WHEN {v} * 4 = floor({v} * 4) AND floor({v} * 4) % 2 = 1 THEN printf('%.1f', floor({v} * 10 + 0.5) / 10) ELSE printf('%.1f', {v}) END"
_DUR = ("CASE WHEN {v} IS NULL OR {v} = 0 THEN 'N/A' WHEN {v} < 60 THEN (" + _TENTH + ") || 's' "
        "ELSE CAST(CAST(floor(({v}) / 60) AS BIGINT) AS VARCHAR) || 'm ' || (" + _TENTH.replace("{v}", "fmod({v}, 60)") + ") || 's' END")


@register("format_duration", "SELECT event_id, " + _DUR.format(v="value") + " AS short, " + _DUR.format(v="(value * 3)") + " AS long FROM events")
def q_format_duration(spark, sf_dir):
    """Durations as '12.3s' / '2m 5.0s' / 'N/A'."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", J.format_duration(F.col("value")).alias("short"), J.format_duration(F.col("value") * 3).alias("long"))


@register("job_result_summary", _JOBS_SQL + """,
pg AS (SELECT job_id, count(*) FILTER (event_type = 'view') AS pages_scraped, count(*) FILTER (event_type = 'error') AS n_failed FROM je GROUP BY job_id)
SELECT lt.job_id, lt.status, CAST(coalesce(pg.pages_scraped, 0) AS BIGINT) AS pages_scraped, """ + _DUR.format(v="lt.duration_seconds") + """ AS duration,
  'data/job_' || lt.job_id AS output_path, CAST(coalesce(pg.n_failed, 0) AS BIGINT) AS n_failed FROM lt LEFT JOIN pg USING (job_id)""")
def q_job_result_summary(spark, sf_dir):
    """Result card per job."""
    jobs = _jobs(spark, sf_dir)
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_type")
    pages = ev.groupBy("job_id").agg(F.count_if(F.col("event_type") == "view").alias("pages_scraped"))
    failed = ev.groupBy("job_id").agg(F.count_if(F.col("event_type") == "error").alias("n_failed"))
    return J.job_result_summary(J.job_latest(jobs), pages, failed)
