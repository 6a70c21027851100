"""Job request checks and the job status table (data part of the service)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Job limits and stage names.
MAX_DEPTH = 5
SUBMIT_MAX_PAGES = 1000
RUN_MAX_PAGES = 500
LINK_FILTERS = ["same_path", "same_domain", "all"]
STAGES = ["queued", "crawling", "enriching", "synthesizing", "completed"]
API_DEFAULTS = {"depth": 1, "max_pages": 50}
FORM_DEFAULTS = {"depth": 1, "max_pages": 10}


def job_requests_check(requests: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Apply defaults, then the first failing rule as ``reason`` (NULL = accepted).

    ``run_error`` marks requests accepted at submit (max_pages ≤ 1000) that
    the crawl config rejects when run (max_pages > 500).
    """
    d = defaults or API_DEFAULTS
    df = requests.withColumn("depth", F.coalesce(F.col("depth"), F.lit(d["depth"]))).withColumn(
        "max_pages", F.coalesce(F.col("max_pages"), F.lit(d["max_pages"]))).withColumn(
        "link_filter", F.coalesce(F.col("link_filter"), F.lit("same_path")))
    url = F.coalesce(F.col("url"), F.lit(""))
    reason = (
        F.when(~F.regexp_like(url, F.lit("^https?://[^/?#\\s]+")), "invalid_url")
        .when(F.length(F.coalesce(F.col("job_name"), F.lit(""))) < 1, "empty_name")
        .when((F.col("depth") < 0) | (F.col("depth") > MAX_DEPTH), "depth_out_of_range")
        .when((F.col("max_pages") < 1) | (F.col("max_pages") > SUBMIT_MAX_PAGES), "max_pages_out_of_range")
        .when(~F.col("link_filter").isin(*LINK_FILTERS), "bad_link_filter")
    )
    return df.withColumn("reason", reason).withColumn(
        "run_error", F.col("reason").isNull() & (F.col("max_pages") > RUN_MAX_PAGES))


def form_requests(raw: DataFrame) -> DataFrame:
    """G6, web form: text fields to numbers as the form does before it submits.

    A missing field has the form's default; text counts by its leading integer, and what has none
    (or is 0) becomes depth 0 and 1 page.
    """
    def number(c: str, otherwise: int) -> Column:
        lead = F.regexp_extract(F.col(c), r"^\s*([+-]?[0-9]{1,9})", 1)
        parsed = F.when(lead != "", lead.cast("long"))
        return F.when(F.col(c).isNull(), F.lit(FORM_DEFAULTS[c])).when(F.coalesce(parsed, F.lit(0)) == 0, F.lit(otherwise)).otherwise(parsed).cast("long")

    return raw.withColumns({"depth": number("depth", 0), "max_pages": number("max_pages", 1),
                            "link_filter": F.coalesce("link_filter", F.lit("same_path"))})


def job_events(events: DataFrame) -> DataFrame:
    """Job status events from an event table: job = user, status from the event type."""
    status = (
        F.when(F.col("event_type") == "signup", "queued")
        .when(F.col("event_type").isin("view", "click"), "running")
        .when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "error", "failed")
    )
    return events.select(F.col("user_id").alias("job_id"), "event_id", "ts", status.alias("status"), "value")


def job_latest(jobs: DataFrame) -> DataFrame:
    """The current row per job: status of the latest event (ties: highest event id), created_at = first event."""
    return jobs.groupBy("job_id").agg(
        F.max_by(F.struct("status", "value"), F.struct("ts", "event_id")).alias("_l"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    ).select("job_id", F.col("_l.status").alias("status"), F.col("_l.value").alias("duration_seconds"), "created_at", "updated_at")


def jobs_recent(latest: DataFrame, k: int | None = None) -> DataFrame:
    """All jobs, most recent created_at first (NULL last; a range-partitioned sort), or the first ``k``."""
    ordered = latest.orderBy(F.col("created_at").desc_nulls_last(), "job_id")
    return ordered if k is None else ordered.limit(k)


def job_stage(latest: DataFrame, now: Column) -> DataFrame:
    """Running jobs by elapsed seconds: < 30 crawling, < 60 enriching, else synthesizing;
    other statuses map to themselves; stage index in queued…completed, failed = -1."""
    elapsed = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1_000_000
    stage = F.when(F.col("status") == "running",
                   F.when(elapsed < 30, "crawling").when(elapsed < 60, "enriching").otherwise("synthesizing")
                   ).otherwise(F.col("status"))
    return latest.withColumn("stage", stage).withColumn(
        "stage_index", (F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage")) - 1).cast("int"))


def activity_tail(jobs: DataFrame, message: Column, keep: int = 50) -> DataFrame:
    """Per job, drop a message equal to the immediately previous one, keep the last ``keep``."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    df = jobs.withColumn("message", message).withColumn("_prev", F.lag("message").over(w))
    df = df.filter(F.col("_prev").isNull() | (F.col("_prev") != F.col("message")))
    last = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return df.withColumn("_k", F.row_number().over(last)).filter(F.col("_k") <= keep).drop("_prev", "_k")


def format_duration(seconds: Column) -> Column:
    """NULL/0 → 'N/A'; < 60 → '12.3s'; else '2m 5.0s'.

    The exact binary value is rounded once to one decimal, an exact half upwards
    (6.55 is below the half: '6.5s'; 59.996 gives '60.0s').
    """
    s = seconds.cast("double")
    mins = F.floor(s / 60).cast("long")
    return (
        F.when(s.isNull() | F.isnan(s) | (s == 0), F.lit("N/A"))
        .when(s < 60, F.concat(one_decimal(s), F.lit("s")))
        .otherwise(F.concat(mins.cast("string"), F.lit("m "), one_decimal(s % 60), F.lit("s")))
    )


def one_decimal(x: Column) -> Column:
    """``x`` (below 2 ** 20 in size) to one decimal, decided on its exact binary value.

    With n = tenths, n is right when 2n - 1 <= 20 x < 2n + 1.  20 x is formed from two parts of few
    bits each, both exact, so the sign of the difference to an integer is exact as well.
    """
    high = F.floor(x * (1 << 20)) / (1 << 20)
    low = x - high
    beyond = lambda odd: (high * 20 - odd) + low * 20
    near = F.floor(x * 10 + 0.5).cast("double")
    n = F.when(beyond(near * 2 - 1) < 0, near - 1).when(beyond(near * 2 + 1) >= 0, near + 1).otherwise(near).cast("long")
    sign = F.when(n < 0, "-").otherwise("")
    return F.concat(sign, F.floor(F.abs(n) / 10).cast("string"), F.lit("."), (F.abs(n) % 10).cast("string"))


def format_date(ts: Column) -> Column:
    """Timestamps as text, 'N/A' when missing."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("N/A"))


def job_result_summary(latest: DataFrame, pages: DataFrame, failed: DataFrame) -> DataFrame:
    """Pages scraped (0 default), duration, output path and number of failed URLs per job."""
    return (
        latest.join(pages, "job_id", "left").join(failed, "job_id", "left")
        .select("job_id", "status", F.coalesce("pages_scraped", F.lit(0)).cast("long").alias("pages_scraped"),
                format_duration(F.col("duration_seconds")).alias("duration"),
                F.concat(F.lit("data/job_"), F.col("job_id").cast("string")).alias("output_path"),
                F.coalesce("n_failed", F.lit(0)).cast("long").alias("n_failed"))
    )
