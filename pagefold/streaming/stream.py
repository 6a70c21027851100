"""H1–H3: incremental runs with Structured Streaming.

The reference resumes a batch loop from a saved completed-URL file; here a
file-source stream plus its checkpoint plays that role: files already
processed are never read again after a restart, and every micro-batch writes
its output under a folder named by the batch id, so a replayed batch
overwrites its own output instead of duplicating it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefold.sources import changelog


def _source(spark: SparkSession, path: str, schema: T.StructType, glob: str | None, max_files: int | None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def stream_pages(
    spark: SparkSession,
    source: str,
    out_path: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame],
    schema: T.StructType,
    glob: str | None = None,
    max_files: int | None = None,
) -> None:
    """H1: parse new page files once, surviving restarts.

    ``transform`` maps a batch of pages to result rows (e.g. the page summary
    or the generic page record); it runs per micro-batch in ``foreachBatch``
    with ordinary batch operators.  Output: ``{out_path}/batch={id}``.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    q = (
        _source(spark, source, schema, glob, max_files)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


#: Keeps streaming state on disk, so that it may outgrow an executor's memory.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_dedupe_url(
    spark: SparkSession, source: str, out_path: str, checkpoint: str, schema: T.StructType,
    key: str = "url", glob: str | None = None, watermark: tuple[str, str] | None = None, max_files: int | None = None,
) -> list[int]:
    """H2: each URL is processed once across all micro-batches and restarts.

    Without ``watermark`` the seen-set is unbounded state, as in the reference; with
    ``(event_time_col, delay)`` a key is remembered until the watermark passes its event time plus
    ``delay`` and rows behind the watermark are dropped, so the state is bounded by the delay.  Returns the number of
    state rows after each micro-batch.
    """
    src = _source(spark, source, schema, glob, max_files)
    if watermark:
        time, delay = watermark
        timed = src.withColumn(time, F.col(time).cast("timestamp"))  # a watermark takes no timestamp without zone
        deduped = timed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    else:
        deduped = src.dropDuplicates([key])
    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)  # read when the query starts; a restart keeps its checkpoint's own
    try:
        q = (
            deduped.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(STATE_STORE[0], before) if before else spark.conf.unset(STATE_STORE[0])
    q.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def stream_job_latest(
    spark: SparkSession, source: str, out_path: str, checkpoint: str, schema: T.StructType,
    to_jobs: Callable[[DataFrame], DataFrame], glob: str | None = None, max_files: int | None = None,
) -> DataFrame | None:
    """H3: the live current-status table per job.

    A streaming aggregation (state per job) in update mode; each micro-batch appends its changed
    jobs to a keyed changelog (``sources.changelog``): a batch costs its changes, not the table.
    Runs are named by batch, so a restart goes on from the last one and a replayed batch
    overwrites its own.  Returns the current table (None when no batch ever ran).
    """
    jobs = to_jobs(_source(spark, source, schema, glob, max_files))
    agg = jobs.groupBy("job_id").agg(
        F.max_by(F.struct("status", "value"), F.struct("ts", "event_id")).alias("_l"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    ).select("job_id", F.col("_l.status").alias("status"), F.col("_l.value").alias("duration_seconds"),
             "created_at", "updated_at")
    q = (
        agg.writeStream.foreachBatch(lambda batch, number: changelog.append(batch, out_path, number, "job_id"))
        .outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return changelog.read(spark, out_path, "job_id")
