"""Session helpers: one place for the configuration the jobs rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# staged rows repeat tags, ids and wrappers: half the bytes of the default codec
STAGED_CODEC = "zstd"


def build_session(master: str | None = None, app: str = "pagefold", shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session. On a cluster the submitter's session is used as is."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # every table here is bucketed by page_id: let joins and aggregates keyed by
        # (page_id, …) reuse that partitioning instead of re-shuffling
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # pages are large rows: keep Arrow batches into the tokenizer small
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        .config("spark.driver.memory", os.environ.get("PAGEFOLD_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; only when it is unset
    (local mode, as in tests) do we pick a scratch folder of our own; a cluster
    without the setting is an error, since its machines share no local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="pagefold-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/pagefold-{name}-{uuid.uuid4().hex[:12]}"


def measured_broadcasts(spark: SparkSession) -> None:
    """Broadcast what was measured to be small, not what file sizes let seem small.

    Before a job Spark takes a table's size from its files.  Staged rows of a few keys compress so well that files
    of a few MB are hundreds of MB as a broadcast, which the driver has to hold.  So for the session no join is
    planned as a broadcast from file sizes; adaptive execution still turns one into a broadcast when a
    shuffle's measured size is within the session's threshold (``F.broadcast`` counts as before).
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(adaptive, None) is None:
        spark.conf.set(adaptive, spark.conf.get(static))
    spark.conf.set(static, "-1")


def staged_reads(spark: SparkSession) -> None:
    """Let plans use how staged tables lie: joins on ``(page_id, …)`` keep the buckets instead of dealing both
    sides anew, a bucket of one sorted file is read as sorted, and aggregates of sorted rows stream."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")


def materialize(df, name: str, key: str = "page_id", sort: list[str] | None = None):
    """See :func:`materialize_table`; returns the bucketed scan."""
    return df.sparkSession.table(materialize_table(df, name, key, sort))


def materialize_table(df, name: str, key: str = "page_id", sort: list[str] | None = None) -> str:
    """Write ``df`` once as a table bucketed by ``key`` in the shared checkpoint folder.

    Used where one intermediate result feeds many branches of a plan: the
    readers share a bucketed scan (no re-computation, no exchange on ``key``)
    and the lineage is cut, so a lost executor re-reads files.
    """
    spark = df.sparkSession
    measured_broadcasts(spark)
    staged_reads(spark)
    n = bucket_count(spark)
    path = scratch_path(spark, name)
    table = _table_name(path)
    writer = df.repartition(n, key).write.mode("overwrite").option("path", path).option("compression", STAGED_CODEC).bucketBy(n, key)
    writer.sortBy(*(sort or [key])).saveAsTable(table)
    return table


def _table_name(path: str) -> str:
    import re

    return re.sub(r"[^A-Za-z0-9_]", "_", os.path.basename(path))


def materialize_in_order(df, name: str, n: int, key: str, sort: list[str]) -> str:
    """:func:`materialize_table` of rows that come by ``key`` in ``n`` hash partitions, each ordered by ``sort``.

    Partitions are written through as buckets.  A sorted bucketed write would sort (and spill) the rows again, so
    they are written as buckets only, and the files declared as sorted afterwards.
    """
    spark = df.sparkSession
    measured_broadcasts(spark)
    staged_reads(spark)
    path = scratch_path(spark, name)
    table = _table_name(path)
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers, None)
    spark.conf.set(writers, "2")  # one bucket a task: written without a sort by bucket
    try:
        df.write.mode("overwrite").option("path", path).option("compression", STAGED_CODEC).bucketBy(n, key).saveAsTable(table + "_rows")
    finally:
        spark.conf.unset(writers) if before is None else spark.conf.set(writers, before)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    order = ", ".join(f"`{c}`" for c in sort)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY ({order}) INTO {n} BUCKETS LOCATION '{path}'")
    spark.sql(f"DROP TABLE {table}_rows")  # the name only: the files have a location of their own
    return table


def register_by_value(module) -> None:
    """Pickle a module's functions by value when shipped to Python workers."""
    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(module)
    except Exception:  # noqa: BLE001 — older cloudpickle: fall back to by-reference pickling
        pass


def bucket_count(spark: SparkSession) -> int:
    """Buckets of staged tables: ``pagefold.buckets`` if set, else ``spark.sql.shuffle.partitions``.

    Size it so a bucket holds a few hundred MB of node rows (e.g. about
    input HTML bytes × 3 / 256 MB); every later per-page stage runs one task
    per bucket without a shuffle.
    """
    return int(spark.conf.get("pagefold.buckets", None) or spark.conf.get("spark.sql.shuffle.partitions"))
