"""Helpers shared by the operators: staging, worker caches, Arrow slicing, connected components."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.session import ensure_checkpoint_dir


#: Rows and bytes of an Arrow batch on its way to a Python worker, at most: texts, packs and vectors are
#: large rows, and the batches of all tasks of an executor lie outside its heap.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to the above (smaller settings stay)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        text = spark.conf.get(key, None)
        now = int(text) if text and text.lstrip("-").isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    small_batches(df.sparkSession)
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """A value kept in a Python worker process (functions are shipped by value, so module globals would
    last for one task only) until a step of another operator runs there (see ``frugal``)."""
    kept = sys.__dict__.setdefault("_pagefold_llm", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def frugal(run: Callable) -> Callable:
    """``run`` over Arrow batches, handing freed memory back to the system at the end of each task: workers
    live on, and several of them share an executor's memory with its JVM.  What steps of another
    operator (module) keep in the worker is dropped first."""
    owner = run.__module__

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        if sys.__dict__.get("_pagefold_llm_owner") != owner:
            sys.__dict__.get("_pagefold_llm", {}).clear()
            sys.__dict__["_pagefold_llm_owner"] = owner
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that each piece holds about ``most`` bytes of ``column`` (one row at least)."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def connected_components(spark: SparkSession, edges: DataFrame, name: str = "cc") -> DataFrame:
    """``(id, component)`` for every id of ``edges(a, b)``; component is the smallest id reachable.

    Alternating large-star / small-star steps (each a groupBy with map-side combine and a join
    keyed by node, so a hub is split by Spark's skew handling).  A group is never collected: the
    star steps need only the minimum neighbour of a node, not the list.  Each step is written to
    the shared folder, so the lineage stays short and a lost executor re-reads files.  Empty
    input gives an empty result.
    """
    edges = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .filter("u > v").distinct())
    edges = stage(edges, f"{name}-e")
    before = None
    while True:
        # large star: every larger neighbour of u is linked to u's smallest neighbour (or u itself)
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (both.filter("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(low, "u")
        small = (step.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        edges = stage(small, f"{name}-e")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now
