"""Keyed changelog: changed rows per batch as immutable runs, latest-wins reads, tiered compaction.

A run ``run-A-B`` holds, for each key, the newest row of the batches A to B.  A batch writes its
changed rows as ``run-N-N``: work in proportion to the changes, not to the table.  Whenever
``FAN`` neighbouring runs of one width are complete they are merged into one of ``FAN`` times
that width, so a row is rewritten once a level (a logarithm of the number of batches) and a
read unites few runs.  Runs are named by batch numbers: a replayed batch overwrites its own
runs with the same rows, and a restart finds on storage where it stopped.  A run counts once its
``_SUCCESS`` file is there, and not while a wider one covers it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of one width that are merged into one.
FAN = 8


def _fs(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def run_folder(path: str, first: int, last: int) -> str:
    return f"{path}/run-{first:010d}-{last:010d}"


def finished_runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """``(first, last)`` of all finished runs, in order."""
    root, fs = _fs(spark, path)
    if not fs.exists(root):
        return []
    found = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("run-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            first, last = name[4:].split("-")
            found.append((int(first), int(last)))
    return sorted(found)


def visible_runs(runs: list[tuple[int, int]], upto: int | None = None) -> list[tuple[int, int]]:
    """The runs that a reader unites: of batches up to ``upto``, none inside a wider one."""
    runs = [r for r in runs if upto is None or r[1] <= upto]
    return [r for r in runs if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in runs)]


def _latest(spark: SparkSession, path: str, runs: list[tuple[int, int]], key: str) -> DataFrame:
    parts = [spark.read.parquet(run_folder(path, *r)).withColumn("_run", F.lit(r[1])) for r in runs]
    if len(parts) == 1:
        return parts[0].drop("_run")
    both = reduce(DataFrame.unionByName, parts)
    rest = [c for c in both.columns if c not in (key, "_run")]
    newest = both.groupBy(key).agg(F.max_by(F.struct(*rest), "_run").alias("_r"))
    return newest.select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def append(batch: DataFrame, path: str, number: int, key: str, fan: int = FAN) -> None:
    """Add the changed rows of batch ``number`` (one row a key), then merge the runs that it completes."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(run_folder(path, number, number))
    width = fan
    while (number + 1) % width == 0:
        first = number + 1 - width
        inside = [r for r in visible_runs(finished_runs(spark, path), number) if r[0] >= first]
        if inside and inside != [(first, number)]:
            _latest(spark, path, inside, key).write.mode("overwrite").parquet(run_folder(path, first, number))
        width *= fan


def read(spark: SparkSession, path: str, key: str, upto: int | None = None) -> DataFrame | None:
    """The current row of each key (as of batch ``upto``); None when nothing was ever written."""
    runs = visible_runs(finished_runs(spark, path), upto)
    return _latest(spark, path, runs, key) if runs else None


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the runs that wider ones cover; call it when no reader is at work on them."""
    runs = finished_runs(spark, path)
    gone = set(runs) - set(visible_runs(runs))
    _, fs = _fs(spark, path)
    for r in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(run_folder(path, *r)), True)
    return len(gone)
