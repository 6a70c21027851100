"""Versioned tables: immutable folders ``version=N`` below a path, the newest finished one counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def newest_version(spark: SparkSession, path: str, below: int | None = None) -> str:
    """Folder of the newest finished version (of numbers under ``below``), '' when there is none.

    A version counts once its ``_SUCCESS`` file is there; the listing goes through the Hadoop file
    API, so it works on any store that Spark reads.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(root):
        return ""
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    numbers = sorted((int(n[len("version="):]) for n in names if n.startswith("version=")), reverse=True)
    for n in numbers:
        folder = version_folder(path, n)
        if (below is None or n < below) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")):
            return folder
    return ""


def version_folder(path: str, number: int) -> str:
    return f"{path}/version={number:08d}"


def write_version(df: DataFrame, path: str) -> str:
    """Write ``df`` as the version after the newest one; a run that failed leaves an unfinished folder
    that the next run overwrites."""
    newest = newest_version(df.sparkSession, path)
    folder = version_folder(path, int(newest.rsplit("=", 1)[1]) + 1 if newest else 0)
    df.write.mode("overwrite").parquet(folder)
    return folder
