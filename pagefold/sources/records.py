"""Record stages on storage (JSON records in, parquet/JSON out)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefold.functions.urls import url_slug

SECTION = T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType())])
CONTENT_SCHEMA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("sections", T.ArrayType(SECTION)),
        T.StructField("source_url", T.StringType()),
        T.StructField("scraped_at", T.StringType()),
        T.StructField("_bad", T.StringType()),
    ]
)


def scan_records(spark: SparkSession, path: str, schema: T.StructType = CONTENT_SCHEMA, multi_line: bool = True,
                 glob: str | None = "*.json") -> DataFrame:
    """A2: every record of a stage folder in the fixed schema.

    ``multi_line=True`` reads the one-document-per-file layout: files are read whole, many small
    ones to a task (``spark.sql.files.maxPartitionBytes`` and ``openCostInBytes`` pack them);
    ``False`` reads JSON lines (the layout Spark writes — prefer it at scale, it splits
    files).  A malformed record does not stop the scan: its raw text lands
    in ``_bad`` ('' for an empty file) and the fields are NULL; ``bad_files`` lists them.  The file
    name is kept as ``file``.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    if not multi_line:
        return reader.schema(schema).options(multiLine=False, **options).json(path).withColumn("file", F.input_file_name())
    whole = reader.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    read = whole.withColumn("_r", F.from_json("value", schema, options))
    raw = F.when(F.col("_r").isNull() | F.col("_r._bad").isNotNull() | (F.trim("value") == ""), F.col("value"))
    fields = [f.name for f in schema.fields if f.name != "_bad"]
    return read.select(*(F.when(raw.isNull(), F.col(f"_r.{c}")).alias(c) for c in fields), raw.alias("_bad"), "file")


def write_record_files(records: DataFrame, path: str) -> None:
    """A2's one-document-per-file layout: the text of every row in a file of its own, the files of a task in one folder.

    A folder for each record would cost a directory to make, to move at the commit and to list, the last one by one or
    task by task from the driver.  Deal the rows over as many tasks as should write; each may write a million files.
    """
    rows = records.select("value", F.spark_partition_id().alias("folder"))
    rows.write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("folder").text(path)


def bad_files(records: DataFrame) -> DataFrame:
    """``(file, problem)`` of the records that could not be read: 'empty' or 'malformed'."""
    problem = F.when(F.regexp_like(F.col("_bad"), F.lit(r"^\s*$")), "empty").otherwise("malformed")
    return records.filter(F.col("_bad").isNotNull()).select("file", problem.alias("problem"))


def latest_by_slug(records: DataFrame, url_col: str = "source_url", seq_col: str = "seq") -> DataFrame:
    """A3: one record per slug; a later write (higher ``seq``) replaces an earlier one."""
    # an aggregate, not a window: rows of one slug (the empty one collects all root pages) combine before the shuffle
    latest = F.max_by(F.struct(*(F.col(c) for c in records.columns)), F.struct(seq_col)).alias("_r")
    return records.withColumn("slug", url_slug(url_col)).groupBy("slug").agg(latest).select("_r.*", "slug")


def sink_by_slug(records: DataFrame, path: str, url_col: str = "source_url", seq_col: str = "seq") -> DataFrame:
    """A3 sink: write the latest record per slug, partition-free parquet keyed by slug."""
    out = latest_by_slug(records, url_col, seq_col)
    out.repartition("slug").write.mode("overwrite").parquet(path)
    return out


def sink_result(result: DataFrame, path: str) -> None:
    """A5: write the nested one-row-per-job crawl result as JSON (one small file per job set)."""
    result.coalesce(1).write.mode("overwrite").json(path)


def exists_by_slug(urls: DataFrame, stage: DataFrame, flag: str, url_col: str = "url") -> DataFrame:
    """Does a record with the URL's slug exist in ``stage(slug)``? Adds boolean ``flag``."""
    keys = stage.select("slug").distinct().withColumn(flag, F.lit(True))
    return urls.withColumn("slug", url_slug(url_col)).join(keys, "slug", "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False)))


def completed_source(spark: SparkSession, path: str | None) -> DataFrame:
    """The completed-URL set; a missing or unreadable state gives the empty set."""
    empty = spark.createDataFrame([], T.StructType([T.StructField("url", T.StringType())]))
    if not path:
        return empty
    try:
        df = spark.read.parquet(path)
        return df.select(F.col("url").cast("string")).distinct()
    except Exception:  # noqa: BLE001 — unreadable state counts as no state
        return empty
