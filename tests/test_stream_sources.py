from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefold.plans.registry import QUERIES, load_all
from pagefold.session import scratch_path
from pagefold.sources.tables import PAGES_SCHEMA


def test_streams_read_a_table_of_part_files(spark):
    load_all()
    folder = scratch_path(spark, "parts")
    rows = [(i, f"https://h.org/p/{i % 3}", f"<html><body><h1>T{i}</h1><p>some text</p></body></html>") for i in range(6)]
    spark.createDataFrame(rows, PAGES_SCHEMA).repartition(3).write.parquet(folder + "/pages.parquet")
    assert sorted(r.url for r in QUERIES["stream_dedupe_url"](spark, folder).collect()) == sorted({u for _, u, _ in rows})
    assert sorted((r.page_id, r.title) for r in QUERIES["stream_pages"](spark, folder).collect()) == [(i, f"T{i}") for i in range(6)]


def test_streams_read_a_table_of_one_file_and_an_events_folder(spark):
    load_all()
    folder = scratch_path(spark, "one")
    import glob
    import os
    import shutil

    spark.createDataFrame([(1, "https://h.org/a", "<p>x</p>")], PAGES_SCHEMA).coalesce(1).write.parquet(folder + "/w")
    local = folder.removeprefix("file:")
    shutil.copy(glob.glob(local + "/w/*.parquet")[0], local + "/pages.parquet")
    assert os.path.isfile(local + "/pages.parquet")
    assert [r.url for r in QUERIES["stream_dedupe_url"](spark, folder).collect()] == ["https://h.org/a"]
    events = spark.range(4).select(F.col("id").alias("event_id"), F.lit("2024-01-01 00:00:00").cast(T.TimestampType()).alias("ts"))
    events.unionAll(events).repartition(2).write.parquet(folder + "/events.parquet")
    assert sorted(r.event_id for r in QUERIES["stream_dedupe_watermark"](spark, folder).collect()) == [0, 1, 2, 3]
