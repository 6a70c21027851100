from pyspark.sql import functions as F

from pagefold.session import materialize


def test_staged_keys_are_not_broadcast_by_their_file_size(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    keys = spark.range(200_000).select(F.floor(F.col("id") / 100).alias("page_id"), (F.col("id") % 100).cast("int").alias("pre"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        left, right = materialize(keys, "keys-left"), materialize(keys, "keys-right")
        joined = left.join(right, ["page_id", "pre"])
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()
        assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") is not None
        assert joined.count() == 200_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_parse_hands_on_small_batches():
    import pyarrow as pa

    from pagefold.operators.nodes import _nodes_fn

    rows = [(i, "<p>x</p>" * 400) for i in range(100)] + [(100 + i, "<p>" + "y" * 1_000_000 + "</p>") for i in range(20)]
    source = pa.RecordBatch.from_pydict({"page_id": [i for i, _ in rows], "html": [h for _, h in rows]})
    batches = list(_nodes_fn("generic")(iter([source])))
    assert sum(b.num_rows for b in batches) == 100 * 801 + 20 * 3
    assert max(b.num_rows for b in batches) <= 20_000
    assert max(sum(len(t or "") for t in b.column("text").to_pylist()) for b in batches) < 10_000_000


def test_licence_fit_counts_every_distinct_paragraph(spark, monkeypatch):
    from pagefold.llm import license_scan

    texts = ["\n".join(f"paragraph {i} of text {k} is plain" for i in range(30)) for k in range(200)]
    texts.append("Released under the MIT License.\nWe talked about the software as is, without warranty, at length.")
    docs = spark.createDataFrame(list(enumerate(texts)) + [(999, texts[0])], "doc_id long, text string")
    distinct = {x for t in texts for x in t.split("\n")} - {"Released under the MIT License."}
    assert len(distinct) > 6000
    hashes = spark.createDataFrame([(x,) for x in distinct], "x string").select(F.xxhash64("x", F.lit(11)).alias("h"))
    fitted, plain = {}, license_scan.stage_vectors

    def spy(rows):
        fitted.update({r.label: r.w for r in rows.groupBy("label").agg(F.sum("weight").alias("w")).collect()})
        return plain(rows)

    monkeypatch.setattr(license_scan, "stage_vectors", spy)
    license_scan.train(docs)
    assert fitted[0.0] == hashes.filter(F.col("h") % 2 != 0).count()


def test_a_table_of_one_row_group_is_parsed_by_many_tasks(spark):
    from pagefold.plans.stage import corpus_nodes
    from pagefold.session import scratch_path

    folder = scratch_path(spark, "one-group")
    rows = spark.range(400).select(F.col("id").alias("page_id"), F.lit("https://h.org/a").alias("url"), F.lit("<p>x</p>").alias("html"))
    rows.coalesce(1).write.parquet(folder + "/pages.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # many splits, one of them with the rows
    try:
        from pagefold.operators import nodes as N
        from pagefold.plans import stage

        seen, plain = [], stage.html_nodes
        stage.html_nodes = lambda pages, mode: seen.append(pages) or plain(pages, mode)
        try:
            assert corpus_nodes(spark, folder).filter("kind = 'root'").count() == 400
        finally:
            stage.html_nodes = plain
        tasks = seen[0].groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) >= 2 * spark.sparkContext.defaultParallelism
        assert max(r["count"] for r in tasks) <= 400 / len(tasks) * N.TASKS_A_SPLIT + 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
