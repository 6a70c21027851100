from pyspark.sql import functions as F

from pagefold.session import scratch_path
from pagefold.sources.tables import PAGES_SCHEMA
from pagefold.streaming.stream import stream_dedupe_url, stream_pages


def _summary(batch):
    return batch.select("page_id", F.length("html").alias("n"))


def test_stream_matches_batch_and_survives_restart(spark):
    src = scratch_path(spark, "stream-src")
    rows = [(i, f"https://h.org/p/{i % 3}", f"<p>{'x' * i}</p>") for i in range(6)]
    spark.createDataFrame(rows[:3], PAGES_SCHEMA).write.mode("overwrite").parquet(src + "/a")
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    stream_pages(spark, src + "/*", out, ckpt, _summary, PAGES_SCHEMA)
    spark.createDataFrame(rows[3:], PAGES_SCHEMA).write.mode("overwrite").parquet(src + "/b")
    stream_pages(spark, src + "/*", out, ckpt, _summary, PAGES_SCHEMA)      # restart: only the new file is read
    got = sorted((r.page_id, r.n) for r in spark.read.parquet(out).collect())
    assert got == sorted((i, len(h)) for i, _, h in rows)

    dout, dckpt = scratch_path(spark, "dedupe-out"), scratch_path(spark, "dedupe-ckpt")
    stream_dedupe_url(spark, src + "/*", dout, dckpt, PAGES_SCHEMA)
    assert sorted(r.url for r in spark.read.parquet(dout).collect()) == sorted({u for _, u, _ in rows})


def test_job_latest_goes_on_after_restarts(spark):
    import datetime as dt

    from pagefold.sources import changelog
    from pagefold.streaming.stream import stream_job_latest

    schema = "job_id long, event_id long, ts timestamp, status string, value double"
    kind = spark.createDataFrame([], schema).schema
    t0 = dt.datetime(2024, 1, 1)
    src, out, ckpt = (scratch_path(spark, f"jobs-{x}") for x in ("src", "out", "ckpt"))

    def put(name, rows):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{src}/{name}")

    def run():
        latest = stream_job_latest(spark, src + "/*", out, ckpt, kind, lambda d: d)
        return sorted((r.job_id, r.status) for r in latest.collect()) if latest else []

    put("a", [(1, 1, t0, "queued", 0.0), (2, 2, t0, "queued", 0.0)])
    assert run() == [(1, "queued"), (2, "queued")]
    put("b", [(3, 3, t0, "queued", 0.0), (1, 4, t0 + dt.timedelta(seconds=1), "failed", 1.0)])
    assert run() == [(1, "failed"), (2, "queued"), (3, "queued")]
    runs = changelog.finished_runs(spark, out)
    assert run() == [(1, "failed"), (2, "queued"), (3, "queued")]  # nothing new
    # the second batch wrote its changed jobs only, and the table as of the first is still there
    assert spark.read.parquet(changelog.run_folder(out, *runs[-1])).count() == 2
    assert sorted((r.job_id, r.status) for r in changelog.read(spark, out, "job_id", upto=runs[0][1]).collect()) == [(1, "queued"), (2, "queued")]


def test_changelog_merges_and_replays(spark):
    import random

    from pagefold.sources import changelog

    path, rng, table, sizes = scratch_path(spark, "changelog"), random.Random(4), {}, []
    assert changelog.read(spark, path, "k") is None
    batches = []
    for n in range(20):
        keys = rng.sample(range(60), 5) + [1000 + n]  # the table grows, a batch doesn't
        batches.append([(k, f"{n}-{k}", None if k % 7 == 0 else n) for k in keys])
        changelog.append(spark.createDataFrame(batches[-1], "k long, a string, b int").coalesce(1), path, n, "k", fan=3)
        table.update({k: (k, a, b) for k, a, b in batches[-1]})
        sizes.append(spark.read.parquet(changelog.run_folder(path, n, n)).count())
        if n in (0, 8, 19):
            assert sorted(map(tuple, changelog.read(spark, path, "k").collect())) == sorted(table.values())
    assert set(sizes) == {6} and len(table) > 60
    runs = changelog.finished_runs(spark, path)
    assert changelog.visible_runs(runs) == [(0, 8), (9, 17), (18, 18), (19, 19)]
    # a replayed batch, a merge that never finished and a vacuum change nothing
    changelog.append(spark.createDataFrame(batches[17], "k long, a string, b int"), path, 17, "k", fan=3)
    spark.createDataFrame([(1, "bad", 1)], "k long, a string, b int").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(changelog.run_folder(path, 18, 20))
    assert changelog.vacuum(spark, path) > 0
    assert sorted(map(tuple, changelog.read(spark, path, "k").collect())) == sorted(table.values())


def test_watermark_bounds_the_state(spark):
    import datetime as dt

    src, out, ckpt = (scratch_path(spark, f"water-{x}") for x in ("src", "out", "ckpt"))
    schema = "url string, ts timestamp"
    t0 = dt.datetime(2024, 1, 1)

    def put(name, rows):
        spark.createDataFrame([(u, t0 + dt.timedelta(minutes=m)) for u, m in rows], schema).coalesce(1).write.parquet(f"{src}/{name}")

    def run():
        kind = spark.createDataFrame([], schema).schema
        return stream_dedupe_url(spark, src + "/*", out, ckpt, kind, watermark=("ts", "10 minutes"), max_files=1)

    for n in range(6):  # an hour a file, each with a repeat and a row of its own
        put(f"{n}", [(f"own{n}", 60 * n), (f"own{n}", 60 * n + 1), ("always", 60 * n + 2)])
    states = run()
    assert max(states) <= 4  # two keys a file; those of the hour before are forgotten
    put("late", [("late", 5), ("always", 303), ("new", 304)])  # far behind the watermark; repeated within the delay; new
    run()
    rows = [r.url for r in spark.read.parquet(out).collect()]
    # late rows go; a key is forgotten some time after the delay (the watermark moves between batches), never before
    assert sorted(r for r in rows if r != "always") == sorted([f"own{n}" for n in range(6)] + ["new"])
    assert 1 < rows.count("always") <= 6


def test_one_malformed_page_fails_alone(spark):
    from pagefold.operators.nodes import html_nodes, parse_errors, parsed_pages
    from pagefold.plans.stream_queries import page_summary_batch

    rows = [(1, "https://h.org/1", "<h1>One</h1>"), (2, "https://h.org/2", "<p>x</p><![foo[x]]><p>y</p>"), (3, "https://h.org/3", "<h1>Three</h1>")]
    pages = spark.createDataFrame(rows, PAGES_SCHEMA)
    nodes = html_nodes(pages)
    assert sorted(r.page_id for r in parsed_pages(nodes).collect()) == [1, 3]
    assert [(r.page_id, "unknown status keyword" in r._error) for r in parse_errors(nodes).collect()] == [(2, True)]
    src, out, ckpt = (scratch_path(spark, f"bad-{x}") for x in ("src", "out", "ckpt"))
    pages.write.mode("overwrite").parquet(src + "/a")
    stream_pages(spark, src + "/*", out, ckpt, page_summary_batch, PAGES_SCHEMA)
    assert sorted((r.page_id, r.title) for r in spark.read.parquet(out).collect()) == [(1, "One"), (3, "Three")]
