import datetime as dt

from pyspark.sql import functions as F

from pagefold.operators import jobs as J


def test_format_duration(spark):
    df = spark.createDataFrame([(None,), (0.0,), (12.34,), (125.0,), (59.96,)], "s double")
    got = [r.d for r in df.select(J.format_duration(F.col("s")).alias("d")).collect()]
    assert got == ["N/A", "N/A", "12.3s", "2m 5.0s", "60.0s"]


def test_activity_tail_drops_immediate_repeats(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, i, t0 + dt.timedelta(seconds=i), m) for i, m in enumerate(["a", "a", "b", "a", "a", "c"])]
    df = spark.createDataFrame(rows, "job_id long, event_id long, ts timestamp, message string")
    got = [r.message for r in J.activity_tail(df, F.col("message"), keep=3).orderBy("event_id").collect()]
    assert got == ["b", "a", "c"]


def test_job_requests_defaults_and_run_limit(spark):
    df = spark.createDataFrame([("https://x.org", "j", None, 800, "all"), ("ftp://x", "j", 1, 5, "all"),
                                ("https://x.org", "j", 9, 5, "all"), ("https://x.org", "j", 1, None, "odd")],
                               "url string, job_name string, depth int, max_pages int, link_filter string")
    got = [(r.depth, r.max_pages, r.reason, r.run_error) for r in J.job_requests_check(df).collect()]
    assert got == [(1, 800, None, True), (1, 5, "invalid_url", False), (9, 5, "depth_out_of_range", False),
                   (1, 50, "bad_link_filter", False)]


def test_format_duration_rounds_the_exact_value_once(spark):
    from decimal import ROUND_HALF_UP, Decimal

    values = [6.55, 0.25, 0.75, 0.004, 59.996, 1e-9, 0.05, 12.35, 59.94999999999999, 2.5, 45.45, 7.15] + [i / 100 for i in range(1, 6000, 7)]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    got = [r.d for r in df.select(J.format_duration(F.col("s")).alias("d")).collect()]
    assert got == [f"{Decimal(v).quantize(Decimal('0.1'), ROUND_HALF_UP)}s" for v in values]


def test_jobs_recent_returns_all(spark):
    rows = [(i, dt.datetime(2024, 1, 1 + i % 20)) for i in range(30)] + [(99, None)]
    df = spark.createDataFrame(rows, "job_id long, created_at timestamp")
    got = [r.job_id for r in J.jobs_recent(df).collect()]
    assert len(got) == 31 and got[0] == 19 and got[-1] == 99
    assert [r.job_id for r in J.jobs_recent(df, 2).collect()] == got[:2]


def test_whole_files_with_bad_ones(spark):
    from pyspark.sql import functions as F

    from pagefold.session import scratch_path
    from pagefold.sources.records import bad_files, scan_records

    path = scratch_path(spark, "record-files")
    texts = {"a": '{\n "title": "A",\n "sections": [{"title": "s",\n "content": "c"}]\n}', "b": "", "c": '{"title": "C", ', "d": "[1, 2", "e": '{"title": "E", "more": 1}'}
    for name, text in texts.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{name}")
    got = scan_records(spark, path, glob="*.txt").withColumn("k", F.regexp_extract("file", "/([a-e])/part", 1))
    rows = {r.k: (r.title, [tuple(s) for s in r.sections or []], r._bad) for r in got.collect()}
    assert rows["a"] == ("A", [("s", "c")], None) and rows["e"] == ("E", [], None)
    assert rows["c"][0] is None and rows["c"][2].strip() == '{"title": "C",'
    assert sorted((r.file.rsplit("/", 2)[1], r.problem) for r in bad_files(got).collect()) == [("b", "empty"), ("c", "malformed"), ("d", "malformed")]


def test_record_files_share_the_folders_of_their_tasks(spark, tmp_path):
    """A file for each conversation, in one folder for each writing task; rows as before, every file opened once."""
    import glob
    import os

    from pagefold.plans.serve_queries import q_scan_record_files
    from pagefold.session import ensure_checkpoint_dir

    turns = {c: [(t, "user" if t % 2 else "assistant", f'text "{t}"\nof {c}') for t in range(1 + c % 3)] for c in range(200)} | {None: [(0, "user", "no id")]}
    spark.createDataFrame([(c, *r) for c, rs in turns.items() for r in reversed(rs)], "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    folders = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/pagefold-record-files-*"
    older = set(glob.glob(folders))
    got = q_scan_record_files(spark, str(tmp_path))
    want = [(None if c is None else f"conv {c}", len(rs), "\n".join(f"{role}: {text}" for _, role, text in rs), None) for c, rs in turns.items()]
    want += [(None, None, None, problem) for problem in ("empty", "malformed")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert all(f.endswith(".parquet") for f in got.inputFiles())
    (made,) = set(glob.glob(folders)) - older
    files = [n for _, _, names in os.walk(made) if (n := sum(f.endswith(".txt") for f in names))]
    assert sum(files) == len(turns) + 2 and len(files) <= 9 and max(files) < len(turns) / 3
