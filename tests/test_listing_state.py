from pagefold.operators.listing import completed_from_urls, listing_limit, mark_completed, pending_urls, reset_state, state_stats
from pagefold.session import scratch_path
from pagefold.sources.records import completed_source


def test_resumable_listing_state(spark):
    listings = spark.createDataFrame(
        [(1, 0, "c", "A", "https://h/a"), (1, 1, "c", "B", "https://h/b"), (1, 2, "c", "C", "https://h/c")],
        "page_id long, pos int, category string, title string, url string")
    done = completed_from_urls(spark, spark.createDataFrame([("https://h/a",)], "url string"))
    first_two = listing_limit(listings, 2)                       # the limit applies before the completed test
    assert sorted(r.url for r in pending_urls(first_two, done).collect()) == ["https://h/b"]
    parsed = spark.createDataFrame([("https://h/b", None), ("https://h/c", "boom")], "url string, _error string")
    once = mark_completed(done, parsed)
    twice = mark_completed(once, parsed)                          # idempotent; the failed URL is not marked
    assert sorted(r.url for r in twice.collect()) == ["https://h/a", "https://h/b"]
    assert state_stats(twice).first().completed_count == 2
    assert reset_state(spark).count() == 0
    assert completed_source(spark, scratch_path(spark, "missing-state")).count() == 0
