from collections import deque
from urllib.parse import urlparse

from pagefold.operators.graph import bfs_pages


def brute_force(urls, ok, start, depth, max_pages):
    """The reference's FIFO loop over URL-derived same_path edges."""
    def links(u):
        p = urlparse(u)
        base = p.path.rstrip("/")
        parent = "/".join(base.split("/")[:-1])
        return [v for v in urls if v != u and urlparse(v).netloc == p.netloc
                and urlparse(v).path.rstrip("/").startswith(parent)]

    order = sorted(urls, key=lambda u: urls[u])
    queue, visited, out, done = deque([(start, 0)]), set(), [], 0
    while queue and done < max_pages:
        u, d = queue.popleft()
        if u in visited or d > depth:
            continue
        visited.add(u)
        if u not in ok:
            out.append((u, d, "failed"))
            continue
        out.append((u, d, "ok"))
        done += 1
        for v in sorted(links(u), key=lambda x: urls[x]):
            if v not in visited:
                queue.append((v, d + 1))
    return out


def test_bfs_matches_fifo_loop(spark):
    hosts = ["a.org", "b.org"]
    paths = ["/en/1", "/en/2", "/en/x/3", "/de/4", "/en/x/5", "/enau/6", "/en/x/y/7", "/de/8/", "/f/9", "/en/10"]
    urls, i = {}, 0
    for h in hosts:
        for p in paths:
            urls[f"https://{h}{p}"] = i
            i += 1
    ok = {u for u, k in urls.items() if not u.endswith(("/2", "/4"))}   # two unfetchable pages per host
    start = "https://a.org/en/x/3"
    link_side = spark.createDataFrame([(k, u) for u, k in urls.items()], "page_id long, url string")
    corpus = spark.createDataFrame([(urls[u],) for u in ok], "page_id long")
    for depth, max_pages in [(1, 50), (3, 4), (5, 50), (2, 2)]:
        got = [(r.url, r.depth, r.status) for r in bfs_pages(link_side, corpus, start, depth, max_pages).orderBy("seq").collect()]
        assert got == brute_force(urls, ok, start, depth, max_pages), (depth, max_pages)


def test_crawl_over_links_keeps_failures(spark):
    from pagefold.operators.graph import bfs_over_links, crawl_metadata, failed_urls

    corpus = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "page_id long, url string")
    links = spark.createDataFrame([("a", "x", 1), ("a", "b", 2), ("b", "a", 1), ("b", "c", 2), ("b", "y", 3), ("c", "z", 1)],
                                  "src_url string, dst_url string, pos int")
    crawl = bfs_over_links(links, corpus, "a", 2, 50)
    assert [(r.url, r.depth, r.status) for r in crawl.orderBy("seq").collect()] == [
        ("a", 0, "ok"), ("x", 1, "failed"), ("b", 1, "ok"), ("c", 2, "ok"), ("y", 2, "failed")]
    assert [r.url for r in failed_urls(crawl).collect()] == ["x", "y"]
    meta = crawl_metadata(crawl, started_at=10.0, finished_at=12.5).first()
    assert (meta.total_pages, meta.failed_urls, meta.duration_seconds) == (3, ["x", "y"], 2.5)


def test_only_open_prefixes_are_expanded():
    from pagefold.operators.graph import open_prefixes

    rows = [{"parent": p, "rank": r, "url": p} for p, r in (("/a/b", [0, 3]), ("/a/b/c", [0, 1]), ("/a", [0, 2]), ("/a/bb", [0, 0]), ("/z", [0, 9]))]
    assert [r["parent"] for r in open_prefixes(rows, ["/a/b"])] == ["/a", "/z"]  # all under /a/b were candidates before
    assert [r["parent"] for r in open_prefixes(rows, [])] == ["/a/bb", "/a/b/c", "/a", "/z"]  # best rank first; /a/b lies under /a
    assert open_prefixes(rows, [""]) == []


def test_crawl_looks_at_the_start_host_only(spark, monkeypatch):
    from pagefold.operators import graph

    urls = [(i, f"https://h{i % 40}.org/a/{i}") for i in range(400)] + [(1000 + i, f"https://h1.org/b/{i}") for i in range(5)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    written, plain = [], graph._checkpoint
    monkeypatch.setattr(graph, "_checkpoint", lambda df: written.append(out := plain(df)) or out)
    got = bfs_pages(pages, pages.select("page_id"), "https://h1.org/a/1", 5, 8).orderBy("seq").collect()
    table = {u: i for i, u in urls}
    assert [(r.url, r.depth, r.status) for r in got] == brute_force(table, set(table), "https://h1.org/a/1", 5, 8)
    assert written[0].count() == 15  # the index: pages of the start host
    assert sum(w.count() for w in written[1:]) == 8  # a level is written once, after the budget's cut
