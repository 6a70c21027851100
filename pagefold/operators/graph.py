"""Breadth-first crawl over the link graph, one join per level.

The reference walks a FIFO queue: pop (url, depth); skip visited; skip
depth > max; fetch; on success append the page's discovered links at
depth + 1; stop after ``max_pages`` successful pages.  Here a level is a
DataFrame and the queue order is a *rank*: the start page has rank
``[page_id]`` and a page discovered at the next level has rank
``min(rank of the pages linking to it) ++ [its page_id]``, so sorting a
level by rank reproduces the FIFO order (a URL reached from several parents
sits at its first occurrence; children of one parent come in link order).

Edges.  The reference follows links under a filter; on a corpus whose hrefs
do not hit other corpus pages, the graph is derived from URLs: page ``a``
links to every other page ``b`` of the same host whose path (trailing '/'
removed) starts with ``a``'s parent path (the ``same_path`` rule).  Neither
these pairs (quadratic inside a host) nor any index of path prefixes is
built: a level is a range of the start host's paths, the ones under the
frontier's parent paths (:func:`open_prefixes`).  Real link tables (C10 output) go
through :func:`bfs_over_links` with the same level logic.

The loop runs at most ``depth + 1`` times (depth ≤ 5).  Each level cuts the
budget in rank order: it keeps candidates up to the ``remaining``-th
successful one (top-k with k ≤ max_pages, never a global sort).  Only what is
kept of a level is written, once (reliable checkpoint in the shared
checkpoint folder), so lineage stays flat and a lost executor re-reads files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.functions.urls import parent_dir, rstrip_slash, url_netloc, url_path_noparams
from pagefold.session import ensure_checkpoint_dir

CRAWL_COLUMNS = ["seq", "page_id", "url", "depth", "rank", "status", "parent_url", "via_url"]


def page_index(pages: DataFrame) -> DataFrame:
    """``(page_id, url, host, path, parent)`` with the ``same_path`` path forms."""
    p = pages.select("page_id", "url")
    return p.select(
        "page_id",
        "url",
        url_netloc("url").alias("host"),
        rstrip_slash(url_path_noparams("url")).alias("path"),
    ).withColumn("parent", parent_dir(F.col("path")))


def open_prefixes(parents: list, expanded: list[str]) -> list:
    """The ``(parent, rank, url)`` rows, best rank first, whose parent path lies under none of ``expanded``: the pages
    below an expanded path were all candidates of an earlier level already.

    A page under the prefix P has a parent path under P, too, unless it has no further '/', and then
    its parent is P's: so a level leaves one open prefix for each prefix of the level before.
    """
    rows = sorted((r for r in parents if not any(r["parent"].startswith(p) for p in expanded)), key=lambda r: r["rank"])
    out: list = []
    for r in rows:  # a prefix under a better-ranked one adds nothing
        if not any(r["parent"].startswith(o["parent"]) for o in out):
            out.append(r)
    return out


def _checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bfs_pages(
    link_side: DataFrame,
    corpus: DataFrame,
    start_url: str,
    depth: int = 1,
    max_pages: int = 50,
) -> DataFrame:
    """D1–D4 over URL-derived edges.

    ``link_side(page_id, url)``: pages that can be linked to (URL universe);
    ``corpus(page_id)`` — or ``(url)`` — the pages that were fetched
    successfully.  Returns the crawl log: one row per dequeued URL in crawl
    order (``seq``), ``status`` ok/failed, ``parent_url`` as the reference
    records it (NULL at depth 0, else the start URL), ``via_url`` the true
    discovering parent.  Only the start URL's host is kept and looked at.
    """
    spark = link_side.sparkSession
    host = spark.range(1).select(url_netloc(F.lit(start_url)).alias("h")).first()["h"]
    key = "page_id" if "page_id" in corpus.columns else "url"
    fetched = corpus.select(key).distinct().withColumn("_ok", F.lit(True))
    here = page_index(link_side).filter(F.col("host") == host)
    idx = _checkpoint(here.join(fetched, key, "left").select(
        "page_id", "url", "path", "parent", F.when(F.col("_ok"), "ok").otherwise("failed").alias("status")))
    expanded: list[str] = []

    def expand(frontier: DataFrame) -> DataFrame | None:
        # at most max_pages frontier rows, so at most that many parent paths
        found = (frontier.join(idx.select("page_id", "url", "parent"), ["page_id", "url"])
                 .groupBy("parent").agg(F.min(F.struct("rank", "url")).alias("p")).select("parent", "p.rank", "p.url").collect())
        opened = open_prefixes(found, expanded)
        if not opened:
            return None
        expanded.extend(r["parent"] for r in opened)
        via = F.lit(None)
        for r in reversed(opened):
            under = F.col("path").startswith(r["parent"])
            via = F.when(under, F.struct(F.array(*(F.lit(x).cast("long") for x in r["rank"])).alias("rank"), F.lit(r["url"]).alias("url"))).otherwise(via)
        hit = idx.withColumn("_p", via).filter("_p is not null")
        return hit.groupBy("page_id", "url", "status").agg(F.first("_p").alias("_p")).select(
            "page_id", "url", F.concat("_p.rank", F.array("page_id")).alias("rank"), F.col("_p.url").alias("via_url"), "status")

    return _bfs_loop(idx, start_url, depth, max_pages, expand)


def bfs_over_links(
    links: DataFrame,
    corpus: DataFrame,
    start_url: str,
    depth: int = 1,
    max_pages: int = 50,
) -> DataFrame:
    """D1 over an explicit link table ``links(src_url, dst_url, pos)`` (e.g. C10 structural links).

    ``corpus(page_id, url)`` are the fetchable pages.  A URL absent from the
    corpus is a failed fetch (D3).  Ranks use the link position ``pos``.
    """
    links = _checkpoint(links.select("src_url", "dst_url", "pos"))  # read again by every level
    urls = links.select(F.col("dst_url").alias("url")).union(corpus.select("url")).distinct()
    idx = _checkpoint(
        urls.join(corpus.select("url", "page_id"), "url", "left").select(
            F.coalesce("page_id", F.lit(-1) - F.abs(F.xxhash64("url"))).alias("page_id"), "url",
            F.when(F.col("page_id").isNotNull(), "ok").otherwise("failed").alias("status"))
    )

    def expand(frontier: DataFrame) -> DataFrame:
        out = frontier.select(F.col("url").alias("src_url"), "rank").join(links, "src_url")
        return (
            out.groupBy(F.col("dst_url").alias("url"))
            .agg(F.min(F.struct("rank", "pos", "src_url")).alias("_p"))
            .join(idx, "url")
            .select("page_id", "url", F.concat(F.col("_p.rank"), F.array(F.col("_p.pos").cast("long"))).alias("rank"),
                    F.col("_p.src_url").alias("via_url"), "status")
        )

    return _bfs_loop(idx, start_url, depth, max_pages, expand)


def _bfs_loop(idx, start_url, depth, max_pages, expand) -> DataFrame:
    """``idx(page_id, url, status)``; ``expand`` maps a frontier to its candidates, or None when there are none."""
    spark = idx.sparkSession
    start = idx.filter(F.col("url") == start_url).select("page_id", "url", "status").limit(1)
    if start.isEmpty():
        start = spark.createDataFrame([(-1, start_url, "failed")], "page_id long, url string, status string")
    level = _checkpoint(start.select(
        "page_id", "url", F.array("page_id").alias("rank"), F.lit(None).cast("string").alias("via_url"), "status", F.lit(0).alias("depth")))
    levels = [level]
    done = level.filter(F.col("status") == "ok").count()
    d = 0
    while d < depth and done < max_pages:
        cand = expand(level.filter(F.col("status") == "ok").select("page_id", "url", "rank"))
        if cand is None:
            break
        visited = levels[0].select("url")
        for lv in levels[1:]:
            visited = visited.union(lv.select("url"))
        cand = cand.join(visited, "url", "left_anti").withColumn("depth", F.lit(d + 1))
        remaining = max_pages - done
        top = cand.filter(F.col("status") == "ok").orderBy("rank").limit(remaining)
        stats = top.agg(F.count("*").alias("n"), F.max("rank").alias("r")).first()
        if stats["n"] == remaining:
            cand = cand.filter(F.col("rank") <= F.array(*[F.lit(x).cast("long") for x in stats["r"]]))
        level = _checkpoint(cand.select(level.columns))
        if level.isEmpty():
            break
        levels.append(level)
        done += int(stats["n"])
        d += 1
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    from pyspark.sql import Window

    # the crawl log is bounded: ≤ max_pages successes plus the failures ranked before the cut
    seq = F.row_number().over(Window.orderBy("depth", "rank")) - 1
    return out.select(
        seq.alias("seq"),
        "page_id",
        "url",
        "depth",
        "rank",
        "status",
        F.when(F.col("depth") == 0, F.lit(None).cast("string")).otherwise(F.lit(start_url)).alias("parent_url"),
        "via_url",
    )


def failed_urls(crawl: DataFrame) -> DataFrame:
    """D3: URLs dequeued but not fetched, in crawl order."""
    return crawl.filter(F.col("status") == "failed").select("seq", "url", "depth")


def crawl_metadata(crawl: DataFrame, enriched: DataFrame | None = None, started_at: float | None = None,
                   finished_at: float | None = None) -> DataFrame:
    """total_pages, successful_enrichments, visited_urls, failed_urls (in crawl order), and
    duration_seconds when the epoch seconds of start and end are given.

    A crawl with no successful page carries error 'No pages scraped'.
    """
    ok = F.col("status") == "ok"
    agg = crawl.agg(
        F.count_if(ok).alias("total_pages"),
        F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("seq", "url")))), lambda x: x["url"]).alias(
            "visited_urls"),
        F.transform(F.array_sort(F.collect_list(F.when(~ok, F.struct("seq", "url")))), lambda x: x["url"]).alias(
            "failed_urls"),
    )
    n_enriched = enriched.count() if enriched is not None else 0
    agg = agg.withColumn("successful_enrichments", F.lit(n_enriched).cast("long"))
    if started_at is not None and finished_at is not None:
        agg = agg.withColumn("duration_seconds", F.lit(float(finished_at) - float(started_at)))
    return agg.withColumn("error", F.when(F.col("total_pages") == 0, F.lit("No pages scraped")))
