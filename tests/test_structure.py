"""The interval join and what is built on it: depth, siblings, selectors with ancestors, markup equality."""

import random

import pytest
from pyspark.sql import functions as F

from pagefold.operators import generic as G
from pagefold.operators.dom import gather, is_elem, subtree_text, upto
from pagefold.operators.links import categorize_links, link_scan, listing_links, structural_flag
from pagefold.operators.nodes import html_nodes, tokenize
from pagefold.plans.parse_queries import STRUCTURAL_LINKS


def test_upto_is_a_binary_search(spark):
    rng = random.Random(1)
    rows = []
    for n in [0, 1, 2, 3, 7, 8, 9, 63, 64, 65, 500]:
        pres = sorted(rng.sample(range(1000), n))
        rows += [(pres, x, sum(p <= x for p in pres)) for x in (-1, 0, 999, *rng.sample(range(1000), 5), *pres[:1], *pres[-1:])]
    df = spark.createDataFrame(rows, "pres array<int>, x int, want int")
    assert df.filter(upto(F.col("pres"), F.col("x")) != F.col("want")).count() == 0


def random_html(rng, n):
    tags, out = ["div", "p", "ol", "li", "b", "a"], []
    for _ in range(n):
        out.append(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", f"t{rng.randrange(9)} ", "<!--c-->"]))
    return "".join(out)


def test_texts_of_nested_elements_equal_brute_force(spark, pages):
    rng = random.Random(2)
    html = {i: random_html(rng, 120) for i in range(20)}
    nodes = html_nodes(pages([(i, "u", h) for i, h in html.items()]), "generic")
    targets = nodes.filter(is_elem()).select("page_id", "pre", "last")
    got = {(r.page_id, r.pre): r.text for r in subtree_text(nodes, targets, sep="|").collect()}
    want = {}
    near = {}
    for i, h in html.items():
        rows = tokenize(h, "generic")
        for r in rows:
            if r[5] == "elem":
                text = "|".join(x[9].strip() for x in rows if x[5] == "text" and r[0] < x[0] <= r[1] and x[9].strip())
                if text:
                    want[i, r[0]] = text
            up = []
            k = r[2]
            while k is not None:
                up.append((k, rows[k][6]))
                k = rows[k][2]
            near[i, r[0]] = tuple(next((k for k, t in up if t in some), None) for some in (("p", "li", "td", "div"), ("ol",)))
    assert got == want
    assert {(r.page_id, r.pre): (r.ctx, r.ol) for r in nodes.select("page_id", "pre", "ctx", "ol").collect()} == near


def test_gather_keeps_target_columns_and_pages_without_items(spark):
    targets = spark.createDataFrame([(1, 0, 9, "a"), (1, 3, 5, "b"), (2, 0, 4, "c")], "page_id long, pre int, last int, note string")
    items = spark.createDataFrame([(1, 5, "y"), (1, 3, "x"), (1, 9, "z"), (3, 1, "w")], "page_id long, pre int, v string")
    got = gather(targets, items, lambda x, t: F.concat(t["note"], F.array_join(x, "")), "f").collect()
    assert sorted((r.page_id, r.pre, r.last, r.note, r.f) for r in got) == [(1, 0, 9, "a", "axyz"), (1, 3, 5, "b", "by"), (2, 0, 4, "c", "c")]


def test_space_is_linear_in_a_deep_page(spark, pages):
    """20,000 unclosed elements: a node holds its interval, parent and two nearest ancestors, never a list of them."""
    nodes = html_nodes(pages([(1, "u", "<p>x" * 20_000)]), "generic")
    assert not [f.name for f in nodes.schema if f.dataType.typeName() == "array" and f.name != "classes"]
    row = nodes.agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.max("ctx").alias("ctx")).first()
    assert (row.n, row.depth, row.ctx) == (40_001, 20_001, 39_999)


def test_accordions_take_the_next_sibling_only(spark, pages):
    n = 3_000
    html = "<body>" + "".join(f"<button aria-expanded=false>B{i}</button><div>panel {i}</div>" for i in range(n)) + "<button class=accordion-button>end</button></body>"
    nodes = html_nodes(pages([(1, "u", html)]), "generic")
    area = G.content_area(nodes, None)
    rows = G.interactive_sections(nodes, G.node_lines(nodes), area, G.removed_summaries(nodes, area)).collect()
    assert sorted((r.section_name, r.content) for r in rows) == sorted((f"B{i}", f"panel {i}") for i in range(n))


def test_nested_details_lose_summaries_in_order(spark, pages):
    cases = {
        # the outer has its own summary first: its content still shows the inner one's
        1: ("<details><summary>Out</summary>a<details><summary>In</summary>b</details></details>", [("Out", "a\nIn\nb"), ("In", "b")]),
        # the outer finds the inner's summary first, so the inner is left without
        2: ("<details><details><summary>In</summary>b</details><summary>Out</summary>c</details>", [("In", "b\nOut\nc"), ("Details", "b")]),
        # a summary takes the details inside it along
        3: ("<details><summary>S<details><summary>T</summary>x</details></summary>y</details>", [("STx", "y"), ("Details", "")]),
        4: ("<details>plain</details><details><summary>Z</summary></details>", [("Details", "plain"), ("Z", "")]),
    }
    df = pages([(i, "https://h.org/p", f"<body>{h}</body>") for i, (h, _) in cases.items()])
    nodes = html_nodes(df, "generic")
    area = G.content_area(nodes, None)
    rows = G.interactive_sections(nodes, G.node_lines(nodes), area, G.removed_summaries(nodes, area)).orderBy("pre").collect()
    for i, (_, want) in cases.items():
        assert [(r.section_name, r.content) for r in rows if r.page_id == i] == want
    main = {r.page_id: r.main_content for r in G.generic_page(nodes, df).collect()}
    assert main[1] == "a\nb" and main[2] == "b\nOut\nc"  # main content comes after all removals


def test_list_items_are_equal_by_their_whole_markup(spark, pages):
    html = ("<ol><li><b>x</b></li><li>x</li><li><b>x</b></li><li class='k' id='i'>y</li><li id='i' class='k'>y</li>"
            "<li><b><i>z</i></b></li><li><b></b><i>z</i></li></ol>")
    lines = G.node_lines(html_nodes(pages([(1, "u", html)]), "generic")).orderBy("pre").collect()
    assert [r.line for r in lines if r.line[:2].strip(". ").isdigit()] == ["1. x", "2. x", "1. x", "4. y", "4. y", "6. z", "7. z"]


def test_structural_selectors(spark, pages):
    html = "".join(f"<div>{around.format(a=f'<a href=/p/{k}>{inside}</a>')}</div>" for k, (around, inside, _) in enumerate(STRUCTURAL_LINKS))
    nodes = html_nodes(pages([(1, "u", html)]), "generic")
    anchors = link_scan(nodes)
    rows = structural_flag(nodes, anchors).join(anchors.select("page_id", "pre", "href"), ["page_id", "pre"]).collect()
    got = {int(r.href.rsplit("/", 1)[1]): r.structural for r in rows}
    assert got == {k: flag for k, (_, _, flag) in enumerate(STRUCTURAL_LINKS)}


def test_follow_all_and_link_pattern(spark, pages):
    html = ("<body><a href='/s/a'>A</a><p><a href='/s/b#f'>B</a></p><a href='#x'>here</a><a href='mailto:x@y'>m</a>"
            "<a href='https://o.org/s/c'>C</a><h2>Cat</h2><a href=' /s/d?q=1 '>D</a></body>")
    df = pages([(1, "https://h.org/s/p", html)])
    nodes = html_nodes(df, "generic")
    got = [(r.bucket, r.url, r.text) for r in categorize_links(nodes, df, "same_domain", follow_all=True).orderBy("stage", "ord").collect()]
    assert got == [("structural", u, None) for u in ("https://h.org/s/a", "https://h.org/s/b#f", "https://h.org/s/p#x", "https://h.org/s/d?q=1 ")]
    items = listing_links(nodes, df, link_pattern=r"^/s/[cd][?]q")  # found in the stripped href, before it is cut
    assert [(r.category, r.title, r.url) for r in items.collect()] == [("Cat", "D", "https://h.org/s/p/s/d")]
