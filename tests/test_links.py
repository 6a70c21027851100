from pagefold.operators.links import categorize_links, listing_links
from pagefold.operators.nodes import html_nodes

PAGE = ("https://h.org/sec/page",
        "<html><body><div class='tiles-container'><div class='tile'><a href='/sec/t1'>T1</a></div>"
        "<div class='tile'><a href='/sec/t1'>T1 again</a></div></div>"
        "<p>Read <a href='/sec/ref'>the ref</a> here</p>"
        "<a href='#'>top</a><a href='mailto:x@y'>mail</a><a href='javascript:void(0)'>js</a>"
        "<a class='table-link' href='/sec/tab'>tab</a><a href='/sec/ref'>dup</a>"
        "<a href='#part'>part</a><a href='https://other.org/sec/x'>ext</a></body></html>")


def test_categorize_quirks(spark, pages):
    df = pages([(1,) + PAGE])
    out = categorize_links(html_nodes(df, "generic"), df, "same_path").orderBy("stage", "ord").collect()
    got = [(r.bucket, r.url, r.text, r.context) for r in out]
    assert got[0][:2] == ("structural", "https://h.org/sec/t1")
    assert got[1][:2] == ("structural", "https://h.org/sec/t1")           # tile duplicates survive
    assert ("referenced", "https://h.org/sec/ref", "the ref", "Readthe refhere") in got
    assert ("structural", "https://h.org/sec/tab", None, None) in got       # 'table' contains 'tab'
    assert ("structural", "https://h.org/sec/page#part", None, None) in got  # in-page anchor
    urls = [g[1] for g in got]
    assert urls.count("https://h.org/sec/ref") == 1                          # first occurrence only
    assert not any("other.org" in u or "mailto" in u or u.endswith("#") for u in urls)


def test_listing_category_rules(spark, pages):
    html = ("<html><body><a href='/d/0'>before</a>" + "".join(f"<h3></h3>" for _ in range(3))
            + "<h2>Cat A</h2><a href='/d/1/?x=1#f'>One</a><a href='/d/1'>Dup</a><a href='/d/2'> </a>"
            + "".join("<h3></h3>" for _ in range(10)) + "<a href='/d/3'>Three</a></body></html>")
    df = pages([(1, "https://h.org/list/", html)])
    got = [(r.category, r.title, r.url) for r in listing_links(html_nodes(df, "detail"), df).orderBy("pos").collect()]
    assert got == [("Cat A", "One", "https://h.org/list/d/1"), ("", "Three", "https://h.org/list/d/3")]
