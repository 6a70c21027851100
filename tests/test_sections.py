from pagefold.operators.nodes import html_nodes
from pagefold.operators.sections import detail_page, sections


def test_primary_sections_blocks_and_summary(spark, pages):
    html = ("<html><body><nav>menu</nav><main><h1>Title  back to top</h1><div>intro</div>"
            "<h2>Fees</h2><div>Costs  apply.</div><ol><li>a</li><li></li><li>c</li></ol>"
            "<table><tr><td>x</td><td>y</td></tr><tr><td></td></tr></table>"
            "<h3></h3><div>orphan</div><h2>Empty</h2><h4>ignored</h4></main>"
            "<p>This paragraph is long enough to be the summary.</p></body></html>")
    df = pages([(1, "https://h.org/v/a", html)])
    d = detail_page(html_nodes(df, "detail"), df).first()
    assert d.title == "Title"
    assert [(s.title, s.content) for s in d.sections] == [("Fees", "Costs apply.\n\n1. a\n3. c\n\nx | y")]
    assert d.summary == "This paragraph is long enough to be the summary."   # next p after h1, outside main
    assert d.total_text_length == len("Costs apply.\n\n1. a\n3. c\n\nx | y")


def test_fallback_when_no_direct_headings(spark, pages):
    html = "<html><body><main><div><h3>S1</h3><p>one</p><ul><li>u</li></ul><h4>S2</h4><p>two</p></div></main></body></html>"
    df = pages([(1, "https://h.org/v/b", html)])
    got = [(r.title, r.content) for r in sections(html_nodes(df, "detail")).orderBy("ord").collect()]
    assert got == [("S1", "one\n\n- u"), ("S2", "two")]
