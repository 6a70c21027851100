from pagefold.operators import generic as G
from pagefold.operators.nodes import html_nodes


def test_generic_page_quirks(spark, pages):
    html = ("<html><head><title>T</title></head><body><h1>Head</h1><main>"
            "<ol><li>x</li><li>y</li><li>x</li></ol><p>para</p>"
            "<button aria-expanded='false' aria-controls='gone'>Missing</button>"
            "<button class='accordion-button'>Sib</button><div>panel text</div>"
            "<details><summary>More</summary><p>hidden body</p></details>"
            "<div role='tabpanel' id='t1'>tab body</div><a aria-controls='t1' href='#t1'>Tab One</a>"
            "</main></body></html>")
    df = pages([(1, "https://h.org/g/p", html)])
    page = G.generic_page(html_nodes(df, "generic"), df).first()
    assert page.title == "Head"
    assert "More" in page.raw_text                     # summary text still in raw_text (taken earlier)
    assert "More" not in page.main_content             # … but removed before main_content
    assert page.main_content.startswith("1. x\nx\n2. y\ny\n1. x\nx\n\npara\n\npara")  # repeated li → first index; text doubled
    secs = [(s.section_type, s.section_name, s.content, s.selector) for s in page.interactive_sections]
    assert secs == [("accordion", "Sib", "panel text", None), ("details", "More", "hidden body\n\nhidden body", None),
                    ("tab", "Tab One", "tab body", "#t1")]


def test_content_area_title_before_text_after(spark, pages):
    html = "<html><body><h1>Page</h1><div id='x'><p>inside</p></div><p>outside</p></body></html>"
    df = pages([(1, "https://h.org/g/q", html)])
    page = G.generic_page(html_nodes(df, "generic"), df, content_area_selector="#x").first()
    assert page.title == "Page"
    assert page.raw_text == "inside"
