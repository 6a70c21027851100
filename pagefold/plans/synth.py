"""Page tables built from the given tables by formula, for structures the
``pages`` table lacks (headings, lists, tables, tabs, listings …).

Each builder is a pure DataFrame transformation of a source table, so its
size grows with that table, and the oracle SQL can compute the expected
result straight from the source columns without parsing HTML.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYNTH_HOST = "https://docs.example.org"


def esc(c: Column) -> Column:
    """Escape &, <, > for element content."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def words5(line: Column) -> Column:
    """First five space-separated words of the whitespace-collapsed, trimmed line."""
    norm = F.regexp_replace(F.regexp_replace(line, r"\s+", " "), r"^ +| +$", "")
    return F.slice(F.split(norm, " ", -1), 1, 5)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _page(doc_id: Column, path: str, body: Column) -> list[Column]:
    return [
        doc_id.alias("page_id"),
        F.concat(F.lit(SYNTH_HOST + path), doc_id.cast("string")).alias("url"),
        F.concat(F.lit("<!DOCTYPE html><html><head><title>doc</title></head><body>"), body, F.lit("</body></html>")).alias("html"),
    ]


def section_pages(documents: DataFrame, variant: str = "primary") -> DataFrame:
    """Detail pages: h1 = source; per line i (1-based) ``<h2>S{i}</h2><p>{line}</p>``.

    ``fallback`` wraps the sections in one div (no direct-child headings);
    ``blocks`` adds ul/ol/table blocks of the line's first five words.
    """
    def sec(x, i):
        base = F.concat(F.lit("<h2>S"), (i + 1).cast("string"), F.lit("</h2><p>"), esc(x), F.lit("</p>"))
        if variant != "blocks":
            return base
        w = words5(x)
        li = F.array_join(F.transform(w, lambda y: F.concat(F.lit("<li>"), esc(y), F.lit("</li>"))), "")
        td = F.array_join(F.transform(w, lambda y: F.concat(F.lit("<td>"), esc(y), F.lit("</td>"))), "")
        return F.concat(base, F.lit("<ul>"), li, F.lit("</ul><ol>"), li, F.lit("</ol><table><tr>"), td,
                        F.lit("</tr><tr><td></td></tr></table>"))

    secs = F.array_join(F.transform(_lines(F.col("text")), sec), "")
    if variant == "fallback":
        secs = F.concat(F.lit("<div>"), secs, F.lit("</div>"))
    body = F.concat(F.lit("<main><h1>"), esc(F.col("source")), F.lit("</h1>"), secs, F.lit("</main>"))
    return documents.select(*_page(F.col("doc_id"), f"/{variant}/", body))


def listing_pages(documents: DataFrame) -> DataFrame:
    """Listing pages: a link before any heading, then per line i a heading
    (the line's first word, possibly empty) and a list item linking to
    ``/d/{doc_id}/{i}?x=1#f`` (the first one twice); then an empty anchor."""
    def item(x, i):
        k = (i + 1).cast("string")
        href = F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.lit("/"), k, F.lit("?x=1#f"))
        link = F.concat(F.lit("<a href=\""), href, F.lit("\">L"), k, F.lit("</a>"))
        twice = F.when(i == 0, F.concat(link, link)).otherwise(link)
        return F.concat(F.lit("<h3>"), esc(F.element_at(words5(x), 1)), F.lit("</h3><ul><li>"), twice, F.lit("</li></ul>"))

    did = F.col("doc_id").cast("string")
    body = F.concat(
        F.lit("<main><p><a href=\"/d/"), did, F.lit("/0\">before</a></p>"),
        F.array_join(F.transform(_lines(F.col("text")), item), ""),
        F.lit("<p><a href=\"/d/"), did, F.lit("/9\"> </a></p></main>"),
    )
    return documents.select(*_page(F.col("doc_id"), "/list/", body))


def detail_targets(documents: DataFrame) -> DataFrame:
    """Detail pages reachable from the listings: ``/d/{doc_id}/1`` holds the doc's sections."""
    pages = section_pages(documents, "primary")
    return pages.select(
        (F.col("page_id") * 2 + 1).alias("page_id"),
        F.concat(F.lit(SYNTH_HOST + "/d/"), F.col("page_id").cast("string"), F.lit("/1")).alias("url"),
        "html",
    )


def section_pages_primary(documents: DataFrame) -> DataFrame:
    return section_pages(documents, "primary")


def section_pages_fallback(documents: DataFrame) -> DataFrame:
    return section_pages(documents, "fallback")


def section_pages_blocks(documents: DataFrame) -> DataFrame:
    return section_pages(documents, "blocks")


def conversation_pages(conversations: DataFrame) -> DataFrame:
    """One page per conversation turn (page_id = conv_id * 1,000,000 + turn): an accordion
    button (panel by ``aria-controls``; the panel is left out when turn % 3 == 2, and the
    button has no ``aria-controls`` — panel = next sibling — when turn % 5 == 4), a
    ``details`` with the role as summary, and a tab button + ``tabpanel``; the turn text
    sits in a ``<p>`` inside every panel.  Built row by row: no grouping."""
    c, t = F.col("conv_id").cast("string"), F.col("turn")
    ts = t.cast("string")
    para = F.concat(F.lit("<p>"), esc(F.col("text")), F.lit("</p>"))
    pid = F.concat(F.lit("p"), c, F.lit("-"), ts)
    tid = F.concat(F.lit("t"), c, F.lit("-"), ts)
    acc = (
        F.when(t % 5 == 4, F.concat(F.lit("<button aria-expanded=\"false\">Q"), ts, F.lit("</button><div>"), para, F.lit("</div>")))
        .otherwise(F.concat(
            F.lit("<button aria-expanded=\"false\" aria-controls=\""), pid, F.lit("\">Q"), ts, F.lit("</button>"),
            F.when(t % 3 == 2, F.lit("")).otherwise(F.concat(F.lit("<div id=\""), pid, F.lit("\">"), para, F.lit("</div>")))))
    )
    det = F.concat(F.lit("<details><summary>"), esc(F.col("role")), F.lit("</summary>"), para, F.lit("</details>"))
    tab = F.concat(F.lit("<button aria-controls=\""), tid, F.lit("\">Tab "), ts, F.lit("</button><div role=\"tabpanel\" id=\""),
                   tid, F.lit("\">"), para, F.lit("</div>"))
    page_id = F.col("conv_id") * 1_000_000 + F.col("turn")
    return conversations.select(*_page(page_id, "/conv/", F.concat(F.lit("<main>"), acc, det, tab, F.lit("</main>"))))


def blocks_pages_generic(documents: DataFrame) -> DataFrame:
    return section_pages(documents, "blocks")


def link_pages(documents: DataFrame) -> DataFrame:
    """Link-classification pages: a tiles container whose two tiles link to the same URL, then per
    line i (1-based) a paragraph with the line and one link; hrefs cycle by i % 6 through '#',
    '#x{i}', 'mailto:a@b', 'javascript:void(0)', '/links/topic/{i}', '/links/p/{i}', classes by
    i % 4 through none, 'tile', 'table', 'btn'."""
    did = F.col("doc_id").cast("string")

    def item(x, i):
        k = i + 1
        ks = k.cast("string")
        href = F.element_at(F.array(
            F.lit("#"), F.concat(F.lit("#x"), ks), F.lit("mailto:a@b"), F.lit("javascript:void(0)"),
            F.concat(F.lit("/links/topic/"), ks), F.concat(F.lit("/links/p/"), ks)), (k % 6 + 1).cast("int"))
        cls = F.element_at(F.array(F.lit(""), F.lit(" class=\"tile\""), F.lit(" class=\"table\""), F.lit(" class=\"btn\"")),
                           (k % 4 + 1).cast("int"))
        return F.concat(F.lit("<p>"), esc(x), F.lit("<a href=\""), href, F.lit("\""), cls, F.lit(">L"), ks, F.lit("</a></p>"))

    tiles = F.concat(F.lit("<div class=\"tiles-container\"><div class=\"tile\"><a href=\"/links/t"), did,
                     F.lit("\">T</a></div><div class=\"tile\"><a href=\"/links/t"), did, F.lit("\">T2</a></div></div>"))
    body = F.concat(F.lit("<main>"), tiles, F.array_join(F.transform(_lines(F.col("text")), item), ""), F.lit("</main>"))
    return documents.select(*_page(F.col("doc_id"), "/links/", body))
