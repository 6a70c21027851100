from pyspark.sql import functions as F

from pagefold.operators import nodes as N
from pagefold.operators.junk import strip_junk_detail, strip_junk_generic
from pagefold.session import scratch_path

PAGES = [
    (1, "<main><p>a &amp; b</p><nav><ul><li>x</li></ul></nav><div role='navigation'>n</div></main>"),
    (2, "<div class=ad><p>no</p></div><p>yes<script>var a='</p>'</script><aside>s</aside>"),
    (2, "<div class=ad><p>no</p></div><p>yes<script>var a='</p>'</script><aside>s</aside>"),  # a repeated row
    (3, ""), (4, None), (None, "<footer>f</footer>x"),
    (5, '<!DOCTYPE html><title>t &lt; u</title><a href="/x?a=1" id="skip-link">l</a><table><tr><td>c<td>d</table>'),
]


def test_pages_parsed_into_buckets_are_the_stripped_node_table(spark):
    from pagefold.plans.stage import parse_table

    df = spark.createDataFrame(PAGES, "page_id long, html string").repartition(3)
    show = lambda t: sorted(str(tuple(r)) for r in t.select(*[c for c in t.columns if c != "attrs"], F.to_json("attrs")).collect())
    for mode, junk, strip in (("generic", "generic", strip_junk_generic), ("detail", "detail", strip_junk_detail), ("detail", None, lambda x: x)):
        staged = spark.table(parse_table(df, mode, "t-" + mode, junk))
        assert show(staged) == show(strip(N.html_nodes(df, mode)))
        plan = staged.groupBy("page_id").agg(F.collect_list("pre"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort " not in plan  # buckets are read as they lie
        assert [r.pre for r in staged.filter("page_id = 2").collect()] == sorted(r.pre for r in staged.filter("page_id = 2").collect())


def test_a_stripped_tree_is_staged_without_the_tree_it_comes_from(spark):
    from pagefold.plans import stage, synth

    folder = scratch_path(spark, "docs")
    docs = [(i, f"line {i}\nmore words", "en", "web", 1) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(folder + "/documents.parquet")
    before = set(stage._STAGED)
    nodes = stage.derived_nodes(spark, folder, "documents", synth.blocks_pages_generic, "generic", junk="generic")
    assert nodes.filter("kind = 'root'").count() == 40
    assert [k[-1] for k in set(stage._STAGED) - before] == ["generic"]


def test_plain_markup_is_read_as_html_parser_reads_it():
    def slow(html, mode):
        tok = N._TreeTokenizer(mode)
        tok.feed(html)
        return tok.finish()

    parts = ["<p>", "</p>", "<li>", "</li>", "<ol>", "</ol>", "<b>", "</html>", "<body>", '<a href="/a" id="x" id="y">', "<br>", "x &amp; y", "&#1;",
             "<title>", "</title>", "<script>", "</script>", "<rt>", "</rt>", "<!-- c -->", "<P>", "< ", "<i/>", "t &lt", "<!DOCTYPE html>", "<td>", "</table>"]
    quick = 0
    for k in range(4000):
        html = "".join(parts[(k * 7919 + j * j * 104729 + k * j) % len(parts)] for j in range(k % 12))
        for mode in ("generic", "detail"):
            assert N.tokenize(html, mode) == slow(html, mode), html
            quick += N._TreeTokenizer(mode).quick(html)
    assert quick > 100


def test_clean_text_leaves_only_clean_texts_alone(spark):
    from pagefold.functions.text import JUNK_PHRASES, clean_text, collapse_ws, pystrip

    texts = ["a b", " a", "a ", "a  b", "a\tb", "a\u00a0b", "x Back To Top y", "back to  top", "skipskip to content to content", "a\n", "", None, "\u2003", "Print This Page"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = collapse_ws("t")
    for phrase in JUNK_PHRASES:
        out = F.regexp_replace(out, "(?i)" + phrase, "")
    rows = df.select(clean_text("t").alias("a"), F.coalesce(pystrip(out), F.lit("")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_exists_by_slug_makes_its_records_once(spark, monkeypatch):
    from pagefold.plans import serve_queries as S

    folder = scratch_path(spark, "slugs")
    docs = [(i, f"a line of document {i}" if i else "", "en", "web", 1) for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([(1, 3, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    made, plain = [], S._records
    monkeypatch.setattr(S, "_records", lambda *a: made.append(a) or plain(*a))
    rows = {r.page_id: (r.in_parsed, r.in_enriched) for r in S.q_exists_by_slug(spark, folder).collect()}
    assert rows == {i: (i > 0, i in (1, 5)) for i in range(6)}
    assert len(made) == 1
