from pyspark.sql import functions as F

from pagefold.functions.text import clean_text
from pagefold.operators.junk import strip_junk_generic
from pagefold.operators.nodes import html_nodes
from pagefold.operators.text import plain_text, region, title_generic


def _summary(spark, pages_df):
    nodes = html_nodes(pages_df, "generic")
    kept = strip_junk_generic(nodes)
    t = title_generic(pages_df, kept)
    r = plain_text(kept, region(kept))
    return {x.page_id: (x.title, x.raw_text) for x in t.join(r, "page_id").collect()}


def test_title_and_plain_text_quirks(spark, pages):
    df = pages([
        (1, "https://a/x", "<html><head><title>T</title></head><body><nav><h1>Nav</h1></nav>"
                           "<h1> Settle in <b> Australia </b></h1><main>a <i>b</i> word <!-- note here --></main></body></html>"),
        (2, "https://a/y", "<html><head><title> Only title </title></head><body><h1> </h1><p>x</p></body></html>"),
        (3, "https://a/z", "<html><body><p>no heading</p></body></html>"),
    ])
    got = _summary(spark, df)
    assert got[1][0] == "Settle inAustralia"          # strings stripped, joined without a separator
    assert got[1][1] == "word note here"              # single characters lost, comment text kept
    assert got[2][0] == ""                            # an empty h1 still wins over <title>
    assert got[3][0] == "Untitled"


def test_clean_text_deletes_phrases_after_collapsing(spark):
    df = spark.createDataFrame([("a  Back to TOP b\n\tc",), ("",)], "t string")
    got = [r.c for r in df.select(clean_text("t").alias("c")).collect()]
    assert got == ["a  b c", ""]
