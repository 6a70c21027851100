from pagefold.operators.nodes import tokenize


def _tags(rows):
    return {r[0]: r for r in rows}


def test_generic_mode_does_not_close_p_implicitly():
    rows = tokenize("<p><b>A<br><p>B</p></article>", "generic")
    by_tag = [(r[6], r[2]) for r in rows if r[5] == "elem"]
    # the second p is nested inside b inside the first p
    assert by_tag == [("p", 0), ("b", 1), ("br", 2), ("p", 2)]


def test_detail_mode_closes_p_and_adds_wrappers():
    rows = tokenize("<p><b>A<br><p>B</p>", "detail")
    elems = [(r[6], rows[r[2]][6] if r[2] is not None else None) for r in rows if r[5] == "elem"]
    assert elems[0] == ("html", "[document]")
    assert ("body", "html") in elems
    ps = [e for e in elems if e[0] == "p"]
    assert ps == [("p", "body"), ("p", "body")]


def test_script_is_raw_text_and_hidden():
    rows = tokenize('<script>var t="</p>";</script><p>x &amp; y</p><!-- c -->', "generic")
    kinds = [(r[5], r[9]) for r in rows if r[5] != "elem" and r[5] != "root"]
    assert ("hidden", 'var t="</p>";') in kinds
    assert ("text", "x & y") in kinds
    assert ("comment", " c ") in kinds


def test_intervals_nest():
    rows = tokenize("<div><p>a</p><p>b</p></div>", "generic")
    div = rows[1]
    assert div[1] == len(rows) - 1
    for r in rows[2:]:
        assert div[0] < r[0] <= div[1]
