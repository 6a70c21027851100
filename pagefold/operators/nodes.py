"""B1 ``html_nodes``: one row per DOM node, the table every parse operator reads.

The tokenizer is the only Python step of the parse path.  It runs on the
executors inside ``mapInArrow`` (Arrow record batches built column-wise), using the standard
library's ``html.parser``.  Everything downstream — junk removal, titles,
text, sections, links — is expressed as DataFrame operations over this table.

Node table columns
------------------
page_id   long   page key
pre       int    document-order position (the root is 0)
last      int    ``pre`` of the last descendant (``pre`` itself for leaves)
parent    int    ``pre`` of the parent (NULL for the root)
depth     int    number of ancestors
sib       int    1-based position among the parent's element children (elements only)
kind      string root | elem | text | hidden | comment | doctype
tag       string lower-case tag name for elements, NULL otherwise
attrs     map<string,string>  attributes (first value wins on repeats)
classes   array<string>       class tokens
text      string text of text/hidden/comment/doctype nodes
ctx       int    nearest ancestor that gives a link its context (p, li, td, div), NULL if none
ol        int    nearest ``ol`` ancestor, NULL if none

``x`` lies inside element ``a`` iff ``a.pre < x.pre <= a.last``.  No node lists its ancestors: the table
is linear in the page, however deep it is nested (``dom.gather`` joins by intervals).

Two tree-building modes:

* ``generic`` — an end tag closes the most recent open element of the same
  name (everything opened after it closes too); an end tag with no open match
  is ignored; nothing is closed implicitly except void elements.
* ``detail`` — additionally closes elements implicitly the way common
  libxml2-style HTML parsers do (a new block closes an open ``p``, ``li``
  closes ``li``, cells close cells, …), inserts an empty ``p`` for a stray
  ``</p>`` and supplies missing ``html``/``body`` wrappers.

Text kinds: ``text`` is what ``get_text`` returns; ``hidden`` is character
data inside script/style/template/rt/rp (a string, but not part of
``get_text``); ``comment`` and ``doctype`` are strings too.
"""

from __future__ import annotations

import gc
import re
import sys

from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefold.session import register_by_value as _register_by_value

# The functions below run inside Python workers: ship this module with them
# (pickled by value), so executors need no installed copy of the package.
_register_by_value(sys.modules[__name__])

NODE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("pre", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("sib", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("ctx", T.IntegerType()),
        T.StructField("ol", T.IntegerType()),
    ]
)

# Fixed value: tags whose text is the context of a link in them.
CONTEXT_TAGS = ("p", "li", "td", "div")

# A page that the tokenizer can't read has one row of this kind, with the error as its text: no
# root, elements or strings, so no operator takes it for content (see ``parse_errors``).
ERROR_KIND = "error"

# HTML void elements, and elements whose character data is not
# returned by get_text.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link meta param source track wbr basefont bgsound frame spacer".split()
)
HIDDEN_CONTAINERS = frozenset(["script", "style", "template", "rt", "rp"])

# Implicit-close rules for ``detail`` mode: new tag -> open tags it closes when
# they are the current node (applied repeatedly).
_FONTSTYLE = ["tt", "i", "b", "u", "s", "strike", "big", "small"]
_HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
_BLOCK_CLOSES_P = [
    "address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl", "fieldset",
    "figcaption", "figure", "footer", "form", "header", "hr", "main", "menu", "nav", "ol", "pre",
    "section", "table", "ul", "listing", "xmp",
]
_DETAIL_CLOSES: dict[str, set[str]] = {t: {"p"} for t in _BLOCK_CLOSES_P}
_DETAIL_CLOSES["p"] = {"p", *_FONTSTYLE, *_HEADINGS}
for _h in _HEADINGS:
    _DETAIL_CLOSES[_h] = {"p", *_HEADINGS}
_DETAIL_CLOSES["li"] = {"p", "li"}
_DETAIL_CLOSES["dt"] = {"p", "dt", "dd"}
_DETAIL_CLOSES["dd"] = {"p", "dt", "dd"}
_DETAIL_CLOSES["tr"] = {"tr", "td", "th", "p"}
_DETAIL_CLOSES["td"] = {"td", "th", "p"}
_DETAIL_CLOSES["th"] = {"td", "th", "p"}
_DETAIL_CLOSES["thead"] = {"tbody", "tfoot", "tr", "td", "th"}
_DETAIL_CLOSES["tbody"] = {"thead", "tbody", "tfoot", "tr", "td", "th"}
_DETAIL_CLOSES["tfoot"] = {"thead", "tbody", "tr", "td", "th"}
_DETAIL_CLOSES["option"] = {"option"}
_DETAIL_CLOSES["body"] = {"head", "title", "meta", "link", "style", "script"}
_HEAD_TAGS = frozenset(["title", "meta", "link", "style", "script", "base", "noscript"])

# What ``quick`` reads itself: text, a start tag whose attributes are lower-case names with quoted values that hold no
# reference, an end tag, the doctype.  Any other markup leaves the page to html.parser.
_PLAIN = re.compile(r'([^<]+)|<(?:([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"<>&]*")*)>|/([a-z][a-z0-9]*)>|(!DOCTYPE html)>)')
_PLAIN_ATTR = re.compile(r' ([a-z-]+)="([^"]*)"')
_NO_ATTRS, _NO_CLASSES = {}, []
# elements whose content html.parser (of one release or another) reads as raw text
_RAW_TEXT = frozenset("script style textarea xmp iframe noembed noframes noscript plaintext title".split())
_PLAIN_TITLE = re.compile("[^<]*</title>")


class _TreeTokenizer(HTMLParser):
    """Builds the node rows of one page."""

    def __init__(self, mode: str):
        super().__init__(convert_charrefs=True)
        self.mode = mode
        self.rows: list[list] = []
        # root node
        self.rows.append([0, 0, None, 0, None, "root", "[document]", None, None, None, None, None])
        self.stack: list[int] = [0]  # row indexes of open nodes
        self.open: list[str] = ["[document]"]  # their tags
        self.inner: list[tuple[int | None, int | None]] = [(None, None)]  # ctx and ol of their children
        self.n_open: dict[str, int] = {}  # open elements by tag
        self.child_count: dict[int, int] = {0: 0}
        self.buf: list[str] = []
        self.hidden_depth = 0

    # -- helpers -------------------------------------------------------
    def _add(self, kind, tag=None, attrs=None, classes=None, text=None) -> int:
        parent = self.stack[-1]  # a row's index is its pre
        pre = len(self.rows)
        sib = None
        if kind == "elem":
            sib = self.child_count[parent] = self.child_count[parent] + 1
        ctx, ol = self.inner[-1]
        self.rows.append([pre, pre, parent, len(self.stack), sib, kind, tag, attrs, classes, text, ctx, ol])
        return pre

    def _flush(self):
        if self.buf:
            data = "".join(self.buf)
            self.buf = []
            kind = "hidden" if self.hidden_depth > 0 else "text"
            self._add(kind, text=data)

    def _close_top(self):
        idx = self.stack.pop()
        self.inner.pop()
        self.n_open[self.open.pop()] -= 1
        self.rows[idx][1] = len(self.rows) - 1
        if self.rows[idx][6] in HIDDEN_CONTAINERS:
            self.hidden_depth -= 1

    def _push(self, tag, attrs):
        amap: dict[str, str] = {}
        for k, v in attrs:
            if k not in amap:
                amap[k] = "" if v is None else v
        classes = amap.get("class", "").split() if "class" in amap else []
        pre = self._add("elem", tag=tag, attrs=amap, classes=classes)
        ctx, ol = self.inner[-1]
        self.inner.append((pre if tag in CONTEXT_TAGS else ctx, pre if tag == "ol" else ol))
        self.stack.append(pre)
        self.open.append(tag)
        self.n_open[tag] = self.n_open.get(tag, 0) + 1
        self.child_count[pre] = 0
        if tag in HIDDEN_CONTAINERS:
            self.hidden_depth += 1
        return pre

    # -- detail-mode structure ----------------------------------------
    def _detail_before_start(self, tag):
        if tag != "html" and not self.n_open.get("html"):
            self._push("html", [])
        if tag not in ("html", "head", "body") and tag not in _HEAD_TAGS and not self.n_open.get("body"):
            if self.n_open.get("head"):
                while self.open[-1] != "head":
                    self._close_top()
                self._close_top()
            self._push("body", [])
        closes = _DETAIL_CLOSES.get(tag)
        if closes:
            while len(self.stack) > 1 and self.rows[self.stack[-1]][6] in closes:
                self._close_top()

    # -- HTMLParser callbacks ------------------------------------------
    def handle_starttag(self, tag, attrs):
        self._flush()
        if self.mode == "detail":
            if tag in ("html", "body", "head") and self.n_open.get(tag):
                return
            self._detail_before_start(tag)
        self._push(tag, attrs)
        if tag in VOID_TAGS:
            self._close_top()

    def handle_startendtag(self, tag, attrs):
        self._flush()
        if self.mode == "detail":
            self._detail_before_start(tag)
        self._push(tag, attrs)
        self._close_top()

    def handle_endtag(self, tag):
        self._flush()
        for pos in range(len(self.open) - 1, 0, -1) if self.n_open.get(tag) else ():
            if self.open[pos] == tag:
                if self.mode == "detail" and tag in ("html", "body"):
                    return  # closed at end of document
                while len(self.stack) > pos:
                    self._close_top()
                return
        if self.mode == "detail" and tag == "p":
            self._detail_before_start("p")
            self._push("p", [])
            self._close_top()

    def handle_data(self, data):
        self.buf.append(data)

    def handle_comment(self, data):
        self._flush()
        self._add("comment", text=data)

    def handle_decl(self, decl):
        self._flush()
        text = decl[len("DOCTYPE "):] if decl.upper().startswith("DOCTYPE ") else decl
        self._add("doctype", text=text)

    def unknown_decl(self, data):
        self._flush()
        if data.startswith("CDATA["):
            self._add("text", text=data[len("CDATA["):])

    def handle_pi(self, data):
        self._flush()
        self._add("comment", text=data)

    def quick(self, html: str) -> bool:
        """Read a page of plain markup without html.parser, as the handlers do; False (and nothing of use in
        ``rows``) when any of it is not plain."""
        rows, stack, names, inner, n_open, count = self.rows, self.stack, self.open, self.inner, self.n_open, self.child_count
        detail = self.mode == "detail"
        at = 0
        for m in _PLAIN.finditer(html):
            if m.start() != at:
                return False
            at, what = m.end(), m.lastindex
            if what == 1:
                text, pre = m[1], len(rows)
                ctx, ol = inner[-1]
                rows.append([pre, pre, stack[-1], len(stack), None, "hidden" if self.hidden_depth > 0 else "text", None, None, None,
                             unescape(text) if "&" in text else text, ctx, ol])
            elif what == 3:
                tag = m[2]
                if tag in _RAW_TEXT and not (tag == "title" and _PLAIN_TITLE.match(html, at)):
                    return False
                if m[3] or tag in VOID_TAGS or tag in HIDDEN_CONTAINERS:
                    self.handle_starttag(tag, _PLAIN_ATTR.findall(m[3]))
                    continue
                if detail:
                    if tag in ("html", "body", "head") and n_open.get(tag):
                        continue
                    self._detail_before_start(tag)
                pre, parent = len(rows), stack[-1]
                ctx, ol = inner[-1]
                sib = count[parent] = count[parent] + 1
                rows.append([pre, pre, parent, len(stack), sib, "elem", tag, _NO_ATTRS, _NO_CLASSES, None, ctx, ol])
                inner.append((pre if tag in CONTEXT_TAGS else ctx, pre if tag == "ol" else ol))
                stack.append(pre)
                names.append(tag)
                n_open[tag] = n_open.get(tag, 0) + 1
                count[pre] = 0
            elif what == 4:
                tag = m[4]
                if names[-1] != tag or tag in HIDDEN_CONTAINERS or tag in ("html", "body"):
                    self.handle_endtag(tag)
                    continue
                rows[stack.pop()][1] = len(rows) - 1
                inner.pop()
                names.pop()
                n_open[tag] -= 1
            else:
                self.handle_decl(m[5][1:])
        return at == len(html)

    def finish(self):
        self.close()
        self._flush()
        while len(self.stack) > 1:
            self._close_top()
        self.rows[0][1] = len(self.rows) - 1
        return self.rows


def tokenize(html: str | None, mode: str = "generic") -> list[list]:
    """Rows ``[pre, last, parent, depth, sib, kind, tag, attrs, classes, text, ctx, ol]``."""
    tok = _TreeTokenizer(mode)
    if html and not tok.quick(html):
        tok = _TreeTokenizer(mode)
        tok.feed(html)
    return tok.finish()


def strip_rows(rows: list[list], junk: dict) -> list[list]:
    """``dom.drop_subtrees`` on the rows of a page ordered by ``pre``, for the elements that ``junk`` (``operators.junk``)
    describes: a running maximum of ``last``."""
    tags, classes, attributes = junk["tags"], junk["classes"], junk["attrs"].items()
    gone, out = -1, []
    for r in rows:
        if r[1] > gone and r[5] == "elem" and (r[6] in tags or (r[7] and (
                not classes.isdisjoint(r[8]) or any(r[7].get(k) in values for k, values in attributes)))):
            gone = r[1]
        if r[0] > gone:
            out.append(r)
    return out


_COLS = [f.name for f in NODE_SCHEMA.fields]
# rows, and characters in them, that a worker holds before it hands on a batch, also within a page
_FLUSH_ROWS = 20_000
_FLUSH_CHARS = 8_000_000
# tasks for each split of an input table (a split is at most spark.sql.files.maxPartitionBytes)
TASKS_A_SPLIT = 4


def _arrow_schema():
    import pyarrow as pa

    return pa.schema([
        ("page_id", pa.int64()), ("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()),
        ("depth", pa.int32()), ("sib", pa.int32()), ("kind", pa.string()), ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())), ("classes", pa.list_(pa.string())), ("text", pa.string()),
        ("ctx", pa.int32()), ("ol", pa.int32()),
    ])


class _Rows:
    """Node rows on their way into Arrow batches."""

    def __init__(self):
        self.pages, self.rows = [], []
        self.chars = 0

    def clear(self):
        self.pages, self.rows = [], []
        self.chars = 0

    def add_page(self, page_id, rows):
        """Yields whenever a batch is full."""
        chars = sum(len(r[9]) if r[9] is not None else sum(map(len, r[7].values())) if r[7] else 0 for r in rows)
        if len(self.rows) + len(rows) < _FLUSH_ROWS and self.chars + chars < _FLUSH_CHARS:
            self.rows += rows
            self.pages += [page_id] * len(rows)
            self.chars += chars
            return
        for r in rows:
            self.rows.append(r)
            self.pages.append(page_id)
            self.chars += len(r[9]) if r[9] is not None else sum(map(len, r[7].values())) if r[7] else 0
            if len(self.rows) >= _FLUSH_ROWS or self.chars >= _FLUSH_CHARS:
                yield

    def batch(self, schema):
        import pyarrow as pa

        pre, last, parent, depth, sib, kind, tag, attrs, classes, text, ctx, ol = zip(*self.rows)
        starts, keys, values = [], [], []  # a NULL start makes a NULL map
        for a in attrs:
            starts.append(None if a is None else len(keys))
            if a:
                keys += a.keys()
                values += a.values()
        starts.append(len(keys))
        maps = pa.MapArray.from_arrays(pa.array(starts, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
        columns = (self.pages, pre, last, parent, depth, sib, kind, tag, maps, classes, text, ctx, ol)
        arrays = [c if c is maps else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _nodes_fn(mode: str, junk: dict | None = None):
    def parsed(batches):
        """Rows page by page; pages of one id that follow each other count as one, its rows by ``pre``."""
        held, of_id = None, []
        for rb in batches:
            # a page at a time: a batch may hold 10,000 pages
            for pid, html in zip(rb.column("page_id"), rb.column("html")):
                pid, html = pid.as_py(), html.as_py()
                try:
                    page = tokenize(html, mode)
                except Exception as e:  # noqa: BLE001 — a malformed page fails alone
                    page = [[0, 0, None, 0, None, ERROR_KIND, None, None, None, repr(e)[:500], None, None]]
                if of_id and pid != held:
                    yield held, merged(of_id)
                    of_id = []
                held = pid
                of_id.append(page)
        if of_id:
            yield held, merged(of_id)

    def merged(of_id):
        return of_id[0] if len(of_id) == 1 else sorted((r for page in of_id for r in page), key=lambda r: r[0])

    def run(batches):
        schema = _arrow_schema()
        acc = _Rows()
        collecting = gc.isenabled()
        gc.disable()  # rows hold no cycles; looking for some takes a fifth of the parse
        try:
            for pid, rows in parsed(batches):
                for _ in acc.add_page(pid, strip_rows(rows, junk) if junk else rows):
                    yield acc.batch(schema)
                    acc.clear()
            if acc.rows:
                yield acc.batch(schema)
        finally:
            if collecting:
                gc.enable()

    return run


def html_nodes(pages: DataFrame, mode: str = "generic", junk: dict | None = None) -> DataFrame:
    """B1: parse ``pages(page_id, html)`` into the node table.

    Only ``page_id`` and ``html`` reach the Python worker (column pruning).
    Many operators read the result, so plans stage it once as a table
    bucketed by ``page_id`` (``pagefold.plans.stage``); every later window
    and aggregate keyed by ``page_id`` then runs without another exchange.

    Rows come in the order of the pages, those of a page by ``pre``.  With ``junk`` (``junk.GENERIC`` or
    ``junk.DETAIL``) B2 or B3 is done on each page's rows as it is parsed: where all pages of an id follow each other,
    as in a staged parse, the result is ``strip_junk_generic`` or ``strip_junk_detail`` of the node table.
    """
    if mode not in ("generic", "detail"):
        raise ValueError("mode must be 'generic' or 'detail'")
    src = spread(pages.select("page_id", "html"))
    return src.mapInArrow(_nodes_fn(mode, junk), NODE_SCHEMA)


def parsed_pages(nodes: DataFrame) -> DataFrame:
    """``page_id`` of the pages that were parsed."""
    return nodes.filter("kind = 'root'").select("page_id")


def parse_errors(nodes: DataFrame) -> DataFrame:
    """``(page_id, _error)`` of the pages that could not be parsed."""
    return nodes.filter(f"kind = '{ERROR_KIND}'").select("page_id", nodes["text"].alias("_error"))


def spread(df: DataFrame) -> DataFrame:
    """Give a Python-heavy step at least one input partition per core.

    A few large input files (or one) would otherwise put the whole parse
    into a few tasks.  Large inputs already have many splits and are left
    alone, so no shuffle of raw HTML is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # the plan knows the partitions after an exchange; df.rdd would run the exchange to count them
    known = df._jdf.queryExecution().sparkPlan().outputPartitioning().numPartitions()
    if (known or df.rdd.getNumPartitions()) < cores:
        return df.repartition(cores * 2)
    return df


def by_page(pages: DataFrame, n: int) -> DataFrame:
    """``pages(page_id, html)`` in ``n`` partitions by ``page_id``, ordered by it: parsed, they are the buckets of
    a staged node table.  Pages are exchanged, which are a fraction of their node rows."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "html")  # as in the node table: the type is part of the hash
    return pages.repartition(n, "page_id").sortWithinPartitions("page_id")


def deal(df: DataFrame) -> DataFrame:
    """Deal the rows of an input table over many even tasks before a Python-heavy step.

    The splits of a file say little of its rows: a Parquet row group is read by one task, so of the many splits
    of a file with few row groups most are empty and a few tasks parse everything.  The rows are few
    against the node rows made of them, so one exchange of them costs little.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores * 2, df.rdd.getNumPartitions() * TASKS_A_SPLIT))
