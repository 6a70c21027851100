"""URL columns as Catalyst expressions.

Splitting follows the generic URI grammar the way Python's ``urlsplit``
applies it: an optional scheme (letter first), an optional ``//authority``,
the path up to ``?``/``#``, the query, the fragment.  ``parse_url`` is not
used because it returns NULL on spaces and drops ports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.functions.text import col_

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _clean(c) -> Column:
    """Drop tab/CR/LF anywhere and leading control/space characters, as urlsplit does."""
    return F.regexp_replace(F.regexp_replace(col_(c), "[\\t\\r\\n]", ""), "^[\\x00-\\x20]+", "")


def _part(c, idx: int) -> Column:
    return F.regexp_extract(_clean(c), "(?s)" + _SPLIT, idx)


def url_scheme(c) -> Column:
    return F.lower(_part(c, 1))


def url_netloc(c) -> Column:
    return _part(c, 2)


def url_path(c) -> Column:
    """Path including ``;params``."""
    return _part(c, 3)


def url_query(c) -> Column:
    return _part(c, 4)


def url_fragment(c) -> Column:
    return _part(c, 5)


def has_query(c) -> Column:
    return F.regexp_like(_clean(c), F.lit("(?s)^[^#]*\\?"))


def has_fragment(c) -> Column:
    return F.instr(_clean(c), "#") > 0


def url_path_noparams(c) -> Column:
    """``urlparse(...).path``: the path with ``;params`` of the last segment cut off."""
    return F.regexp_replace(url_path(c), ";[^/]*$", "")


def rstrip_slash(c) -> Column:
    return F.regexp_replace(col_(c), "/+$", "")


def url_slug(c) -> Column:
    """Path stripped of '/', non word/'-' chars → '_', runs squeezed, lower-cased, '_' stripped."""
    p = F.regexp_replace(url_path_noparams(c), "^/+|/+$", "")
    s = F.regexp_replace(p, "[^\\p{L}\\p{N}_\\-]", "_")
    s = F.regexp_replace(s, "_+", "_")
    return F.regexp_replace(F.lower(s), "^_+|_+$", "")


def url_filename(c) -> Column:
    """C14: scheme markers removed, '/', '?', '&' → '_', first 100 characters."""
    s = F.replace(F.replace(col_(c), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    s = F.translate(s, "/?&", "___")
    return F.substring(s, 1, 100)


def normalize_url(href, base) -> Column:
    """C4: absolute http(s) URLs stay; otherwise base without trailing '/' + '/' + href."""
    h, b = col_(href), col_(base)
    rel = F.when(h.startswith("/"), h).otherwise(F.concat(F.lit("/"), h))
    return F.when(h.startswith("http://") | h.startswith("https://"), h).otherwise(F.concat(rstrip_slash(b), rel))


def _remove_dots(segments: Column) -> Column:
    """Resolve '.' and '..' over an array of path segments (urljoin's loop)."""
    out = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    return F.when(last.isin(".", ".."), F.concat(out, F.array(F.lit("")))).otherwise(out)


def url_parts(c) -> Column:
    """All urlsplit parts of a URL column as one struct.

    ``scheme`` (lower-cased), ``netloc``, ``path`` (with params), ``query``,
    ``fragment`` and the presence flags ``has_q``/``has_f``.  Use it through
    :func:`with_url_parts` so that the parts are computed once per row and
    later expressions refer to struct fields, not to copies of the regexes.
    """
    return F.struct(
        url_scheme(c).alias("scheme"),
        url_netloc(c).alias("netloc"),
        url_path(c).alias("path"),
        url_query(c).alias("query"),
        url_fragment(c).alias("fragment"),
        has_query(c).alias("has_q"),
        has_fragment(c).alias("has_f"),
    )


def with_url_parts(df: DataFrame, url_col: str, name: str) -> DataFrame:
    """Add struct column ``name`` = :func:`url_parts` of ``url_col`` (cleaned once)."""
    tmp = f"{name}__clean"
    df = df.withColumn(tmp, _clean(url_col))
    c = F.col(tmp)
    parts = F.struct(
        F.lower(F.regexp_extract(c, "(?s)" + _SPLIT, 1)).alias("scheme"),
        F.regexp_extract(c, "(?s)" + _SPLIT, 2).alias("netloc"),
        F.regexp_extract(c, "(?s)" + _SPLIT, 3).alias("path"),
        F.regexp_extract(c, "(?s)" + _SPLIT, 4).alias("query"),
        F.regexp_extract(c, "(?s)" + _SPLIT, 5).alias("fragment"),
        F.regexp_like(c, F.lit("(?s)^[^#]*\\?")).alias("has_q"),
        (F.instr(c, "#") > 0).alias("has_f"),
    )
    return df.withColumn(name, parts).drop(tmp)


def _unsplit(scheme, netloc, path, query, q_present, frag, f_present) -> Column:
    p = F.when((netloc != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    core = F.concat(scheme, F.lit("://"), netloc, p)
    core = F.when(q_present & (query != ""), F.concat(core, F.lit("?"), query)).otherwise(core)
    return F.when(f_present & (frag != ""), F.concat(core, F.lit("#"), frag)).otherwise(core)


def _merged_path(h: Column, b: Column) -> Column:
    """Relative-path merge with the base directory, then dot-segment removal."""
    bp, hp = b["path"], h["path"]
    base_dir = F.split(bp, "/", -1)
    base_dir = F.when(F.element_at(base_dir, -1) != "", F.slice(base_dir, 1, F.size(base_dir) - 1)).otherwise(base_dir)
    rel = F.concat(base_dir, F.split(hp, "/", -1))
    rel = F.when(
        F.size(rel) > 2,
        F.concat(F.slice(rel, 1, 1), F.filter(F.slice(rel, 2, F.size(rel) - 2), lambda s: s != ""), F.slice(rel, -1, 1)),
    ).otherwise(rel)
    segments = F.when(hp.startswith("/"), F.split(hp, "/", -1)).otherwise(rel)
    merged = F.array_join(_remove_dots(segments), "/")
    return F.when(merged == "", F.lit("/")).otherwise(merged)


def _resolve_from_parts(href: Column, base: Column, h: Column, b: Column, merged: Column) -> Column:
    hs = F.when(h["scheme"] == "", b["scheme"]).otherwise(h["scheme"])
    q_given = h["has_q"] & (h["query"] != "")
    empty_path = _unsplit(hs, b["netloc"], b["path"], F.when(q_given, h["query"]).otherwise(b["query"]),
                          q_given | (b["query"] != ""), h["fragment"], h["has_f"])
    return (
        F.when(base.isNull() | (base == ""), href)
        .when(href.isNull(), None)
        .when(href == "", base)
        .when((hs != b["scheme"]) | ~b["scheme"].isin("http", "https"), href)
        .when(h["netloc"] != "", _unsplit(hs, h["netloc"], h["path"], h["query"], h["has_q"], h["fragment"], h["has_f"]))
        .when(h["path"] == "", empty_path)
        .otherwise(_unsplit(hs, b["netloc"], merged, h["query"], h["has_q"], h["fragment"], h["has_f"]))
    )


def with_resolved_url(df: DataFrame, href: str, base: str, out: str, keep_base_parts: str | None = None) -> DataFrame:
    """C5 as staged projections: ``out`` = ``urljoin(base, href)``.

    Parts are computed once (struct columns), the merged path once, then the
    final choice; Catalyst keeps these as separate projections because each
    non-trivial column is used several times, so the plan stays small.
    ``keep_base_parts`` keeps the base's part struct under that name.
    """
    df = with_url_parts(df, href, "__h")
    df = with_url_parts(df, base, "__b")
    df = df.withColumn("__m", _merged_path(F.col("__h"), F.col("__b")))
    df = df.withColumn(out, _resolve_from_parts(F.col(href), F.col(base), F.col("__h"), F.col("__b"), F.col("__m")))
    if keep_base_parts:
        df = df.withColumnRenamed("__b", keep_base_parts)
    return df.drop("__h", "__b", "__m")


def resolve_url(href, base) -> Column:
    """``urljoin(base, href)`` as one Column (for small projections).

    RFC 3986 reference resolution the way ``urljoin`` does it for http(s)
    bases: another scheme returns ``href`` unchanged, a network-path
    reference takes the base scheme, an empty path keeps the base path (and
    query when none is given), a relative path is merged with the base
    directory, dot segments are removed, the fragment is kept.  Inside
    larger plans prefer :func:`with_resolved_url`.
    """
    h, b = url_parts(href), url_parts(base)
    return _resolve_from_parts(col_(href), col_(base), h, b, _merged_path(h, b))


def parent_dir(path: Column) -> Column:
    """'/'.join(p.rstrip('/').split('/')[:-1]) — the page path minus its last segment."""
    p = rstrip_slash(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))


def follow_filter(link_url, page_url, mode: str) -> Column:
    """Should a resolved link be followed from ``page_url`` under ``mode``?

    ``same_path`` is a plain string prefix test on the page's parent path (no
    '/' boundary), or equality with the page path.
    """
    if mode == "all":
        return F.lit(True)
    ln, pn = url_netloc(link_url), url_netloc(page_url)
    if mode == "same_domain":
        return ln == pn
    if mode == "same_path":
        lp = rstrip_slash(url_path_noparams(link_url))
        pp = url_path_noparams(page_url)
        return (ln == pn) & (lp.startswith(parent_dir(pp)) | (lp == rstrip_slash(pp)))
    return F.lit(False)


def follow_from_parts(link: Column, page: Column, mode: str) -> Column:
    """C6 over part structs (see :func:`with_url_parts`)."""
    if mode == "all":
        return F.lit(True)
    if mode == "same_domain":
        return link["netloc"] == page["netloc"]
    if mode == "same_path":
        lp = rstrip_slash(F.regexp_replace(link["path"], ";[^/]*$", ""))
        pp = F.regexp_replace(page["path"], ";[^/]*$", "")
        return (link["netloc"] == page["netloc"]) & (lp.startswith(parent_dir(pp)) | (lp == rstrip_slash(pp)))
    return F.lit(False)


def in_scope(url, domain: str, prefix: str) -> Column:
    """Host equals ``domain`` and the path starts with ``prefix``."""
    return (url_netloc(url) == F.lit(domain)) & url_path_noparams(url).startswith(prefix)
