"""Column-level text helpers (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip()/re ``\s`` are Unicode-aware; Java needs (?U) for that.
_WS_EDGES = r"(?U)^\s+|\s+$"
_WS_RUN = r"(?U)\s+"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c) -> Column:
    """``str.strip()`` with Unicode whitespace."""
    return F.regexp_replace(col_(c), _WS_EDGES, "")


def collapse_ws(c) -> Column:
    """``re.sub(r'\\s+', ' ', s)``."""
    return F.regexp_replace(col_(c), _WS_RUN, " ")


# Phrases deleted by the detail-page text cleaner, in order.
JUNK_PHRASES = [
    "back to top",
    "skip to content",
    "skip to main content",
    "print this page",
    "share this page",
]


# finds what ``clean_text`` would change; most texts of a page (cells, items, lines) hold none of it
_UNCLEAN = r"(?U:^\s|\s$|\s\s|[^\S ])|(?i:" + "|".join(p.replace(" ", "\\ ") for p in JUNK_PHRASES) + ")"


def clean_text(c) -> Column:
    """Collapse whitespace, delete junk phrases (case-insensitive), strip.

    The phrase deletion runs after collapsing, so doubled spaces can remain
    where a phrase stood; NULL and '' give ''.
    """
    out = collapse_ws(col_(c))
    for phrase in JUNK_PHRASES:
        out = F.regexp_replace(out, "(?i)" + phrase.replace(" ", "\\ "), "")
    return F.coalesce(F.when(F.regexp_like(col_(c), F.lit(_UNCLEAN)), pystrip(out)).otherwise(col_(c)), F.lit(""))


def cut(c, n: int, suffix: str) -> Column:
    """First ``n`` characters plus ``suffix`` when longer than ``n``."""
    c = col_(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)
