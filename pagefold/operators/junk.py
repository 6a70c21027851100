"""Junk-subtree removal for the two parser flavours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.operators.dom import attr, drop_subtrees, has_class

# What each parser flavour deletes before reading text.
GENERIC_JUNK_TAGS = ["script", "style", "nav", "header", "footer"]
GENERIC_JUNK_CLASSES = ["breadcrumb", "pagination", "cookie-notice", "ad", "advertisement"]
GENERIC_JUNK_IDS = ["cookie-banner"]
GENERIC_JUNK_ROLES = ["banner", "navigation", "complementary"]

DETAIL_JUNK_TAGS = ["nav", "header", "footer", "aside"]
DETAIL_JUNK_CLASSES = ["breadcrumb", "breadcrumbs", "navigation", "nav", "cookie-banner", "cookie-consent",
                       "back-to-top", "skip-link"]
DETAIL_JUNK_IDS = ["skip-link"]
DETAIL_JUNK_ROLES = ["navigation"]
DETAIL_JUNK_ARIA_LABELS = ["breadcrumb"]

# the same for ``nodes.html_nodes``, which strips pages as it parses them
GENERIC = {"tags": frozenset(GENERIC_JUNK_TAGS), "classes": frozenset(GENERIC_JUNK_CLASSES),
           "attrs": {"id": frozenset(GENERIC_JUNK_IDS), "role": frozenset(GENERIC_JUNK_ROLES)}}
DETAIL = {"tags": frozenset(DETAIL_JUNK_TAGS), "classes": frozenset(DETAIL_JUNK_CLASSES),
          "attrs": {"id": frozenset(DETAIL_JUNK_IDS), "role": frozenset(DETAIL_JUNK_ROLES), "aria-label": frozenset(DETAIL_JUNK_ARIA_LABELS)}}


def _any_class(names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | has_class(n)
    return out


def generic_junk_pred() -> Column:
    return (
        F.col("tag").isin(*GENERIC_JUNK_TAGS)
        | _any_class(GENERIC_JUNK_CLASSES)
        | F.coalesce(attr("id").isin(*GENERIC_JUNK_IDS), F.lit(False))
        | F.coalesce(attr("role").isin(*GENERIC_JUNK_ROLES), F.lit(False))
    )


def detail_junk_pred() -> Column:
    return (
        F.col("tag").isin(*DETAIL_JUNK_TAGS)
        | _any_class(DETAIL_JUNK_CLASSES)
        | F.coalesce(attr("id").isin(*DETAIL_JUNK_IDS), F.lit(False))
        | F.coalesce(attr("role").isin(*DETAIL_JUNK_ROLES), F.lit(False))
        | F.coalesce(attr("aria-label").isin(*DETAIL_JUNK_ARIA_LABELS), F.lit(False))
    )


def strip_junk_generic(nodes: DataFrame) -> DataFrame:
    """B2: delete script/style/nav/header/footer/… subtrees."""
    return drop_subtrees(nodes, generic_junk_pred())


def strip_junk_detail(nodes: DataFrame) -> DataFrame:
    """Delete nav/header/footer/aside/breadcrumb/… subtrees (scripts stay)."""
    return drop_subtrees(nodes, detail_junk_pred())
