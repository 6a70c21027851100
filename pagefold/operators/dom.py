"""Tree relations over the node table, expressed with windows and equi-joins.

Every window here is partitioned by ``page_id`` first, so one exchange on
``page_id`` serves a whole chain of them.  Containment uses the
``pre``/``last`` interval numbering: a running maximum for "inside any", slices
of a page's ordered items for "all inside each" (``gather``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagefold.functions.text import pystrip



def by_page():
    return Window.partitionBy("page_id").orderBy("pre")


def running():
    return by_page().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before():
    return by_page().rowsBetween(Window.unboundedPreceding, -1)


STRING_KINDS = ("text", "hidden", "comment", "doctype")


def is_elem() -> Column:
    return F.col("kind") == "elem"


def is_string() -> Column:
    return F.col("kind").isin(*STRING_KINDS)


def attr(name: str) -> Column:
    return F.col("attrs").getItem(name)


def has_attr(name: str) -> Column:
    return F.coalesce(F.map_contains_key(F.col("attrs"), F.lit(name)), F.lit(False))


def has_class(name: str) -> Column:
    return F.coalesce(F.array_contains(F.col("classes"), F.lit(name)), F.lit(False))


def inside_flag(pred: Column, include_self: bool = True) -> Column:
    """True when the node lies in the subtree of an element matching ``pred``.

    Running max of ``last`` over matching elements in document order: a node
    is inside one iff that running max reaches its ``pre``.
    """
    frame = running() if include_self else before()
    return F.coalesce(F.max(F.when(is_elem() & pred, F.col("last"))).over(frame) >= F.col("pre"), F.lit(False))


def drop_subtrees(nodes: DataFrame, pred: Column) -> DataFrame:
    """Delete every subtree whose root element matches ``pred`` (``decompose``)."""
    return nodes.withColumn("_gone", inside_flag(pred)).filter(~F.col("_gone")).drop("_gone")


def first_match(nodes: DataFrame, pred: Column, name: str) -> DataFrame:
    """Per page, the first element (document order) matching ``pred``: (page_id, name_pre, name_last)."""
    return (
        nodes.filter(is_elem() & pred)
        .groupBy("page_id")
        .agg(F.min(F.struct("pre", "last")).alias("_m"))
        .select("page_id", F.col("_m.pre").alias(f"{name}_pre"), F.col("_m.last").alias(f"{name}_last"))
    )


def ordered_join(items: Column, sep: str) -> Column:
    """``array_join`` of ``collect_list(struct(pre, s))`` sorted by ``pre``."""
    return F.array_join(F.transform(F.sort_array(items), lambda x: x["s"]), sep)


def upto(pres: Column, x: Column) -> Column:
    """How many entries of the ascending array ``pres`` are ``x`` or less (a binary search: each step
    tries to go on by a power of two; steps beyond the end read NULL and are not taken)."""
    bits = F.sequence(F.floor(F.log2(F.greatest(F.size(pres), F.lit(1)))).cast("int") + 1, F.lit(0), F.lit(-1))

    def step(n, bit):
        ahead = n + F.call_function("shiftleft", F.lit(1), bit)
        return F.when(F.get(pres, ahead - 1) <= x, ahead).otherwise(n)

    return F.aggregate(bits, F.lit(0), step)


def gather(targets: DataFrame, items: DataFrame, fold, name: str, distinct: bool = False) -> DataFrame:
    """The structural join: ``targets(page_id, pre, last, ...)`` with ``name = fold(values, target)``, where
    ``values`` are the ``v`` of the ``items(page_id, pre, v)`` with ``pre < item.pre <= last``, in document order.

    An element's descendants are neighbours in document order, so the items inside a target are a
    slice of the page's items.  Each page is one row (items sorted once, targets beside them); a
    target costs two binary searches and its slice, whatever its depth, and no item is paired with
    its ancestors.  Both sides are grouped by ``page_id``, as the node table is bucketed: no exchange.
    With ``distinct`` equal targets count once (a page's targets are compared in order, not hashed).
    """
    columns = [c for c in targets.columns if c != "page_id"]
    of_page = items.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pre", "v"))).alias("_i"))
    of_page = of_page.select("page_id", F.col("_i.pre").alias("_pres"), F.col("_i.v").alias("_vals"))
    wanted = targets.groupBy("page_id").agg(F.collect_list(F.struct(*columns)).alias("_t"))
    if distinct:
        wanted = wanted.select("page_id", F.sort_array("_t").alias("_t"))
        wanted = wanted.select("page_id", F.filter("_t", lambda t, k: (k == 0) | ~t.eqNullSafe(F.get("_t", k - 1))).alias("_t"))
    empty = F.array().cast(f"array<{dict(items.dtypes)['v']}>")
    both = wanted.join(of_page, "page_id", "left").select(
        "page_id", "_t", F.coalesce("_pres", F.array().cast("array<int>")).alias("_pres"), F.coalesce("_vals", empty).alias("_vals"))
    bounds = F.transform("_t", lambda t: F.struct(t.alias("t"), upto(F.col("_pres"), t["pre"]).alias("lo"), upto(F.col("_pres"), t["last"]).alias("hi")))
    folded = F.transform(bounds, lambda b: F.struct(
        b["t"].alias("t"), fold(F.slice(F.col("_vals"), b["lo"] + 1, F.greatest(b["hi"] - b["lo"], F.lit(0))), b["t"]).alias("f")))
    out = both.select("page_id", F.explode(folded).alias("_x"))
    return out.select("page_id", *(F.col(f"_x.t.{c}").alias(c) for c in columns), F.col("_x.f").alias(name))


def with_last(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """``(page_id, pre, last)`` of ``targets(page_id, pre[, last])``; equal rows may repeat."""
    if "last" in targets.columns:
        return targets.select("page_id", "pre", "last")
    return targets.select("page_id", "pre").distinct().join(nodes.select("page_id", "pre", "last"), ["page_id", "pre"])


def subtree_text(
    nodes: DataFrame,
    targets: DataFrame,
    strip: bool = True,
    kinds: tuple[str, ...] = ("text",),
    sep: str = "",
) -> DataFrame:
    """``get_text`` of target elements: ``targets(page_id, pre[, last])`` → ``(page_id, pre, text)``.

    With ``strip=True`` every string is stripped and empties are skipped, as
    ``get_text(strip=True)``; otherwise strings are concatenated as is.
    Only targets with at least one string come back; callers left-join
    and default to ``''`` (so ``targets`` is read once, keeping plans small).
    """
    s = pystrip("text") if strip else F.col("text")
    strings = nodes.filter(F.col("kind").isin(*kinds)).select("page_id", "pre", s.alias("v"))
    if strip:
        strings = strings.filter(F.col("v") != "")
    text = gather(with_last(nodes, targets), strings, lambda x, t: F.when(F.size(x) > 0, F.array_join(x, sep)), "text",
                  distinct="last" in targets.columns)
    return text.filter(F.col("text").isNotNull()).select("page_id", "pre", "text")
