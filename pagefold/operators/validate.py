"""Record validation, stage statistics and serving merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_TEXT = 100


def validate_records(records: DataFrame) -> DataFrame:
    """G1: adds ``valid`` and the first failing ``reason``.

    Order: exception (unparsable record) → missing_source_url → missing_title
    → no_sections_extracted → text_too_short (content lengths sum < 100).
    """
    total = F.aggregate(F.coalesce("sections", F.array()), F.lit(0), lambda acc, s: acc + F.coalesce(F.length(s["content"]), F.lit(0)))
    bad = F.col("_bad").isNotNull() if "_bad" in records.columns else F.lit(False)
    reason = (
        F.when(bad, "exception")
        .when(F.coalesce(F.col("source_url"), F.lit("")) == "", "missing_source_url")
        .when(F.coalesce(F.col("title"), F.lit("")) == "", "missing_title")
        .when(F.coalesce(F.size("sections"), F.lit(0)) <= 0, "no_sections_extracted")
        .when(total < MIN_TEXT, "text_too_short")
    )
    return records.withColumn("total_text_length", total).withColumn("reason", reason).withColumn(
        "valid", F.col("reason").isNull())


def validation_summary(validated: DataFrame) -> DataFrame:
    """Total, valid and invalid counts (the names are :func:`invalid_records`, a table, not a list)."""
    return validated.agg(
        F.count("*").alias("total"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("invalid"),
    )


def invalid_records(validated: DataFrame, name_col: str = "slug") -> DataFrame:
    """Names of the invalid records with their reason (unbounded, so kept distributed)."""
    return validated.filter(~F.col("valid")).select(F.col(name_col).alias("name"), "reason")


def reasons(validated: DataFrame) -> DataFrame:
    """G2 breakdown: invalid records per reason."""
    return validated.filter(~F.col("valid")).groupBy("reason").agg(F.count("*").alias("n"))


def stage_counts(raw: DataFrame, parsed: DataFrame, enriched: DataFrame) -> DataFrame:
    """Number of records per stage."""
    return (
        raw.agg(F.count("*").alias("n")).select(F.lit("raw").alias("stage"), "n")
        .unionByName(parsed.agg(F.count("*").alias("n")).select(F.lit("parsed").alias("stage"), "n"))
        .unionByName(enriched.agg(F.count("*").alias("n")).select(F.lit("enriched").alias("stage"), "n"))
    )


def prefer_enriched(parsed: DataFrame, enriched: DataFrame, prefer: bool = True) -> DataFrame:
    """Every parsed slug once: its enriched record if present (and preferred), else the parsed one.

    Enriched-only slugs do not appear.  Both sides carry ``slug`` and a
    ``record`` struct with the same fields.
    """
    if not prefer:
        return parsed.select("slug", F.lit("parsed").alias("source"), "record")
    e = enriched.select("slug", F.col("record").alias("_e"))
    return parsed.join(e, "slug", "left").select(
        "slug",
        F.when(F.col("_e").isNotNull(), "enriched").otherwise("parsed").alias("source"),
        F.coalesce("_e", "record").alias("record"),
    )


def lookup_slug(parsed: DataFrame, enriched: DataFrame, slug: str | None = None, prefer: bool = True) -> DataFrame:
    """One record per slug from either stage (enriched-only slugs included); optional slug filter."""
    p = parsed.select("slug", F.col("record").alias("_p"))
    e = enriched.select("slug", F.col("record").alias("_e"))
    if slug is not None:
        p, e = p.filter(F.col("slug") == slug), e.filter(F.col("slug") == slug)
    if not prefer:
        return p.select("slug", F.lit("parsed").alias("source"), F.col("_p").alias("record"))
    j = p.join(e, "slug", "full")
    src = F.when(F.col("_e").isNotNull(), "enriched").otherwise("parsed")
    return j.select("slug", src.alias("source"), F.coalesce("_e", "_p").alias("record"))
