"""Registered queries of the subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagefold.llm import (
    bpe, conversation_repair, decontaminate, itq_dedup, license_scan, ngram_jaccard, quality_fm, suffix_dedup, term_pipeline, token_counts,
    token_files, toxicity_pu, warc,
)
from pagefold.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def put(f):
        QUERIES[name] = f
        return f
    return put


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                             public_tokenizers.PATTERN)


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_quality_fm")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.predict(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op9_warc")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read(spark, sf_dir, "pages"))


@query("op10_toxicity_pu")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_pu.predict(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op5_parity_jaccard")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.components(read(spark, sf_dir, "documents"), words=4, percent=85)


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read(spark, sf_dir, "documents"))


@query("op7_cgk_decontaminate")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op8_itq_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


@query("op11_token_files")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(spark, read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(read(spark, sf_dir, "conversations")))[0]


@query("op13_term_pipeline")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_pipeline.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=50)


#: Backward costs ``g0`` to ``g3`` of the four states, then a walk that takes the ASCII-least edit on a cheapest path.
ORACLES["op12_conversation_repair"] = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(
      string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda x, b: list_reduce(list_concat([xor(x, b)], CAST(range(8) AS BIGINT[])),
        lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    left(role, 1) AS ini, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
    right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') AS is_cut
  FROM damaged),
judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM placed),
r AS (
  SELECT conv_id, i, role, text, ini, is_blank OR again AS gone, CASE WHEN is_cut THEN 3 ELSE 0 END AS t FROM judged),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (is_blank) AS blank, count(*) FILTER (again AND NOT is_blank) AS duplicate,
    count(*) FILTER (is_cut AND NOT again AND NOT is_blank) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
b AS (
  SELECT conv_id, n + 1 AS i, 0 AS g0, 6 AS g1, 3 AS g2, 0 AS g3 FROM counts
  UNION ALL
  SELECT conv_id, i, least(e0, 3 + e2, 6 + e3), least(e1, 3 + e2, 6 + e3), least(e2, 3 + e3), least(e3, 3 + e2) FROM (
    SELECT r.conv_id, r.i,
      CASE WHEN gone THEN 4 + g0 ELSE least(4 + g0, 3 + t + g2, CASE ini WHEN 's' THEN t + g1 WHEN 'u' THEN t + g2 END) END AS e0,
      CASE WHEN gone THEN 4 + g1 ELSE least(4 + g1, 3 + t + g2, CASE ini WHEN 'u' THEN t + g2 END) END AS e1,
      CASE WHEN gone THEN 4 + g2 ELSE least(4 + g2, 3 + t + g3, CASE ini WHEN 'a' THEN t + g3 END) END AS e2,
      CASE WHEN gone THEN 4 + g3 ELSE least(4 + g3, 3 + t + g2, CASE ini WHEN 'u' THEN t + g2 END) END AS e3
    FROM b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)),
g AS (SELECT conv_id, i, unnest([0, 1, 2, 3]) AS s, unnest([g0, g1, g2, g3]) AS g FROM b),
-- every edit from every state: the state behind it, the row behind it, what it costs
ways AS (
  SELECT g.conv_id, g.i, g.s, g.g, 'D' AS e, s AS s2, g.i + 1 AS i2, 4 AS cost, NULL AS role, NULL AS text
    FROM g JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.i = g.i
  UNION ALL
  SELECT conv_id, i, s, g, 'I', CASE s WHEN 2 THEN 3 ELSE 2 END, i, 3, CASE s WHEN 2 THEN 'assistant' ELSE 'user' END, '' FROM g
  UNION ALL
  SELECT g.conv_id, g.i, s, g, 'K', CASE ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, g.i + 1, t, role, text
    FROM g JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.i = g.i
    WHERE NOT gone AND ((ini = 's' AND s = 0) OR (ini = 'u' AND s <> 2) OR (ini = 'a' AND s = 2))
  UNION ALL
  SELECT g.conv_id, g.i, s, g, 'R', CASE s WHEN 2 THEN 3 ELSE 2 END, g.i + 1, 3 + t, CASE s WHEN 2 THEN 'assistant' ELSE 'user' END, text
    FROM g JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.i = g.i WHERE NOT gone),
best AS (
  SELECT w.conv_id, w.i, w.s, min_by({'e': e, 's2': s2, 'i2': i2, 'role': role, 'text': text}, e) AS w
  FROM ways w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = i2 AND g.s = s2 AND w.g = w.cost + g.g GROUP BY w.conv_id, w.i, w.s),
walk AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS i, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM counts
  UNION ALL
  SELECT k.conv_id, w.i2, w.s2, audit || w.e, CASE WHEN w.role IS NULL THEN said ELSE list_append(said, w.role || ':' || w.text) END
  FROM walk k JOIN best ON best.conv_id IS NOT DISTINCT FROM k.conv_id AND best.i = k.i AND best.s = k.s),
ends AS (SELECT k.* FROM walk k JOIN counts c ON c.conv_id IS NOT DISTINCT FROM k.conv_id AND k.i = c.n + 1 AND k.s IN (0, 3)),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.g0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id AND b.i = 1 LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

ORACLES["op13_term_pipeline"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
n AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
i AS (SELECT q, item_id, unnest(list_distinct(t)) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark)),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
c AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // words)))) AS c
  FROM p JOIN w USING (term) JOIN n USING (r), s),
x AS (SELECT q, item_id, r, CAST(sum(c) AS BIGINT) AS score FROM i JOIN c USING (term) GROUP BY q, item_id, r HAVING sum(c) > 0),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM x JOIN n USING (r))
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""
