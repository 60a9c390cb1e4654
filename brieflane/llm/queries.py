"""Registered queries of the numbered operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brieflane.llm import (ann_crosspolytope, bpe_fst, hard_negatives, html_extract, jaccard_join, langid, line_dedup, mixing,
                           piece_bpe, token_counts, topk_pivot, toxicity, vector_codes)
from brieflane.llm.common import fold, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def bpe_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "line_dedup.n_lines", "line_dedup.n_removed")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.components_of(table(spark, sf_dir, "documents"), shingle_words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, fold("doc_id", 3) != 1)
    return toxicity.toxicity(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold("doc_id", 4) != 2)
    return langid.identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_pivot.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("row.doc_id", "row.source", "block", "slot", "place")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_fst.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), bpe_pattern())


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_crosspolytope.neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabel = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, relabel)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


SQL_LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id, text, t.i AS i, t.line AS line, trim(t.line) <> '' AS filled,
         sum(CASE WHEN trim(t.line) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY t.i) - 1 AS num
  FROM (SELECT doc_id, text, unnest(list_transform(range(len(string_split(text, chr(10)))),
               lambda k: {'i': k, 'line': string_split(text, chr(10))[k + 1]})) AS t FROM {docs})),
wins AS (
  SELECT doc_id, num, trim(line) AS l1, lead(trim(line)) OVER w AS l2, lead(trim(line), 2) OVER w AS l3
  FROM lines WHERE filled WINDOW w AS (PARTITION BY doc_id ORDER BY num)),
later AS (
  SELECT doc_id, num FROM wins WHERE l3 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, num) > 1),
gone AS (SELECT DISTINCT doc_id, num + k AS num FROM later, (VALUES (0), (1), (2)) v(k)),
marked AS (
  SELECT l.doc_id, l.i, l.line, l.filled, l.filled AND g.num IS NOT NULL AS removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.num = g.num AND l.filled)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(m.kept, '') END AS text,
       CAST(coalesce(m.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(m.n_removed, 0) AS INTEGER) AS n_removed
FROM {docs} d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT removed) AS kept,
         count(*) FILTER (WHERE filled) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed
  FROM marked GROUP BY doc_id) m ON d.doc_id = m.doc_id
"""

SQL_MIXING = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(source, chr(0) || 'null') AS src,
         row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS r
  FROM documents),
sizes AS (SELECT src, count(*) AS n FROM docs GROUP BY src),
raws AS (SELECT src, greatest(CAST(floor(sqrt(n) * 1000) AS BIGINT), 1) AS raw,
                greatest(1000, (count(*) OVER ()) * 10) AS period, count(*) OVER () AS k FROM sizes),
wholes AS (SELECT src, period, ((period - k) * raw) // sum(raw) OVER () AS whole,
                  ((period - k) * raw) % sum(raw) OVER () AS rest, period - k AS free FROM raws),
units AS (SELECT src, period, CAST(1 + whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, src)
                 <= free - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS u FROM wholes),
srcs AS (SELECT list(src ORDER BY src) AS names, list(u ORDER BY src) AS us, max(period) AS period FROM units),
plan AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(NULL AS VARCHAR) AS src, CAST(NULL AS BIGINT) AS turn,
         list_transform(us, lambda x: CAST(0 AS BIGINT)) AS had FROM srcs
  UNION ALL
  SELECT slot + 1, names[best], had[best],
         list_transform(had, lambda x, i: CASE WHEN i = best THEN x + 1 ELSE x END)
  FROM (SELECT p.slot, p.had, s.names, s.us, s.period,
          list_sort(list_filter(list_transform(range(1, len(s.us) + 1), lambda i:
            CASE WHEN (p.had[i] * s.period) // s.us[i] <= p.slot + 1
                 THEN [((p.had[i] + 1) * s.period + s.us[i] - 1) // s.us[i], -s.us[i], i] END),
            lambda x: x IS NOT NULL))[1][3] AS best
        FROM plan p, srcs s WHERE p.slot + 1 < s.period))
SELECT d.doc_id, d.source, CAST(d.r // 16 AS BIGINT) AS block,
       CAST((d.r // 16) // n.u * n.period + p.slot AS BIGINT) AS slot, CAST(d.r % 16 AS INTEGER) AS place
FROM docs d JOIN units n ON d.src = n.src JOIN plan p ON p.src = d.src AND p.turn = (d.r // 16) % n.u
"""

SQL_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(min(CAST(embedding AS DOUBLE[])), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""
SQL_NEGATIVES = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CAST(r.label AS BIGINT) AS label, r.e AS e FROM (
    SELECT vec_id, min({'e': list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))),
                        'label': CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END}) AS r
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id)),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, o.vec_id AS vec_id, a.label = o.label AS same, CAST(list_dot_product(a.e, o.e) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id % 50 = 0 AND o.vec_id <> a.vec_id AND len(a.e) = len(o.e)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


SQL_CODES_HEAD = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
places AS (SELECT unnest(range(max(len(v)))) AS k, max(len(v)) // 8 AS wide FROM kept),
comp AS MATERIALIZED (SELECT rid, k // wide AS part, k % wide AS pos, v[k + 1] AS x FROM kept, places),
seeds AS (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM kept QUALIFY entry < 16),
book0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM comp JOIN seeds USING (rid))"""

SQL_CODES_ROUND = """,
near{r} AS MATERIALIZED (
  SELECT rid, part, entry, d FROM (
    SELECT rid, part, entry, sum((x - c) * (x - c)) AS d FROM comp JOIN book{r} USING (part, pos) GROUP BY rid, part, entry)
  QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) = 1)"""

SQL_CODES_UPDATE = """,
sums{r} AS (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
           FROM comp JOIN near{r} USING (rid, part) GROUP BY part, entry, pos),
book{next} AS MATERIALIZED (
  SELECT part, entry, pos, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
  FROM book{r} LEFT JOIN sums{r} USING (part, entry, pos))"""

SQL_CODES_TAIL = """,
coded AS (SELECT rid, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
          FROM near6 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book6) AS codebooks_sha256
FROM coded JOIN kept USING (rid)
"""

SQL_CODES = (SQL_CODES_HEAD + "".join(SQL_CODES_ROUND.format(r=r) + SQL_CODES_UPDATE.format(r=r, next=r + 1) for r in range(6))
             + SQL_CODES_ROUND.format(r=6) + SQL_CODES_TAIL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_counts, op2_line_dedup, op3_jaccard_join, op4_toxicity, op5_language_id, op6_exact_topk,
             op7_source_mixing, op8_html_extract, op9_bpe, op10_ann, op11_hard_negatives,
             op12_sentencepiece, op13_vector_codes]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": SQL_LINE_DEDUP.replace("{docs}", "documents"), "op6_exact_topk": SQL_TOPK,
            "op7_source_mixing": SQL_MIXING, "op11_hard_negatives": SQL_NEGATIVES,
            "op13_vector_codes": SQL_CODES}
