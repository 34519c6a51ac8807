"""Registered queries of the training-data operators and their DuckDB SQL (where SQL can express
them; the others are tested against brute force in ``tests/llm``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from otgraph.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    from otgraph.llm.decontam import contamination
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from otgraph.llm.toxicity import score_documents, train
    docs = table(spark, sf, "documents")
    return score_documents(docs, train(docs, table(spark, sf, "labels")))


@query
def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from otgraph.llm.line_dedup import dedup_lines
    return dedup_lines(table(spark, sf, "documents"))


@query
def op8_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    from otgraph.llm.near_dup import near_duplicates
    return near_duplicates(table(spark, sf, "documents"), k=3, num=85, den=100)


@query
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    from otgraph.llm.packing import pack
    return pack(table(spark, sf, "documents"))


@query
def op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    from otgraph.llm.secrets import scan_secrets
    return scan_secrets(table(spark, sf, "documents"))


@query
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    from otgraph.llm.quality import judge, train
    docs = table(spark, sf, "documents")
    return judge(docs, train(docs, table(spark, sf, "labels")))


@query
def op9_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    from otgraph.llm.lm_score import score_documents
    return score_documents(table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 1"))


@query
def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    from otgraph.llm.warc import round_trip
    return round_trip(table(spark, sf, "pages"))


ORACLE_SQL["op7_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, coalesce(url, '') AS url, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS lead_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> lead_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> lead_id THEN lead_id END AS refers_to, url
FROM g
"""


@query
def op6_html_text(spark: SparkSession, sf: str) -> DataFrame:
    from otgraph.llm.html_text import extract_text
    return extract_text(table(spark, sf, "pages"))


@query
def op11_runs(spark: SparkSession, sf: str) -> DataFrame:
    from otgraph.llm.runs import periodic_runs
    return periodic_runs(table(spark, sf, "documents"))


@query
def op12_mixing(spark: SparkSession, sf: str) -> DataFrame:
    from otgraph.llm.mixing import mix
    return mix(table(spark, sf, "documents")).withColumn("target", F.round("target", 6))


ORACLE_SQL["op12_mixing"] = r"""
WITH doc AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
hashed AS (SELECT *, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size) AS h FROM doc),
src AS (
  SELECT source, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k
  FROM doc GROUP BY source),
weighed AS (SELECT *, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM src),
filled AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level,
         row_number() OVER (ORDER BY 2.0 * source_size / w, k) AS nth
  FROM weighed WINDOW before AS (ORDER BY 2.0 * source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT min(nth) AS nth, min_by(level, nth) AS level FROM filled WHERE 2.0 * source_size >= level * w),
goal AS (
  SELECT f.source, f.k, f.n_rows, f.source_size, f.w, s.level, f.nth < s.nth AS capped,
         CASE WHEN f.nth < s.nth THEN 2.0 * f.source_size ELSE f.w * s.level END AS target
  FROM filled f, stop s),
setting AS (
  SELECT CAST(greatest(1, least(64, floor(min(target) FILTER (target > 0) / 512))) AS BIGINT) AS b, sum(target) AS total FROM goal),
sharded AS (
  SELECT h.*, g.k, g.source_size, g.target,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % CAST(least(4096, ceil(g.n_rows / 2000)) AS BIGINT) AS shard
  FROM hashed h JOIN goal g ON h.source IS NOT DISTINCT FROM g.source),
cell AS (SELECT k, shard, any_value(source) AS source, sum(size) AS size, CAST(ceil(sum(size) / any_value(b)) AS BIGINT) AS blocks FROM sharded, setting GROUP BY k, shard),
given AS (
  SELECT k, count(*) AS seats FROM (
    SELECT k, row_number() OVER (ORDER BY quotient DESC, k) AS nth FROM (
      SELECT g.k, CASE WHEN g.capped THEN 2.0 * g.source_size / (2 * s + 1) ELSE CAST(g.w AS DOUBLE) / (2 * s + 1) * g.level END AS quotient
      FROM goal g JOIN (SELECT k, sum(blocks) AS blocks FROM cell GROUP BY k) c USING (k), unnest(range(CAST(2 * c.blocks AS BIGINT))) AS t(s)
      WHERE g.target > 0)), setting
  WHERE nth <= floor(total / b + 0.5) GROUP BY k),
part AS (
  SELECT k, shard, count(*) AS quota FROM (
    SELECT c.k, c.shard, row_number() OVER (PARTITION BY c.k ORDER BY CAST(c.size AS DOUBLE) / (2 * s + 1) DESC, c.shard) AS nth
    FROM cell c, unnest(range(2 * c.blocks)) AS t(s)) q JOIN given USING (k)
  WHERE nth <= seats GROUP BY k, shard),
quota AS (
  SELECT c.k, c.shard, greatest(c.blocks, 1) AS n, coalesce(p.quota, 0) AS q,
         CAST('0x' || substr(md5('mix:' || c.shard || ':' || coalesce(c.source, '')), 1, 8) AS BIGINT) % greatest(c.blocks, 1) AS phase
  FROM cell c LEFT JOIN part p ON c.k = p.k AND c.shard = p.shard),
place AS (
  SELECT s.*, n, q // n AS base, q % n AS extra, phase, b,
         CAST(sum(size) OVER (PARTITION BY s.k, s.shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
  FROM sharded s JOIN quota u ON s.k = u.k AND s.shard = u.shard, setting),
ends AS (
  SELECT *, e - size AS a, ((e // b) * extra + phase) // n AS e0, ((e // b + 1) * extra + phase) // n AS e1,
         (((e - size) // b) * extra + phase) // n AS a0, (((e - size) // b + 1) * extra + phase) // n AS a1 FROM place)
SELECT doc_id, size, source, source_size, round(target, 6) AS target,
       CAST(base * size + (b * e0 + e % b * (e1 - e0)) - (b * a0 + a % b * (a1 - a0)) AS BIGINT) AS taken
FROM ends
"""


@query
def op13_lexical(spark: SparkSession, sf: str) -> DataFrame:
    from otgraph.llm.lexical import search
    return search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


ORACLE_SQL["op13_lexical"] = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
word AS (SELECT r, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM doc),
tf AS (SELECT r, term, count(*) AS tf FROM word GROUP BY r, term),
len AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, corpus WHERE term IN (SELECT term FROM item) GROUP BY term, docs),
scored AS (
  SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN len USING (r), corpus GROUP BY item_id, r),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN doc USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
