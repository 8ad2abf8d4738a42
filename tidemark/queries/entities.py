"""Queries over company names, hosts and what is claimed of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities
from ..plans.views import table
from .registry import query

STRATEGIES = ("com", "net", "org")

PARTS = """
c AS (SELECT p_partkey AS company_id, p_name AS name FROM part),
g AS (SELECT p_partkey AS entity_id, concat_ws(' ', p_name, p_type, CASE WHEN p_size % 2 = 0 THEN p_brand END, CASE WHEN p_size % 3 = 0 THEN 'Holding' END) AS legal_name FROM part)"""
SETS = """
w AS (SELECT DISTINCT name AS v FROM c UNION SELECT DISTINCT legal_name FROM g),
t AS (SELECT v, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(v), '[^\\p{L}\\p{N}]+'),
        lambda x: x <> '' AND x NOT IN ('the', 'and', 'for', 'of', 'co', 'company', 'sae', 'holding', 'group', 'inc', 'ltd', 'plc', 'egypt', 'egyptian')))) AS words FROM w),
q AS (SELECT company_id, name, words FROM c JOIN t ON name = v), k AS (SELECT words, min({'k': entity_id, 'v': legal_name}) AS o FROM g JOIN t ON legal_name = v WHERE len(words) > 0 GROUP BY 1)"""


def names(spark, d):
    """Parts as companies under their short name, and as registered entities under a longer one."""
    p = table(spark, d, "part")
    legal = F.concat_ws(" ", "p_name", "p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.when(F.col("p_size") % 3 == 0, "Holding"))
    return p.select(F.col("p_partkey").alias("company_id"), F.col("p_name").alias("name")), p.select(F.col("p_partkey").alias("entity_id"), legal.alias("legal_name"))


@query("q5_legal_matches", f"""
WITH {PARTS}, {SETS},
b AS (SELECT q.words, max({{'s': len(q.words)::DOUBLE / len(k.words), 'low': -k.o.k, 'k': k.o.k, 'v': k.o.v}}) AS b FROM (SELECT DISTINCT words FROM q WHERE len(words) > 0) q JOIN k ON list_has_all(k.words, q.words) GROUP BY 1)
SELECT company_id, name, b.k AS entity_id, b.v AS legal_name, round(b.s, 6) AS confidence,
  CASE WHEN len(q.words) = 0 THEN 'the name has no significant word' WHEN b IS NULL THEN 'no registered name holds every word of the name' END AS rejection_reason
FROM q LEFT JOIN b ON q.words = b.words""")
def q5_legal(spark, d):
    return entities.legal_matches(*names(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query("q5_similar_names", f"""
WITH {PARTS}, {SETS},
a AS (SELECT words, min(company_id) AS company_id, count(*) AS companies FROM q WHERE len(words) > 0 GROUP BY 1),
e AS (SELECT words FROM k UNION SELECT words FROM a), n AS (SELECT count(*) AS sets FROM e),
x AS (SELECT word, ln(1 + any_value(sets) / count(*)::DOUBLE) AS w FROM (SELECT unnest(words) AS word FROM e), n GROUP BY 1),
p AS (SELECT a.company_id, a.companies, k.o.k AS entity_id, k.o.v AS legal_name, unnest(list_distinct(list_concat(a.words, k.words))) AS word, a.words AS aw, k.words AS kw FROM a, k WHERE list_has_any(a.words, k.words)),
s AS (SELECT company_id, entity_id, companies, legal_name, sum(CASE WHEN list_contains(aw, word) AND list_contains(kw, word) THEN w ELSE 0 END) / sum(w) AS similarity FROM p JOIN x USING (word) GROUP BY ALL)
SELECT company_id, entity_id, companies, legal_name, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.6 - 1e-12""")
def q5_similar(spark, d):
    return entities.similar_names(*names(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query("q5_website_claims", """
WITH h AS (SELECT page_id, regexp_extract(lower(url), '://([^/:?#]+)', 1) AS hostname FROM pages),
o AS (SELECT page_id, hostname, regexp_extract(hostname, '([^.]+)\\.example\\.[a-z]+$', 1) AS company_id, regexp_extract(hostname, '([a-z]+)$', 1) AS source FROM h WHERE hostname <> ''),
b AS (SELECT company_id, source, min(hostname) AS hostname FROM o GROUP BY ALL), r AS (SELECT hostname, min(page_id) % 3 <> 0 AS reachable FROM o GROUP BY 1),
g AS (SELECT DISTINCT company_id, place, source FROM (SELECT DISTINCT company_id FROM o), (VALUES (0, 'com'), (1, 'net'), (2, 'org')) s(place, source)),
j AS (SELECT g.company_id, g.place, g.source, b.hostname AS value, r.reachable FROM g LEFT JOIN b USING (company_id, source) LEFT JOIN r ON b.hostname = r.hostname),
w AS (SELECT *, coalesce(bool_or(reachable) OVER (PARTITION BY company_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS won FROM j),
f AS (SELECT *, CASE WHEN value IS NULL THEN 'NOT_FOUND' WHEN won THEN 'UNVERIFIED' WHEN reachable THEN 'CONFIRMED' ELSE 'REFUTED' END AS status FROM w)
SELECT company_id, source, value, status, CASE WHEN value IS NULL THEN 0 ELSE round(1 - place / 3.0::DOUBLE * 0.5, 4) END AS confidence,
  CASE status WHEN 'REFUTED' THEN 'no answer' WHEN 'NOT_FOUND' THEN 'the strategy proposed nothing' END AS rejection_reason FROM f""")
def q5_claims(spark, d):
    """Hosts of the pages as proposals, one strategy per top-level domain; whether a host answers follows from its first page."""
    host = F.regexp_extract(F.lower("url"), r"://([^/:?#]+)", 1)
    o = table(spark, d, "pages").select("page_id", host.alias("hostname")).where("hostname <> ''")
    o = o.select("page_id", "hostname", F.regexp_extract("hostname", r"([^.]+)\.example\.[a-z]+$", 1).alias("company_id"), F.regexp_extract("hostname", r"([a-z]+)$", 1).alias("source"))
    probes = o.groupBy("hostname").agg((F.min("page_id") % 3 != 0).alias("reachable")).withColumn("reason", F.when(~F.col("reachable"), "no answer"))
    return entities.website_claims(o.select("company_id").distinct(), o, probes, list(STRATEGIES))
