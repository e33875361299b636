"""op9: the licence notice nearest to a line of a document or to the whole of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import licenses
from tidemark.llm.arrow import documents


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", "license", F.round("dice", 9).alias("dice"), "line", F.array_join("licenses", ",").alias("licenses"), "n_matches")


def _sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(licenses.TEMPLATES.items()))
    norm = r"regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')"
    grams = "CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END"
    words = "list_filter(string_split(replace({}, chr(10), ' '), ' '), lambda x: x <> '')"
    return f"""
WITH templates(name, body) AS (VALUES {quoted}),
t AS (SELECT name, {grams} AS grams FROM (SELECT name, {words.format(norm.format("body"))} AS w FROM templates)),
docs AS (SELECT doc_id, string_split({norm.format("coalesce(text, '')")}, chr(10)) AS lines FROM documents),
units AS (
  SELECT doc_id, unnest(range(len(lines))) AS line, unnest(lines) AS unit FROM docs
  UNION ALL SELECT doc_id, -1, array_to_string(lines, ' ') FROM docs WHERE len(lines) > 1),
u AS (SELECT doc_id, line, {grams} AS grams FROM (SELECT doc_id, line, {words.format("unit")} AS w FROM units) WHERE len(w) > 0),
m AS (
  SELECT doc_id, line, name, len(list_intersect(u.grams, t.grams)) AS common, len(u.grams) + len(t.grams) AS both_sizes
  FROM u JOIN t ON 200 * least(len(u.grams), len(t.grams)) >= {licenses.PERCENT} * (len(u.grams) + len(t.grams))),
hits AS (SELECT doc_id, line, name, 2.0::DOUBLE * common / both_sizes AS dice FROM m WHERE 200 * common >= {licenses.PERCENT} * both_sizes),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, CASE WHEN line < 0 THEN 2147483647 ELSE line END, name) AS r FROM hits),
every AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(*) AS n FROM hits GROUP BY doc_id)
SELECT d.doc_id, b.name AS license, round(coalesce(b.dice, 0), 9) AS dice, CAST(coalesce(b.line, -1) AS INTEGER) AS line,
  coalesce(e.licenses, '') AS licenses, CAST(coalesce(e.n, 0) AS BIGINT) AS n_matches
FROM documents d LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON b.doc_id = d.doc_id LEFT JOIN every e ON e.doc_id = d.doc_id"""


QUERIES = {"op9_licenses": op9_licenses}
ORACLES = {"op9_licenses": _sql()}
