"""Queries of problem 6 (a few keys hold most records) and their SQL."""

from __future__ import annotations

from textmill.operators import token_sizes as ts
from textmill.sources.tables import table

QUERIES = {
    "p6_found": lambda spark, d: ts.heavy_token_entries(table(spark, d, "token_entries")),
    "p6_token_report": lambda spark, d: ts.token_report(table(spark, d, "token_entries")),
    "p6_join_totals": lambda spark, d: ts.token_join_totals(table(spark, d, "token_entries"), table(spark, d, "postings")),
}

_SIZES = """
sizes AS (
  SELECT token, count(DISTINCT doc_id) AS pages
  FROM (SELECT token, unnest(list_transform(postings, lambda p: p.doc_id)) AS doc_id FROM token_entries WHERE token IS NOT NULL)
  WHERE doc_id IS NOT NULL GROUP BY token)"""

SQL = {
    "p6_found": f"""WITH {_SIZES}
SELECT e.token, e.run_id FROM token_entries e JOIN sizes s ON s.token = e.token
WHERE s.pages * 200 >= 3 * (SELECT sum(pages) FROM sizes)""",
    "p6_token_report": f"""WITH {_SIZES},
stated AS (
  SELECT token, count(*) AS runs, CAST(coalesce(sum(len(postings)), 0) AS BIGINT) AS elements, CAST(coalesce(sum(df), 0) AS BIGINT) AS stated_df
  FROM token_entries WHERE token IS NOT NULL GROUP BY token)
SELECT t.token, t.runs, t.elements, CAST(coalesce(s.pages, 0) AS BIGINT) AS pages, t.stated_df, CAST(t.stated_df - coalesce(s.pages, 0) AS BIGINT) AS overstated
FROM stated t LEFT JOIN sizes s ON s.token = t.token""",
    "p6_join_totals": """WITH l AS (SELECT token, unnest(postings) AS p FROM token_entries)
SELECT l.token, count(*) AS join_rows, CAST(coalesce(sum(l.p.frequency), 0) AS BIGINT) AS sum_list_frequency, CAST(coalesce(sum(r.frequency), 0) AS BIGINT) AS sum_row_frequency
FROM l JOIN postings r ON r.token = l.token GROUP BY l.token""",
}
