"""The pN_ queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

import unicodedata

from textmill.llm import distinctive_terms, encoding_repair, leaks, main_content, markup, residue, site_lines, token_ids, visual_form
from textmill.llm.visual_form import INVISIBLE, LOOK_ALIKES, SPACES
from textmill.sources.tables import table

QUERIES = {
    "p1_found": lambda spark, d: distinctive_terms.dominant_terms(table(spark, d, "postings")),
    "p1_scores": lambda spark, d: _rounded(distinctive_terms.score_terms(table(spark, d, "postings"))),
    "p2_found": lambda spark, d: residue.residue_pages(table(spark, d, "pages"), table(spark, d, "text_pages")),
    "p2_clean": lambda spark, d: residue.without_residue(table(spark, d, "pages"), table(spark, d, "text_pages")).select("page_id", "path"),
    "p3_found": lambda spark, d: markup.markup_pages(table(spark, d, "text_pages")),
    "p3_clean": lambda spark, d: markup.clean_pages(table(spark, d, "text_pages")),
    "p4_found": lambda spark, d: site_lines.repeated_line_numbers(table(spark, d, "text_pages")),
    "p4_clean": lambda spark, d: site_lines.without_repeated_lines(table(spark, d, "text_pages")),
    "p5_found": lambda spark, d: main_content.main_lines(table(spark, d, "pages"), table(spark, d, "text_pages")),
    "p5_text": lambda spark, d: main_content.main_text(table(spark, d, "pages"), table(spark, d, "text_pages")),
    "p7_found": lambda spark, d: encoding_repair.garbled_pages(table(spark, d, "pages"), table(spark, d, "text_pages")),
    "p7_repaired": lambda spark, d: encoding_repair.repaired_pages(table(spark, d, "pages"), table(spark, d, "text_pages")),
    "p8_ids": lambda spark, d: token_ids.encode_documents(table(spark, d, "documents")),
    "p8_decoded": lambda spark, d: token_ids.decode_documents(token_ids.encode_documents(table(spark, d, "documents"))),
    "p9_found": lambda spark, d: leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "p10_found": lambda spark, d: visual_form.look_alike_pairs(table(spark, d, "documents")),
    "p10_form": lambda spark, d: visual_form.one_form(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "form"),
    "p10_classes": lambda spark, d: visual_form.form_classes(table(spark, d, "documents")),
}


def _rounded(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(c, 6) for c in ("weight", "llr")})


_COUNTS = """
rows AS (
  SELECT token, doc_id, run_id, CAST(coalesce(list_sum(map_values(tag_frequencies)), 0) AS BIGINT) AS tf
  FROM postings WHERE token <> '' AND doc_id IS NOT NULL),
counts AS (SELECT token, doc_id, arg_max(tf, (run_id, tf)) AS tf FROM rows GROUP BY token, doc_id),
tokens AS (SELECT token, count(*) AS df, sum(tf) AS ctf FROM counts GROUP BY token),
scored AS (
  SELECT c.doc_id, c.token, c.tf, t.df, c.tf * ln((SELECT count(DISTINCT doc_id) FROM counts) / t.df) AS weight, t.ctf
  FROM counts c JOIN tokens t ON t.token = c.token WHERE t.df >= 2)"""

_LINES = r"""
sited AS (
  SELECT page_id, content, nullif(regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)', 1), '\.$', ''), '^www\.', ''), '') AS site
  FROM text_pages WHERE page_id IS NOT NULL),
pages_of AS (SELECT site, count(DISTINCT page_id) AS n FROM sited WHERE site IS NOT NULL GROUP BY site),
split AS (SELECT page_id, site, string_split(content, chr(10)) AS ls FROM sited WHERE site IS NOT NULL AND content IS NOT NULL),
lines AS (
  SELECT page_id, site, line_no, trim(regexp_replace(lower(line), '[^\p{L}]+', ' ', 'g')) AS form
  FROM (SELECT page_id, site, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM split)),
chosen AS (
  SELECT l.site, l.form FROM lines l JOIN pages_of p ON p.site = l.site WHERE l.form <> ''
  GROUP BY l.site, l.form, p.n HAVING count(DISTINCT l.page_id) >= 4 AND count(DISTINCT l.page_id) * 5 >= p.n),
found AS (SELECT DISTINCT l.page_id, l.line_no FROM lines l JOIN chosen c ON c.site = l.site AND c.form = l.form)"""

def _by_character(text: str) -> str:
    """The one form of problem 10 a character at a time, without the expression of the operator: full-width signs by the distance
    of their block, half-width ones and look-alikes by a map, spaces and invisible characters by patterns."""
    latin = {a: b for letters, like in LOOK_ALIKES.values() for a, b in zip(letters, like, strict=True)}
    halves = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0xFF5F, 0xFFEF),) if len(unicodedata.normalize("NFKC", chr(c))) == 1}
    table = {a: b for a, b in (halves | latin).items() if a != b}
    known = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in table.items()) + "}"
    shown = f"regexp_replace(nfc_normalize(regexp_replace({text}, '{INVISIBLE}', '', 'g')), '[{SPACES}]', ' ', 'g')"
    one = f"CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) ELSE coalesce({known}[c], c) END"
    return f"CASE WHEN {text} = '' THEN '' ELSE nfc_normalize(array_to_string(list_transform(string_split({shown}, ''), lambda c: {one}), '')) END"


_FORMED = f"formed AS (SELECT doc_id, text, {_by_character('text')} AS form FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)"

SQL = {
    "p1_found": f"""WITH {_COUNTS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token) AS r FROM scored)
SELECT a.doc_id, a.token FROM ranked a LEFT JOIN ranked b ON b.doc_id = a.doc_id AND b.r = 2
WHERE a.r = 1 AND a.weight > 0 AND a.weight >= 2 * coalesce(b.weight, 0)""",
    "p1_scores": f"""WITH {_COUNTS},
docs AS (SELECT doc_id, sum(tf) AS dtf FROM counts GROUP BY doc_id),
cells AS (
  SELECT s.*, CAST(s.tf AS DOUBLE) AS k11, CAST(d.dtf - s.tf AS DOUBLE) AS k12, CAST(s.ctf - s.tf AS DOUBLE) AS k21,
    CAST(a.n - d.dtf - s.ctf + s.tf AS DOUBLE) AS k22, CAST(a.n AS DOUBLE) AS n
  FROM scored s JOIN docs d ON d.doc_id = s.doc_id CROSS JOIN (SELECT sum(ctf) AS n FROM tokens) a)
SELECT doc_id, token, tf, df, round(weight, 6) AS weight,
  round(CASE WHEN k11 * n >= (k11 + k12) * (k11 + k21) THEN 1 ELSE -1 END * 2 * (
    CASE WHEN k11 > 0 THEN k11 * ln(k11 * n / ((k11 + k12) * (k11 + k21))) ELSE 0 END +
    CASE WHEN k12 > 0 THEN k12 * ln(k12 * n / ((k11 + k12) * (k12 + k22))) ELSE 0 END +
    CASE WHEN k21 > 0 THEN k21 * ln(k21 * n / ((k21 + k22) * (k11 + k21))) ELSE 0 END +
    CASE WHEN k22 > 0 THEN k22 * ln(k22 * n / ((k21 + k22) * (k12 + k22))) ELSE 0 END), 6) AS llr
FROM cells""",
    "p4_found": f"WITH {_LINES} SELECT page_id, CAST(line_no AS BIGINT) AS line_no FROM found",
    "p4_clean": f"""WITH {_LINES},
gone AS (SELECT page_id, list(line_no) AS ns, count(*) AS n FROM found GROUP BY page_id)
SELECT t.page_id, CASE WHEN g.ns IS NULL THEN content ELSE array_to_string(list_filter(string_split(content, chr(10)), lambda x, i: NOT list_contains(g.ns, i)), chr(10)) END AS content,
  CAST(coalesce(g.n, 0) AS INT) AS removed FROM text_pages t LEFT JOIN gone g ON g.page_id = t.page_id""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": rf"""WITH {_FORMED},
items AS (SELECT item_id, {_by_character("text")} AS form FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
dw AS (SELECT doc_id, regexp_extract_all(lower(form), '[\p{{L}}\p{{N}}]+') AS w FROM formed),
iw AS (SELECT item_id, regexp_extract_all(lower(form), '[\p{{L}}\p{{N}}]+') AS w FROM items),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM dw WHERE len(w) >= 12),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM iw WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig ON ig.g = dg.g""",
    "p10_found": rf"""WITH {_FORMED},
lettered AS (SELECT * FROM formed WHERE regexp_matches(form, '\p{{L}}'))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b
FROM lettered a JOIN lettered b ON a.form = b.form AND a.text <> b.text AND a.doc_id < b.doc_id""",
    "p10_form": f"SELECT doc_id, {_by_character('text')} AS form FROM documents",
    "p10_classes": f"""WITH {_FORMED}
SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS class_id, text <> form AS changed FROM formed""",
}
