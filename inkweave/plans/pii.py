"""Registered queries of personal data: identifiers, and texts masked in one pass by the values found in their files."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweave.functions import scalars as S
from inkweave.operators import pii as P
from inkweave.plans.catalogue import query

#: SQL has no lookaround, so everything that may stand beside an identifier's digits is made no word sign before ``\\b`` looks.
FINDS = r"""plain AS (SELECT path, text, regexp_replace(text, '[A-Za-z_]', '~', 'g') AS d FROM file),
    card AS (SELECT path, value, regexp_replace(value, '[^0-9]', '', 'g') AS n FROM (SELECT path, unnest(regexp_extract_all(d, '\b(?:[0-9][ -]?){12,18}[0-9]\b')) AS value FROM plain)),
    number AS (SELECT path, unnest(regexp_extract_all(d, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b')) AS value FROM plain
      UNION ALL SELECT path, value FROM card WHERE list_sum([CASE WHEN i % 2 = 1 THEN CAST(reverse(n)[i] AS INT) ELSE (2 * CAST(reverse(n)[i] AS INT)) // 10 + (2 * CAST(reverse(n)[i] AS INT)) % 10 END FOR i IN range(1, length(n) + 1)]) % 10 = 0),
    find AS (SELECT DISTINCT path, 'id_number' AS label, value FROM number
      UNION SELECT path, 'id_digits', value FROM (SELECT path, unnest(regexp_extract_all(text, '[0-9]+')) AS value FROM file) WHERE length(value) BETWEEN 13 AND 19
      UNION SELECT path, 'contact_email', unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) FROM file)"""

#: The underscore is no letter or digit for a value's ends but is one for ``\\b``: it is another sign while the pattern looks.
MASK = FINDS + r""", v AS (SELECT path, string_agg(CASE WHEN regexp_matches(x, '^[0-9A-Za-z]') THEN '\b' ELSE '' END || regexp_escape(x) || CASE WHEN regexp_matches(x, '[0-9A-Za-z]$') THEN '\b' ELSE '' END, '|' ORDER BY length(x) DESC, x) AS p
      FROM (SELECT DISTINCT path, replace(value, '_', chr(1)) AS x FROM find WHERE {labels} AND length(regexp_replace(value, '[^0-9A-Za-z]', '', 'g')) >= 6) GROUP BY 1),
    m AS (SELECT path, string_split_regex(t, p) AS s, regexp_extract_all(t, p) AS f FROM (SELECT path, p, replace(text, '_', chr(1)) AS t FROM v JOIN file USING (path))),
    masked AS (SELECT path, replace(array_to_string([s[i] || CASE WHEN i > len(f) THEN '' ELSE concat('[pii …', right(regexp_replace(f[i], '[^0-9A-Za-z]', '', 'g'), 4), ']') END FOR i IN range(1, len(s) + 1)], ''), chr(1), '_') AS text FROM m)"""
MASKED = "SELECT f.path, coalesce(m.text, f.text) AS text FROM file f LEFT JOIN masked m USING (path)"


def masked_sql(labels: str) -> str:
    return MASK.replace("{labels}", labels)


@query(f"WITH {FINDS} SELECT path, value FROM number")
def pii_identifiers(g):
    """Social security and card numbers, also with spaces and hyphens."""
    return g.file.select("path", F.explode(S.identifiers(F.col("text"))).alias("value"))


@query(f"WITH {masked_sql('true')} {MASKED}")
def pii_mask(g):
    """Every text without the values found in it, in its row."""
    t = F.col("text")
    return g.file.select("path", S.mask(t, F.concat(S.emails(t), S.digit_runs(t), S.identifiers(t))).alias("text"))


@query(f"WITH {FINDS} SELECT path, label, value FROM find")
def pii_finds(g):
    return P.found(g.file)


@query(f"""WITH {masked_sql("starts_with(label, 'id_')")} {MASKED}""")
def pii_mask_labels(g):
    """Texts masked by the table of finds of their paths, the labels of identifiers alone."""
    return P.masked(g.file.select("path", "text"), P.found(g.file), ["id_"])
