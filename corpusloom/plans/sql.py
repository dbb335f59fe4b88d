"""SQL fragments of the checks."""

from __future__ import annotations

from ..functions.text import FOLDS

SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def clean(t: str) -> str:
    t = rf"regexp_replace({t}, '[\n\t\r]', ' ', 'g')"
    t = rf"regexp_replace({t}, '[\p{{Cc}}\p{{Cf}}\p{{Co}}]', '', 'g')"
    return f"trim(regexp_replace({t}, '{SPACE}+', ' ', 'g'))"


def casefold(t: str) -> str:
    t = f"lower({t})"
    for a, b in FOLDS.items():
        t = f"replace({t}, '{a}', '{b}')"
    return t


def words(t: str) -> str:
    return f"regexp_extract_all({casefold(t)}, '[a-z0-9]+')"


#: Cleaned documents that aren't empty.
CLEAN = f"c AS (SELECT doc_id, source, lang, {clean('text')} AS text FROM documents WHERE text IS NOT NULL)"
#: Of these, the first of equal texts in a source.
UNIQUE = "u AS (SELECT * FROM c WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1)"
#: Benchmarks and their shingles.
INDEX = f"""b AS (SELECT item_id % 4 AS benchmark, {words("text")} AS w FROM benchmark),
x AS (SELECT DISTINCT benchmark, array_to_string(w[i:i+11], ' ') AS shingle FROM (SELECT benchmark, w, unnest(range(1, len(w) - 10)) AS i FROM b))"""


def hits(rows: str) -> str:
    """CTE h: positions in rows whose shingle a benchmark has."""
    return f"""w_ AS MATERIALIZED (SELECT doc_id, {words("text")} AS w FROM {rows}),
p_ AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i+11], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM w_)),
h AS (SELECT doc_id, pos, benchmark FROM p_ JOIN x USING (shingle))"""


CHARGED = """n_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id, benchmark ORDER BY pos) AS n FROM h),
g AS (SELECT doc_id, arg_min(benchmark, pos * 8 + benchmark) AS benchmark FROM n_ WHERE n = 2 GROUP BY doc_id)"""


def coin(seed: int, *key: str) -> str:
    parts = " || '|' || ".join([f"'{seed}'", *key])
    return f"(CAST(CAST('0x' || substr(md5({parts}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296)"


TOKENS = "(CASE WHEN text = '' THEN 1 ELSE len(string_split(text, ' ')) + 1 END)"
