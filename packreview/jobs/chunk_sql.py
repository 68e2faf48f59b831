"""SQL for DuckDB of chunking: two recursive statements that take one line, then one run of lines, at a time."""

from __future__ import annotations

_WHITE = r"[\t-\r \x{85}\p{Z}]"
_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WHITE}+|{_WHITE}+$', '', 'g')"


def _flat(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{_WHITE}+', ' ', 'g'))"


def _heading(x: str) -> str:
    letters, capitals = (rf"length(regexp_replace({x}, '[^\p{{{c}}}]', '', 'g'))" for c in ("L", "Lu"))
    return rf"""(length({x}) BETWEEN 4 AND 90 AND NOT regexp_matches({x}, '(?i)\b(shall|must|should|rs\.?|inr|rupees?|lakh|lakhs|crore|crores)\b|₹')
  AND (regexp_matches({x}, '(?i)^(section|annexure|appendix|schedule|chapter|part|clause)\b') OR (NOT regexp_matches({x}, '^[(:/]') AND NOT regexp_matches({x}, '[0-9]')
  AND {letters} > 0 AND 4 * {capitals} > 3 * {letters} AND len(string_split({_flat(x)}, ' ')) <= 12)))"""


def _clause(x: str) -> str:
    return rf"nullif(regexp_extract({_strip(x)}, '(?i)^(?:clause\s+)?(\d+(?:\.\d+)*)(?:\s*[).:-]|\s+)', 1), '')"


_OPENS = r"regexp_matches(t, '(?i)^(?:\d+(?:\.\d+)*\s*[).:\-]\s+\S|(?::\s*)?(?:bidder\b|the\s+bidder\b|earnest\b|emd\b))')"


def chunks(source: str) -> str:
    """source: SQL of (doc_id, source, text); the chunks of chunk_texts of one-page documents."""
    join = lambda xs: f"array_to_string({xs}, chr(10))"
    size = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    none = "CAST([] AS VARCHAR[])"
    keep = lambda xs: f"CASE WHEN length({xs}[-1]) < 300 THEN [{xs}[-1]] ELSE {none} END"
    piece = lambda ok, xs, clause: f"CASE WHEN {ok} THEN [{{'text': {join(xs)}, 'section': section, 'clause': {clause}}}] ELSE [] END"
    return rf"""WITH RECURSIVE d AS MATERIALIZED ({source}),
b AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda b: {_strip('b')}), lambda b: b <> '') AS b FROM d),
l AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(b, lambda x: regexp_split_to_array(x, '{_BREAK}'))), lambda x: {_strip('x')}), lambda x: x <> '') AS l FROM b),
lines AS MATERIALIZED (SELECT doc_id, i, t, {_heading('t')} OR {_OPENS} AS apart FROM (SELECT doc_id, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS i FROM l)),
step(doc_id, i, run, text) AS (SELECT doc_id, i, 1, t FROM lines WHERE i = 1
 UNION ALL SELECT doc_id, i, CASE WHEN own THEN run + 1 ELSE run END, CASE WHEN own THEN t ELSE text || ' ' || t END FROM (
  SELECT s.doc_id, l.i, run, text, t, apart OR {_heading('text')} OR right(text, 1) IN ('.', ':', ';') AS own FROM step s JOIN lines l ON l.doc_id = s.doc_id AND l.i = s.i + 1)),
runs AS MATERIALIZED (SELECT *, {_heading('flat')} AS title, {_clause('flat')} AS found FROM (SELECT *, {_flat('t')} AS flat FROM (SELECT doc_id, run, arg_max(text, i) AS t FROM step GROUP BY ALL))),
pack(doc_id, run, held, section, clause, made) AS (SELECT DISTINCT doc_id, 0, {none}, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST([] AS STRUCT("text" VARCHAR, section VARCHAR, clause VARCHAR)[]) FROM runs
 UNION ALL SELECT doc_id, run, CASE WHEN hard THEN {keep('more')} ELSE more END, CASE WHEN title THEN left(flat, 240) ELSE section END, coalesce(found, clause),
  list_concat({piece('(title OR too_long) AND len(held) > 0', 'held', 'CASE WHEN title THEN clause ELSE coalesce(found, clause) END')}, {piece('hard', 'more', 'coalesce(found, clause)')}) FROM (
  SELECT *, NOT title AND {size('more')} >= 1800 AS hard FROM (
   SELECT *, CASE WHEN title THEN {none} WHEN too_long THEN list_append({keep('held')}, t) ELSE list_append(held, t) END AS more FROM (
    SELECT p.doc_id, r.run, held, section, clause, t, flat, title, found, NOT title AND len(held) > 0 AND {size('held')} + length(t) > 1000 AS too_long FROM pack p JOIN runs r ON r.doc_id = p.doc_id AND r.run = p.run + 1)))),
ends AS (SELECT doc_id, run + 1 AS run, [{{'text': {join('held')}, 'section': section, 'clause': clause}}] AS made FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY run DESC) AS back FROM pack) WHERE back = 1 AND len(held) > 0),
pieces AS (SELECT doc_id, run, unnest(made) AS c, unnest(range(len(made))) AS k FROM (SELECT doc_id, run, made FROM pack UNION ALL SELECT doc_id, run, made FROM ends)),
numbered AS (SELECT doc_id, c, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run, k) AS INT) AS n FROM pieces)
SELECT CAST(0 AS INT) AS case_id, 'tender' AS role, source AS filename, CAST(doc_id AS VARCHAR) AS document_id, doc_id || '-' || n AS chunk_id, n, CAST(1 AS INT) AS page_start, CAST(1 AS INT) AS page_end,
 coalesce({_clause("c['text']")}, c['clause']) AS clause, c['section'] AS section, {_strip("c['text']")} AS text, CAST(1 AS INT) AS page, doc_id * 2147483648 + n AS pos FROM numbered JOIN d USING (doc_id)"""
