"""SQL that says what the registered queries return, for those that SQL can express; ``doc_id`` and ``page_id`` are unique there."""

from __future__ import annotations

from tessera.llm.urls import EXTENSIONS, SEGMENTS, SPAM_WORDS

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_DARK = r"[^\x20\x09-\x0D]+"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(table: str, key: str, pattern: str, lower: bool) -> str:
    text = "coalesce(text, '')"
    return f"SELECT {key}, regexp_extract_all({_LOWER.format(text) if lower else text}, '{pattern}') AS w FROM {table}"


OP1 = f"""
WITH RECURSIVE d AS ({_words("documents", "doc_id", _DARK, True)}),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, b AS other FROM edges
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
),
least_of AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""

OP2 = f"""
WITH d AS ({_words("documents", "doc_id", _LETTERS, True)}),
b AS ({_words("benchmark", "item_id", _LETTERS, True)}),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
),
found AS (SELECT DISTINCT doc_id, places.n, p, item_id FROM places JOIN windows ON places.win = windows.win AND places.n = windows.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4 = f"""
WITH d AS ({_words("documents", "doc_id", _DARK, False)}),
starts AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + 34), ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)
),
twice AS (SELECT win FROM starts GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM starts SEMI JOIN twice USING (win)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
starts AS (
  SELECT doc_id, p, substr(bytes, 2 * p + 1, 100) AS win
  FROM (SELECT doc_id, bytes, unnest(range(0, length(bytes) // 2 - 49)) AS p FROM d WHERE length(bytes) >= 100)
),
first AS (SELECT win, min(doc_id) AS owner FROM starts GROUP BY win HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, p FROM starts JOIN first USING (win) WHERE owner < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM hits),
runs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (prev IS DISTINCT FROM p - 1) AS n_spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM gone) GROUP BY doc_id),
each AS (SELECT doc_id, unnest(range(0, length(bytes) // 2)) AS p, unnest(regexp_extract_all(bytes, '..')) AS byte FROM d WHERE length(bytes) > 0),
kept AS (SELECT doc_id, string_agg(byte, '' ORDER BY p) AS bytes FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, length(d.bytes) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept.bytes, ''))) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP6 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS p FROM d),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_WHITE})")} AS key FROM l),
shared AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT k.*, coalesce(owner <> doc_id, false) AS gone FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_SPAM = ", ".join(f"'{w}'" for w in SPAM_WORDS)
_SEGMENTS = ", ".join(f"'{w}'" for w in SEGMENTS)
OP7 = f"""
WITH rules(host, path, action) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
),
u AS (
  SELECT page_id, coalesce({_LOWER.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
best AS (
  SELECT page_id, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule, arg_max(action, length(rules.host || rules.path)) AS action
  FROM u JOIN rules ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN list_has_any(string_split_regex(host, '[.-]'), [{_SPAM}]) OR list_has_any(string_split(path, '/'), [{_SEGMENTS}]) OR regexp_matches(path, '\\.({'|'.join(EXTENSIONS)})$') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (page_id)
"""

#: Left out: 3, 5, 8 and 9 run a tokenizer, fitted trees, ranked merges and a parser.
SQL = {
    "op1_minhash_near_dedup": OP1,
    "op2_decontamination": OP2,
    "op4_substring_dedup": OP4,
    "op6_line_dedup": OP6,
    "op7_url_filter": OP7,
    "op10_suffix_dedup": OP10,
}
