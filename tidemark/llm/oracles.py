"""DuckDB SQL for the queries that SQL can express over whole tables."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op9_decontamination": f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
     win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
             FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(i) WHERE len(w) > 0),
     d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     spots AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
            FROM d, (SELECT DISTINCT n FROM win) s, unnest(range(1, greatest(len(w) - n + 2, 1))) t(i)),
     hit AS (SELECT doc_id, i, spots.n, item_id FROM spots JOIN win ON spots.p = win.p AND spots.n = win.n),
     words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + n)) t(j) GROUP BY doc_id),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
}


# Kinds of secrets, base kinds first, in this SQL's own patterns.
_KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/-]+=*)", 1, 16),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("prefixed", r"\b(?:ghp_|gho_|ghs_|ghu_|xoxa-|xoxb-|xoxp-|sk_live_)[A-Za-z0-9_-]+", 0, 20),
)
_HARMLESS = ("example", "changeme", "placeholder", "your_", "your-", "xxxx", "dummy", "sample")


_BASE = ("assign", "access", "hex")


def _secrets() -> str:
    """Spans of each kind from the lengths of parts and matches, then the
    corpus-wide counts of each secret by repository and owner."""
    parts, kinds = [], []
    for i, (kind, pattern, group, least) in enumerate(_KINDS):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"""m{i} AS (SELECT doc_id, src, regexp_extract_all(t, {p}, 0) AS f, regexp_extract_all(t, {p}, {group}) AS s, string_split_regex(t, {p}) AS g FROM base WHERE regexp_matches(t, {p})),
     k{i} AS (SELECT doc_id, src, {i} AS kind, '{kind}' AS name, list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:j - 1], lambda x: length(x))), 0) AS a, f[j] AS found, s[j] AS secret FROM m{i}, unnest(range(1, len(f) + 1)) r(j) WHERE length(s[j]) >= {least})"""
        )
        kinds.append(f"SELECT * FROM k{i}")
    harmless = " OR ".join(f"contains(lower(found), '{x}')" for x in _HARMLESS)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{kind}" for i, kind in enumerate(_BASE))
    listed = lambda where: f"coalesce(string_agg(name || ':' || CAST(a AS VARCHAR) || ':' || CAST(a + length(found) AS VARCHAR), ',' ORDER BY a, kind){where}, '')"
    return f"""
WITH base AS (SELECT doc_id, coalesce(source, '') AS src, coalesce(text, '') AS t FROM documents),
     {', '.join(parts)},
     spans AS ({' UNION ALL '.join(kinds)}),
     owned AS (SELECT secret, bool_or(len(list_distinct(string_split(secret, ''))) < 6 OR {harmless}) OR count(DISTINCT split_part(src, '/', 1)) > 2 OR count(DISTINCT src) > 3 AS example FROM spans GROUP BY secret),
     docs AS (SELECT doc_id, {counts}, sha256({listed(f' FILTER (WHERE kind < {len(_BASE)})')}) AS base_sha256, {listed('')} AS spans,
              count(*) FILTER (WHERE NOT example) AS n_live, count(*) FILTER (WHERE example) AS n_example FROM spans JOIN owned USING (secret) GROUP BY doc_id)
SELECT base.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in _BASE)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM base LEFT JOIN docs ON base.doc_id = docs.doc_id"""


SQL["op7_secret_scan"] = _secrets()
