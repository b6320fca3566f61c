"""DuckDB SQL for what SQL can express of the text operators: the base columns of three of them."""

from __future__ import annotations

from riskgraph.llm.license_texts import PHRASES

#: The base patterns of the secret scan, letter by letter in either case where they are so (fixed values).
_KEYS = ("password", "passwd", "secret", "token", "api_?key")
_VALUE = "[A-Za-z0-9+/_.=-]+"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _assign() -> str:
    return f"""({'|'.join(map(_either_case, _KEYS))})["'']?\\x20*[:=]\\x20*["'']?({_VALUE})"""


def _matches(kind: str, rank: int, pattern: str, fits: str) -> str:
    """Rows (doc_id, kind, rank, start, stop) of a pattern's leftmost matches that fit: they lie between the pieces of a split."""
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, start, start + length(m) AS stop FROM (
  SELECT doc_id, m, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER b, 0) AS start FROM (
    SELECT doc_id, unnest(hits) AS m, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i), b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE {fits}"""


_TEXTS = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def secrets_base() -> str:
    assign = _assign()
    parts = " UNION ALL ".join(
        [
            _matches("assign", 0, assign, f"length(regexp_extract(m, '{assign}', 2)) >= 6"),
            _matches("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20"),
            _matches("hex", 2, "[0-9a-f]+", "length(m) >= 24"),
        ]
    )
    return f"""WITH {_TEXTS}, s AS ({parts}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS said FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(said, '')) AS base_sha256
FROM d LEFT JOIN g USING (doc_id)"""


def licenses_base() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hits = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        tests = " AND ".join(f"w{k} = '{w}'" for k, w in enumerate(words))
        hits.append(f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM n WHERE {tests}")
    most = max(len(p.split()) for p in PHRASES)
    leads = ", ".join(f"lead(w, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS w{k}" for k in range(1, most))
    return f"""WITH {_TEXTS}, x AS (SELECT doc_id, regexp_extract_all(translate(t, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM d),
u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM x), n AS (SELECT doc_id, i, w AS w0, {leads} FROM u),
h AS ({' UNION ALL '.join(hits)}),
g AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM x LEFT JOIN g USING (doc_id)"""


def quality_base() -> str:
    return f"""WITH {_TEXTS}, x AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM x),
q AS (SELECT doc_id, i, [w, lead(w, 1) OVER o, lead(w, 2) OVER o] AS three FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM q WHERE three[3] IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(3) AS s(k) WHERE n > 1 GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws) AS base_failed
FROM x LEFT JOIN c USING (doc_id)"""


def statements() -> dict[str, str]:
    return {"base_secret_scan": secrets_base(), "base_license_scan": licenses_base(), "base_quality_rules": quality_base()}
