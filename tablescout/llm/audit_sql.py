"""The SQL forms of the audits and of the secret scan."""

from __future__ import annotations

from tablescout.llm.secrets import JUDGED, LEARNT, MARGIN, MIXED, PATTERNS, PRIOR, SYMBOLS

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11_SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), failing AS (
    SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
           100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
           coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE) AS e
    FROM words
), known AS (
    SELECT doc_id, max(quality) AS good, max(toxic) AS toxic FROM labels GROUP BY doc_id
), masks AS (
    SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
           count(*) FILTER (WHERE good = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
    FROM failing LEFT JOIN known USING (doc_id) GROUP BY ALL
), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, step, (SELECT bit FROM letters WHERE letter = filter_order[step]) AS own,
           (SELECT coalesce(sum(bit), 0)::INT FROM letters WHERE contains(filter_order[1:step - 1], letter)) AS before
    FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
), told AS (
    SELECT part, filter_order, step, own,
           coalesce(sum(n) FILTER (WHERE mask & (before | own) = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
           coalesce(sum(toxic) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
    FROM masks, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM told
"""

OP12_SQL = rf"""
WITH docs AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {LOWER}) AS t,
           row_number() OVER () AS doc FROM documents
), found AS (
    SELECT lang, source, doc, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), own AS (
    SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM found GROUP BY ALL
), kept AS (
    SELECT lang, term, sum(n) AS lang_n FROM own GROUP BY ALL HAVING sum(docs) >= 3
), langs AS (
    SELECT lang, count(term) AS v, coalesce(sum(lang_n), 0) AS lang_total FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang
), groups AS (
    SELECT lang, source, coalesce(sum(n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT * FROM own JOIN kept USING (lang, term)) USING (lang, source)
    GROUP BY ALL
), shares AS (
    SELECT g.lang, g.source, term, coalesce(n, 0) AS n, lang_n, v,
           1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 1)) // (lang_total + v) AS q
    FROM groups g JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), listed AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM listed
QUALIFY part = 'pair' OR rank <= 200
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(kind: str, order: int, pattern: str, least: int, group: int) -> str:
    regex = _quoted(pattern)
    return f"""
    SELECT doc_id, '{kind}' AS kind, {order} AS kind_order, value, stop - length(found) AS start, stop FROM (
        SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY place) AS stop FROM (
            SELECT doc_id, unnest(regexp_extract_all(t, {regex}, 0)) AS found, unnest(regexp_extract_all(t, {regex}, {group})) AS value,
                   unnest(string_split_regex(t, {regex})[:len(regexp_extract_all(t, {regex}, 0))]) AS gap,
                   generate_subscripts(regexp_extract_all(t, {regex}, 0), 1) AS place
            FROM docs WHERE regexp_matches(t, {regex})
        )
    ) WHERE length(value) >= {least}"""


_BASE = " UNION ALL ".join(_spans(kind, k, *rule) for k, (kind, rule) in enumerate(PATTERNS.items()))
_N = len(SYMBOLS)

OP13_SQL = rf"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
), base AS ({_BASE}
), runs AS ({_spans("random", len(PATTERNS), JUDGED, 1, 0)}
), random AS (
    SELECT DISTINCT unnest(CASE WHEN kind = 'assign' THEN regexp_extract_all(value, {_quoted(LEARNT)}) ELSE [value] END) AS value FROM base
), ordinary AS (
    SELECT DISTINCT unnest(regexp_extract_all(t, {_quoted(LEARNT)})) AS value FROM docs
), labelled AS (
    SELECT value, 1 AS label FROM random UNION ALL SELECT value, 0 FROM ordinary
    WHERE NOT regexp_matches(value, {_quoted(MIXED)}) AND value NOT IN (SELECT value FROM random)
), steps AS (
    SELECT label, CASE WHEN i = 1 THEN 0 ELSE strpos('{SYMBOLS}', value[i - 1]) END AS before, strpos('{SYMBOLS}', value[i]) AS after
    FROM (SELECT label, value, unnest(range(1, length(value) + 1)) AS i FROM labelled)
), counted AS (
    SELECT label, before, after, count(*) AS n FROM steps GROUP BY ALL
), every AS (
    SELECT label, before, after, coalesce(n, 0) AS n FROM (
        SELECT label, before, after FROM (SELECT unnest(range(0, 2)) AS label), (SELECT unnest(range(0, {_N + 1})) AS before),
               (SELECT unnest(range(1, {_N + 1})) AS after)
    ) LEFT JOIN counted USING (label, before, after)
), shares AS (
    SELECT label, before, after, ln((n + {PRIOR}) / (sum(n) OVER (PARTITION BY label, before) + {PRIOR * _N})) AS share FROM every
), ratios AS (
    SELECT before, after, CAST(round(1000 * (a.share - b.share)) AS BIGINT) AS ratio
    FROM shares a JOIN shares b USING (before, after) WHERE a.label = 1 AND b.label = 0
), apart AS (
    SELECT * FROM runs WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = runs.doc_id AND base.start < runs.stop AND runs.start < base.stop)
), passed AS (
    SELECT doc_id, kind, kind_order, any_value(value) AS value, start, stop FROM (
        SELECT *, unnest(range(1, length(value) + 1)) AS i FROM apart
    ) JOIN ratios ON before = CASE WHEN i = 1 THEN 0 ELSE strpos('{SYMBOLS}', value[i - 1]) END AND after = strpos('{SYMBOLS}', value[i])
    GROUP BY doc_id, kind, kind_order, start, stop HAVING sum(ratio) > {MARGIN}
), every_span AS (
    SELECT *, kind || ':' || start || ':' || stop AS span FROM base
    UNION ALL SELECT *, kind || ':' || start || ':' || stop FROM passed
)
SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind_order) FILTER (WHERE kind <> 'random'), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind_order), '') AS spans
FROM docs LEFT JOIN every_span USING (doc_id) GROUP BY doc_id
"""
