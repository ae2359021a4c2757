"""SQL for the queries that SQL can express, written apart from the operators' code."""

from __future__ import annotations

_SOURCES = ", ".join(f"('src{n}', 0.05::double)" for n in range(20))
_MARGINS = ("source", "lang", "topic")


def _mixing() -> str:
    hits = lambda cues: " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in cues)
    steps = [
        f"""WITH wanted(margin, value, share) AS (
  SELECT 'source', * FROM (VALUES {_SOURCES})
  UNION ALL SELECT 'lang', * FROM (VALUES ('en', 0.55::double), ('de', 0.17), ('fr', 0.17), ('es', 0.11))
  UNION ALL SELECT 'topic', * FROM (VALUES ('action', 0.5::double), ('being', 0.45), ('none', 0.05))
),
cues AS (
  SELECT doc_id,
    CASE WHEN source IN (SELECT value FROM wanted WHERE margin = 'source') THEN source ELSE '(other)' END AS source,
    CASE WHEN lang IN (SELECT value FROM wanted WHERE margin = 'lang') THEN lang ELSE '(other)' END AS lang,
    coalesce({hits(('tion', 'ción', 'ung'))}, 0) AS action, coalesce({hits(('ing', 'ment', 'heit'))}, 0) AS being,
    CASE WHEN length(text) > 0 THEN 1 + len(regexp_extract_all(text, '[ \\n]')) ELSE 0 END AS tokens
  FROM documents
),
docs AS (
  SELECT doc_id, source, lang, tokens,
    CASE WHEN greatest(action, being) = 0 THEN 'none' WHEN action >= being THEN 'action' ELSE 'being' END AS topic
  FROM cues
),
cells AS (SELECT source, lang, topic, sum(tokens)::double AS tokens FROM docs GROUP BY ALL),
w0 AS (SELECT *, tokens / sum(tokens) OVER () AS w FROM cells)"""
    ]
    targets = []
    for m in _MARGINS:
        targets.append(
            f"""t_{m} AS (
  SELECT value, CASE WHEN value = '(other)' THEN have ELSE share / sum(share) OVER () * (1 - coalesce(max(have) FILTER (value = '(other)') OVER (), 0)) END AS share
  FROM (SELECT {m} AS value, sum(w) AS have FROM w0 GROUP BY 1) LEFT JOIN (SELECT value, share FROM wanted WHERE margin = '{m}') USING (value)
)"""
        )
    steps += targets
    n = 0
    for _ in range(12):
        for m in _MARGINS:
            n += 1
            steps.append(
                f"w{n} AS (SELECT w{n - 1}.* REPLACE (w * (SELECT share FROM t_{m} WHERE value = {m}) / sum(w) OVER (PARTITION BY {m}) AS w) FROM w{n - 1})"
            )
    steps.append(
        f"""r AS (SELECT *, w / tokens AS ratio FROM w{n} WHERE tokens > 0),
lines AS (
  SELECT coalesce(sum(tokens) OVER before, 0) AS whole, 1 - coalesce(sum(w) OVER before, 0) AS rest, sum(tokens) OVER () AS total
  FROM r WINDOW before AS (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
s AS (SELECT max((0.6 * total - whole) / rest) AS s FROM lines WHERE rest > 1e-12),
p AS (SELECT source, lang, topic, least(1.0, s * ratio) AS probability FROM r, s)
SELECT doc_id, source, lang, topic, round(probability, 6) AS probability
FROM docs JOIN p USING (source, lang, topic)
WHERE ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0 < probability"""
    )
    return ",\n".join(steps)


_LEXICAL = r"""WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
),
item_terms AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark)
),
lengths AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::bigint AS terms FROM lengths),
often AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms SEMI JOIN item_terms USING (term) GROUP BY ALL),
held AS (SELECT term, count(*) AS df FROM often GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * df + 1)))::bigint AS w FROM held, totals),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::bigint AS score
  FROM item_terms JOIN often USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10"""

ORACLE: dict[str, str] = {"op3_mixing": _mixing(), "op13_lexical": _LEXICAL}
