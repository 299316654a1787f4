"""DuckDB SQL for the queries that SQL expresses on whole tables."""

from __future__ import annotations

from newsloom.llm import license_scan, line_dedup, mixing, quality_rules
from newsloom.llm.license_texts import KNOWN_DIGESTS, KNOWN_TEXTS

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), {_quoted(license_scan.COPYRIGHT_LINE)}, ' ', 'g')"
    for left, right in license_scan.EQUIVALENT:
        out = f"replace({out}, {_quoted(left)}, {_quoted(right)})"
    return f"trim(regexp_replace({out}, {_quoted(license_scan.PUNCTUATION)}, ' ', 'g'))"


_KNOWN = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(KNOWN_TEXTS.items()))
_DIGESTS = ", ".join(f"('{g}', '{k}')" for k, g in sorted(KNOWN_DIGESTS.items()))

OP1 = f"""
WITH listed AS (SELECT sha256({_canonical("text")}) AS g, license_id FROM (VALUES {_KNOWN}) k(license_id, text) UNION ALL FROM (VALUES {_DIGESTS})),
known AS (SELECT g, min(license_id) AS license_id FROM listed GROUP BY g)
SELECT doc_id, g AS text_digest, license_id, license_id IS NOT NULL AS is_license
FROM (SELECT doc_id, sha256({_canonical("text")}) AS g FROM documents) LEFT JOIN known USING (g)
"""

_SIM = 0.98
OP3 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= {_SIM}),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, p.b FROM reach r JOIN pair p ON p.a = r.seen),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n_links FROM pair GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN comp ON node = vec_id LEFT JOIN n ON n.a = vec_id
"""


def _quality() -> str:
    rules = {
        "symbols": "n_symbols * 10000 // greatest(word_chars, 1)",
        "dup_lines": "n_dup_lines * 10000 // greatest(n_words, 1)",
        "repeats": "n_repeat_words * 10000 // greatest(n_words, 1)",
        "word_length": "word_chars * 100 // greatest(n_words, 1)",
    }
    values = ", ".join(f"{v} AS {k}" for k, v in rules.items())
    long = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, {k} AS value FROM valued WHERE NOT base_failed" for k in rules)
    least = "CASE rule " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in quality_rules.RULES.items()) + " END"
    top = lambda c: f"CASE WHEN {c} < 64 THEN {c} ELSE (({c} - (({c} - 32) // 32) * 32 + 1) << (({c} - 32) // 32)::INTEGER) - 1 END"
    sketch = lambda name, keys: f"""{name} AS (SELECT {keys} rule, max(total) AS total, min(CASE WHEN upto * 100 >= total * 50 THEN bucket END) AS mid, min(CASE WHEN upto * 100 >= total * 75 THEN bucket END) AS upper FROM (
      SELECT {keys} rule, bucket, sum(n) OVER (PARTITION BY {keys} rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys} rule) AS total
      FROM (SELECT {keys} rule, bucket, count(*) AS n FROM bucketed GROUP BY ALL)) GROUP BY ALL),
    {name}_top AS (SELECT {keys} rule, total, greatest({top("upper")} + {quality_rules.REACH} * ({top("upper")} - {top("mid")}), {top("mid")} + {least}) AS top FROM {name})"""  # noqa: E731
    limits = ", ".join(f"max(CASE WHEN rule = '{k}' THEN t END) AS top_{k}" for k in rules)
    over = " OR ".join(f"coalesce({k} > top_{k}, FALSE)" for k in rules)
    return f"""
WITH split AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents),
grams AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS pos, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM split WHERE len(w) >= 3)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM grams WHERE n > 1) GROUP BY doc_id),
counts AS (SELECT s.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM split s LEFT JOIN covered c USING (doc_id)),
valued AS (SELECT *, {values}, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
bucketed AS (SELECT lang, source, rule, CASE WHEN value < 64 THEN value ELSE (length(bin(value)) - 6) * 32 + (value >> (length(bin(value)) - 6)::INTEGER) END AS bucket FROM ({long})),
{sketch("own", "lang, source,")}, {sketch("bylang", "lang,")}, {sketch("overall", "")},
limits AS (SELECT o.lang, o.source, o.rule, CASE WHEN o.total >= {quality_rules.LEAST_ROWS} THEN o.top WHEN b.total >= {quality_rules.LEAST_ROWS} THEN b.top ELSE a.top END AS t
  FROM own_top o JOIN bylang_top b ON o.lang IS NOT DISTINCT FROM b.lang AND o.rule = b.rule JOIN overall_top a ON a.rule = o.rule),
wide AS (SELECT lang, source, {limits} FROM limits GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept
FROM valued v LEFT JOIN wide w ON v.lang IS NOT DISTINCT FROM w.lang AND v.source IS NOT DISTINCT FROM w.source
"""


def _mixing() -> str:
    weights = list(mixing.WEIGHTS)
    return f"""
WITH sizes AS (SELECT doc_id, source, size, digest, row_number() OVER (PARTITION BY doc_id, source, size, digest) AS copy
  FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size, md5(text) AS digest FROM documents)),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sizes GROUP BY source),
w AS (SELECT source, source_size, {weights}[(k - 1) % {len(weights)} + 1] AS weight, source_size * {mixing.MAX_REPEAT} AS cap FROM per),
o AS (SELECT *, (SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER b, 0) AS left_over, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0) AS left_weight FROM w
  WINDOW b AS (ORDER BY cap / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT left_over::DOUBLE / left_weight::DOUBLE AS level FROM o WHERE NOT weight * left_over > cap * left_weight ORDER BY left_weight DESC LIMIT 1),
target AS (SELECT source, source_size, CASE WHEN weight * left_over > cap * left_weight THEN cap::DOUBLE ELSE weight * level END AS target FROM o LEFT JOIN level ON TRUE),
rate AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM target)
SELECT doc_id, size, source_size, target, (CAST(floor(rate) AS BIGINT) + CASE WHEN ('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(digest, 'null') || ':' || copy), 1, 13))::UBIGINT::DOUBLE / {float(2**52)} < rate - floor(rate) THEN 1 ELSE 0 END) * size AS taken
FROM sizes s JOIN rate r ON s.source IS NOT DISTINCT FROM r.source
"""


OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 100 = 0),
positive AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER best <= 10
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP13 = f"""
WITH line AS (SELECT r, doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS k FROM line),
often AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= {line_dedup.LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {line_dedup.LEAST_DOCS}),
judged AS (SELECT r, doc_id, pos, line, (o.k IS NOT NULL AND doc_id IS DISTINCT FROM last) AS dropped FROM keyed LEFT JOIN often o USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM judged GROUP BY r
"""


ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": OP1,
    "op3_embedding_dedup": OP3,
    "op4_quality_rules": _quality(),
    "op8_mixing": _mixing(),
    "op11_hard_negatives": OP11,
    "op13_line_dedup": OP13,
}
