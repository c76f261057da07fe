"""DuckDB twins of the numbered queries that SQL can express."""

from __future__ import annotations

from revlens.llm.quality import ALPHA, DELTA, MIN_WORDS, RULES
from revlens.llm.queries import SHARDS
from revlens.llm.sharding import SLOTS, lookup_table

_WORDS = r"[x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']"

_OP4 = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1) GROUP BY r),
l AS (SELECT r, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM w),
c AS (SELECT w.doc_id, w.stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w JOIN l USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
lab AS (SELECT doc_id, min(quality) = 1 AND max(coalesce(toxic, 0)) = 0 AS clean, min(quality) = 0 AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
rules(rule, cutoff) AS (VALUES {", ".join(f"('{r}', {c})" for r, (_, _, cuts) in RULES.items() for c in cuts)}),
hits AS (SELECT stratum, rule, cutoff, clean, bad, CASE rule {" ".join(f"WHEN '{r}' THEN 1000 * {a} > cutoff * {b}" for r, (a, b, _) in RULES.items())} END AS hit
         FROM (SELECT DISTINCT * FROM f) JOIN lab USING (doc_id), rules WHERE NOT base_failed AND (clean OR bad)),
t AS (SELECT stratum, rule, cutoff, count(*) FILTER (WHERE clean) AS n, count(*) FILTER (WHERE clean AND hit) AS k, count(*) FILTER (WHERE bad AND hit) AS caught FROM hits GROUP BY ALL),
tail AS (SELECT stratum, rule, cutoff, any_value(caught - k) AS gain, count(*) OVER () AS unused,
                sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA / len(RULES)}) + (n - i) * ln(1 - {ALPHA / len(RULES)}))) AS p
         FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM t WHERE n > 0 AND caught > k) GROUP BY stratum, rule, cutoff),
best AS (SELECT stratum, rule, arg_max(cutoff, gain * 100000 + cutoff) AS cut FROM tail WHERE p <= {DELTA} / (SELECT count(*) FROM t) GROUP BY stratum, rule),
cut AS (SELECT stratum, {", ".join(f"max(cut) FILTER (WHERE rule = '{r}') AS cut_{r}" for r in RULES)} FROM best GROUP BY stratum)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT ({" OR ".join(f"coalesce(1000 * {a} > cut_{r} * {b}, false)" for r, (a, b, _) in RULES.items())}) AS kept
FROM f LEFT JOIN cut USING (stratum)"""

_OP10 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM win) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM hit)),
cover AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_NAMES = sorted(SHARDS)
_TABLE = ",".join(str(_NAMES.index(x)) for x in lookup_table(SHARDS))

_OP5 = f"""
WITH s AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15)) AS BIGINT) % {SLOTS} AS slot FROM documents),
t AS (SELECT string_split('{_TABLE}', ',') AS shards)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, 'shard-' || lpad(shards[slot + 1], 3, '0') AS shard FROM s, t"""

SQL: dict[str, str] = {"op4_quality": _OP4, "op5_sharding": _OP5, "op10_substring": _OP10}
