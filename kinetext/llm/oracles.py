"""SQL for DuckDB of the queries that SQL can express, by their definitions rather than by the operators' ways."""

from __future__ import annotations

from kinetext.llm.licenses import PHRASES, TEMPLATES


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({k}, {_quote(label)}, {str(k < len(PHRASES)).lower()}, string_split({_quote(text)}, ' '))" for k, (label, text) in enumerate([*PHRASES, *TEMPLATES]))

LICENSES = rf"""
WITH t(template, label, phrase, w) AS (VALUES {_TEMPLATES}),
tg AS (SELECT template, label, phrase, len(w) - 2 AS grams, i - 1 AS tpos, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM t, unnest(range(1, len(w) - 1)) AS r(i)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
v AS (SELECT doc_id, template, label, phrase, grams, pos - tpos AS diagonal, list(DISTINCT tpos) AS ts, min(pos) AS lo, max(pos) AS hi FROM g JOIN tg USING (a, b, c) GROUP BY ALL),
o AS (SELECT *, CASE WHEN phrase OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > 3 THEN 1 ELSE 0 END AS opens FROM v),
s AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM o),
m AS (SELECT doc_id, template, label, phrase, grams, span, len(list_distinct(flatten(list(ts)))) AS n, min(lo) AS lo, max(hi) AS hi FROM s GROUP BY ALL),
x AS (SELECT *, n / grams AS coverage, CASE WHEN phrase THEN n = grams ELSE n / grams >= 0.5 AND n >= 0.5 * (hi - lo + 1) END AS stands FROM m),
r AS (SELECT doc_id, count(*) FILTER (stands AND phrase) AS n_base, min(lo) FILTER (stands AND phrase) AS first_word, max(lo) FILTER (stands AND phrase) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (stands AND phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (stands) AS labels, max(coverage) AS score FROM x GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)"""

_CONTROL = r"([<\[])(\\*)(\|(?:turn|end|image|audio|document)\|>|/?s>|/?INST\]|/?SYS\])"

CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
l AS (SELECT *, 8 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '{_CONTROL}')) + 8 AS n FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM l GROUP BY conv_id"""

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
c AS (SELECT doc_id, unnest(range(i, i + 35)) AS i FROM r),
x AS (SELECT doc_id, count(DISTINCT i) AS n, list(DISTINCT i) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(coalesce(gone, []::BIGINT[]), k)), lambda k: w[k]), ' '), '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)"""

# All pairs of vectors, and what links reach; the index may miss a link, this doesn't.
NEIGHBOURS = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, component_id, component_id = vec_id AS kept FROM embeddings JOIN c ON c.a = vec_id"""

# Bytes as pairs of hex digits. Starts of repeated windows make runs, and what lies between the runs is kept.
SUFFIXES = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS k FROM (SELECT doc_id, h, unnest(range(greatest(len(h) // 2 - 99, 0))) AS i FROM d)),
m AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g SEMI JOIN m USING (k)) WHERE n > 1),
o AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 100 THEN 0 ELSE 1 END AS opens FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o) GROUP BY doc_id, span),
x AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM p GROUP BY doc_id),
q AS (SELECT doc_id, a, b FROM p UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM d),
s AS (SELECT doc_id, a AS till, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS since FROM q),
t AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (till - since)), '' ORDER BY since, till) AS kept FROM s JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN t USING (doc_id) LEFT JOIN x USING (doc_id)"""

# A shingle at p counts for the windows that reach it and don't hold as many earlier ones of its kind as the item has (the latest of those at q).
LEAKS = r"""
WITH i AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
ig AS (SELECT item_id, n, k, g, count(*) AS c FROM (SELECT item_id, n, k, array_to_string(w[x:x + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, n - k + 2)) AS x FROM i)) GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT doc_id, z, k, x - 1 AS p, array_to_string(w[x:x + k - 1], ' ') AS g FROM (SELECT doc_id, w, len(w) AS z, k, unnest(range(1, len(w) - k + 2)) AS x FROM d, (SELECT DISTINCT k FROM i))),
h AS (SELECT doc_id, item_id, z, n, k, p, c, g, row_number() OVER (PARTITION BY doc_id, item_id, g ORDER BY p) AS r, least(n, z) - k + 1 AS m, greatest(z - n, 0) AS last FROM dg JOIN ig USING (k, g)),
e AS (SELECT h.doc_id, h.item_id, h.n - h.k + 1 AS bag, h.m, unnest(range(greatest(coalesce(q.p, -1) + 1, h.p - h.m + 1, 0), least(h.p, h.last) + 1)) AS a FROM h LEFT JOIN h q ON q.doc_id = h.doc_id AND q.item_id = h.item_id AND q.g = h.g AND q.r = h.r - h.c),
s AS (SELECT doc_id, item_id, a, count(*) / (m + bag - count(*)) AS similarity FROM e GROUP BY doc_id, item_id, a, m, bag)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(a, {'s': -similarity, 'a': a})::BIGINT AS first_word FROM s WHERE similarity >= 0.8 GROUP BY doc_id, item_id"""

ORACLES = {"op2_licenses": LICENSES, "op4_chat_formatting": CHAT, "op5_substring_dedup": SUBSTRINGS, "op6_multi_index": NEIGHBOURS, "op8_decontamination": LEAKS, "op10_suffix_dedup": SUFFIXES}
