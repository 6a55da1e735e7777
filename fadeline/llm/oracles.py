"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import interactions, resample, substring, urls
from .urls import DAMPING, LEAST_DISTRUST, MARGIN, ROUNDS, RULES


def _rule(what: str) -> str:
    cases = []
    for verdict, text in sorted(RULES, key=lambda r: -len(r[1])):
        own, _, rest = text.partition("/")
        cases.append(f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}') THEN '{text if what == 'rule' else verdict}'")
    return f"CASE {' '.join(cases)} END"


_LINK = urls._LINK.replace("'", "''")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP1 = f"""WITH RECURSIVE p AS (SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r AS (SELECT page_id, host, path, {_rule("rule")} AS rule, {_rule("verdict")} AS ruling FROM h),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{_LINK}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM h),
edges AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (ruling = 'allow') AS a, count(*) FILTER (ruling = 'block') AS b FROM r WHERE host <> '' GROUP BY host),
good AS (SELECT host FROM hosts WHERE a > 0 AND b = 0), bad AS (SELECT host FROM hosts WHERE b = n),
steps AS (SELECT walk, src, dst, n / sum(n) OVER (PARTITION BY walk, src) AS w FROM (SELECT 'trust' AS walk, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges)),
seeds AS (SELECT 'trust' AS walk, host FROM good UNION ALL SELECT 'distrust', host FROM bad), sizes AS (SELECT walk, count(*) AS n FROM seeds GROUP BY walk),
walks AS (SELECT 0 AS k, walk, host, CAST(1.0 AS DOUBLE) AS score FROM seeds UNION ALL (
 WITH moved AS (SELECT v.walk, s.dst AS host, sum(s.w * v.score) * {DAMPING} AS score FROM steps s JOIN walks v ON v.walk = s.walk AND v.host = s.src GROUP BY v.walk, s.dst),
 back AS (SELECT z.walk, 1 + ({DAMPING} * (SELECT sum(score) FROM walks v WHERE v.walk = z.walk) - coalesce((SELECT sum(score) FROM moved m WHERE m.walk = z.walk), 0)) / z.n AS score FROM sizes z),
 every AS (SELECT walk, host, score FROM moved UNION ALL SELECT walk, host, score FROM seeds JOIN back USING (walk))
 SELECT (SELECT max(k) FROM walks) + 1, walk, host, sum(score) FROM every WHERE (SELECT max(k) FROM walks) < {ROUNDS} GROUP BY walk, host)),
s AS (SELECT page_id, r.host, path, rule, ruling, CASE WHEN (SELECT count(*) FROM edges) > 0 THEN coalesce(t.score, 0.0) ELSE 0.0 END AS trust, CASE WHEN (SELECT count(*) FROM edges) > 0 THEN coalesce(d.score, 0.0) ELSE 0.0 END AS distrust
FROM r LEFT JOIN walks t ON t.host = r.host AND t.walk = 'trust' AND t.k = {ROUNDS} LEFT JOIN walks d ON d.host = r.host AND d.walk = 'distrust' AND d.k = {ROUNDS})
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN distrust >= {LEAST_DISTRUST} AND distrust > {MARGIN} * trust THEN 'block' ELSE 'allow' END) AS verdict, CAST(trust AS DOUBLE) AS trust, CAST(distrust AS DOUBLE) AS distrust FROM s"""

OP3 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_W = substring.WINDOW
OP5 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, k, array_to_string(list_slice(words, k, k + {_W - 1}), ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - {_W - 2})) AS k FROM w)),
again AS (SELECT win FROM p GROUP BY win HAVING count(*) > 1),
hit AS (SELECT doc_id, k FROM p JOIN again USING (win)),
gone AS (SELECT DISTINCT doc_id, k + j AS pl FROM hit, range(0, {_W}) r(j)),
each_word AS (SELECT doc_id, word, pl FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pl FROM w)),
kept AS (SELECT e.doc_id, count(g.pl) AS n_removed, coalesce(string_agg(e.word, ' ' ORDER BY e.pl) FILTER (g.pl IS NULL), '') AS text FROM each_word e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pl = e.pl GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""

_BITS = ", ".join(f"('{c}', {1 << k})" for k, c in enumerate(interactions.FILTERS))
OP11 = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
f AS (SELECT doc_id, part, CAST(len(words) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INT) + 4 * CAST(100 * (length(text) - length(translate(text, '{_UPPER}', ''))) > 10 * length(text) AS INT)
 + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > first, false) AS INT) AS mask FROM w JOIN firsts USING (text)),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
b(c, bit) AS (VALUES {_BITS}),
orders AS (SELECT p.c || q.c || r.c || s.c || t.c AS o, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM b p, b q, b r, b s, b t WHERE len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5),
steps AS (SELECT o, CAST(k AS INT) AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM orders, range(1, 6) r(k)),
did AS (SELECT part, o AS filter_order, step, bit, sum(n) FILTER (mask & bit = 0 AND mask & before = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed, sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant,
 sum(n) FILTER (mask = bit) AS unique_fails, sum(n_good) FILTER (mask & bit <> 0 AND mask & before = 0) AS good_lost, sum(n_toxic) FILTER (mask & bit <> 0 AND mask & before = 0) AS toxic_lost FROM cells, steps GROUP BY part, o, step, bit)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley FROM did"""

_B = resample.BUCKETS
#: The CRC-32 of each different word, from the table of its polynomial.
OP12 = f"""WITH tab AS (SELECT list(list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), i) ORDER BY i) AS t FROM range(256) r(i)),
each_doc AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
d AS (SELECT row, unnest(words) AS word FROM each_doc),
q AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
h AS (SELECT word, hex(word) AS x FROM (SELECT word FROM d UNION SELECT word FROM q)),
c AS (SELECT word, xor(4294967295, list_reduce(list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) % {_B} AS bucket FROM h, tab),
g AS (SELECT row, bucket FROM d JOIN c USING (word)),
s AS (SELECT bucket, count(*) AS s FROM g GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM q JOIN c USING (word) GROUP BY bucket),
gain AS (SELECT b AS bucket, floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT count(*) FROM g) + {_B}) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * ((SELECT count(*) FROM q) + {_B}) AS DOUBLE))) AS gain FROM range({_B}) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
m AS (SELECT row, floor(sum(gain) / count(*)) AS weight FROM g JOIN gain USING (bucket) GROUP BY row),
u AS (SELECT row, doc_id, len(words) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('{resample.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM each_doc LEFT JOIN m USING (row)),
v AS (SELECT row, doc_id, n, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM u),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n_all FROM v WHERE n >= {resample.LEAST_WORDS})
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN place <= {resample.PERCENT} * n_all // 100 THEN place END AS rank FROM v LEFT JOIN r USING (row)"""

ORACLE_SQL = {"op1_urls": OP1, "op3_topk": OP3, "op5_substring": OP5, "op11_interactions": OP11, "op12_resample": OP12}
