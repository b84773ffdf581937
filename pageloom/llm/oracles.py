"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from pageloom.llm.urlrules import DEFAULT, RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TEST_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH d AS (SELECT doc_id, {_TEST_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_TEST_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 10], ' ') AS phrase, len(w[s + 1 : s + 10]) AS n FROM bw),
ds AS (SELECT doc_id, w, unnest(range(0, len(w))) AS s FROM d),
dw AS (SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS phrase FROM ds, (SELECT DISTINCT n FROM p) WHERE s + n <= len(w)),
h AS (SELECT dw.doc_id, dw.s, dw.n, p.item_id FROM dw JOIN p ON dw.phrase = p.phrase AND dw.n = p.n),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ws AS (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS s FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s + 1 : s + 20], ' ') ORDER BY doc_id, s) AS r FROM ws),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos FROM k WHERE r > 1),
words AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM d),
kept AS (SELECT a.doc_id, count(*) AS n, string_agg(a.word, ' ' ORDER BY a.pos) AS txt FROM words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.pos = g.pos WHERE g.pos IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.txt, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_RULE_ROWS = ", ".join(f"('{v}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in RULES)

OP6 = f"""
WITH u AS (SELECT page_id, coalesce({_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES {_RULE_ROWS}) t(verdict, rule, rhost, rpath)),
m AS (SELECT u.page_id, u.host, u.path, r.rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rule) DESC NULLS LAST, r.rule DESC) AS n
      FROM u LEFT JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM m WHERE n = 1
"""

#: crc32 of a text, byte by byte over the table of its polynomial.
_CRC = """(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"""

OP13 = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1))) AS crc_table),
d AS (SELECT doc_id, {_TEST_WORDS} AS w FROM documents),
b AS (SELECT {_TEST_WORDS} AS w FROM benchmark),
df AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d) GROUP BY ALL),
bf AS (SELECT f, count(*) AS n FROM (SELECT unnest(w) AS f FROM b UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b) GROUP BY ALL),
h AS (SELECT f, xor({_CRC.format("f")}, 4294967295) % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), crc),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN h USING (f) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS t FROM bf JOIN h USING (f) GROUP BY bucket),
tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM df) AS sn, (SELECT coalesce(sum(n), 0) FROM bf) AS tn),
g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * (sn + 10000))::DOUBLE / ((s + 1) * (tn + 10000))::DOUBLE)) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), tot),
k AS (SELECT doc_id, sum(n) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY doc_id),
w AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_features, CAST(coalesce((total - ((total % k.n) + k.n) % k.n) // k.n, 0) AS BIGINT) AS weight,
    ('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN k ON d.doc_id = k.doc_id),
sc AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_words >= 20)
SELECT sc.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM sc LEFT JOIN r ON sc.doc_id = r.doc_id
"""

OP11 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pw AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
st AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pw),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM st, range(1, 6) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM pw GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inside AS (SELECT lang, array_to_string(w[i : i + j - 1], ' ') AS phrase, max(a) AS within FROM c, range(1, 5) t(i), range(2, 5) u(j) WHERE j < k AND i + j - 1 <= k GROUP BY ALL),
cut AS (SELECT c.lang, c.phrase, a, x, n, array_to_string(w[1 : x], ' ') AS first, array_to_string(w[x + 1 : k], ' ') AS rest
        FROM c LEFT JOIN inside USING (lang, phrase) JOIN n USING (lang), range(1, 5) t(x) WHERE x < k AND (within IS NULL OR within < a)),
sc AS (SELECT cut.lang, cut.phrase, a, x, l.f AS l, r.f AS r, n, (1000::HUGEINT * a::HUGEINT * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
       FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = cut.first JOIN f r ON r.lang = cut.lang AND r.phrase = cut.rest),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) AS o FROM sc),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM top WHERE rank <= 2000
"""

ORACLES = {"op4_decontaminate": OP4, "op5_substring_dedup": OP5, "op6_url_rules": OP6, "op11_collocations": OP11, "op13_importance_resample": OP13}
