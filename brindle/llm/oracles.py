"""DuckDB SQL for the queries that SQL can express, written apart from the operators but for fixed values and formulas."""

from __future__ import annotations

import re

from . import quality_rules, url_reputation, warc_index
from .common import LOWER, UPPER
from .stats_sql import digamma, trigamma


def _plain(sql: str) -> str:
    """Without the suffix of double literals."""
    return re.sub(r"(\d)D\b", r"\1::DOUBLE", sql)


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def op2() -> str:
    tests, picks = [], []
    for rule, (metric, grid) in quality_rules.RULES.items():
        for i, cut in enumerate(grid):
            tests.append(f"SELECT '{rule}' AS rule, {i} AS i, {cut}::DOUBLE AS cut, s, count(*) AS n, count(*) FILTER ({metric} > {cut}) AS k FROM good GROUP BY s")
        picks.append(f"coalesce({metric} > (SELECT min(cut) FROM chosen c WHERE c.s = f.s AND c.rule = '{rule}'), false)")
    rate = quality_rules.RULE_RISK
    tail = f"list_sum([exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate}) + (n - j) * ln({1 - rate})) FOR j IN range(k + 1)])"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS s, coalesce(text, '') AS text, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS win FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM w) WHERE c > 1),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS p FROM again) GROUP BY r),
f AS (SELECT doc_id, s, len(ws) AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines FROM d LEFT JOIN cover USING (r)),
fb AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
m AS (SELECT doc_id, max(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
good AS (SELECT fb.* FROM fb JOIN m USING (doc_id) WHERE good AND NOT base_failed),
t AS ({" UNION ALL ".join(tests)}),
p AS (SELECT *, CASE WHEN k >= n * {rate} THEN 1 ELSE {tail} END <= {quality_rules.LEVEL} / ((SELECT count(DISTINCT s) FROM good) * {len(quality_rules.RULES)}) AS ok FROM t),
chosen AS (SELECT rule, s, cut FROM (SELECT *, bool_and(ok) OVER (PARTITION BY rule, s ORDER BY i) AS so_far FROM p) WHERE so_far)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(picks)}) AS kept FROM fb f"""


def op4() -> str:
    u = url_reputation
    cases = []
    for rule in sorted(u.RULES, key=len, reverse=True):
        host, path = rule.split("/", 1)
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule}'")
    listed = lambda names: "[" + ", ".join(f"'{n}'" for n in sorted(names)) + "]"
    exact, parents, exceptions = (listed(names) for names in u.parse_suffixes(u.SUFFIXES))
    tail = lambda m: f"array_to_string(l[-{m}:], '.')"
    depth = " ".join(f"WHEN len(l) >= {m} AND list_contains({exceptions}, {tail(m)}) THEN {m - 1}" for m in range(u.LABELS, 0, -1))
    depth += " " + " ".join(f"WHEN len(l) >= {m} AND (list_contains({exact}, {tail(m)}) OR list_contains({parents}, {tail(m - 1) if m > 1 else repr('')})) THEN {m}" for m in range(u.LABELS, 0, -1))
    strength = (
        f"CASE WHEN coalesce(n, 0) = 0 THEN {u.UNKNOWN} WHEN k = 0 OR k = n THEN {u.STRONGEST}"
        f" ELSE least(greatest(1 / greatest(((q - k * k / n) / (k / n * (1 - k / n)) - (c - 1)) / greatest(n - c, 1), 1e-9) - 1, {u.WEAKEST}), {u.STRONGEST}) END"
    )
    up = "sum(n) AS n, sum(k) AS k, count(*) FILTER (n > 0) AS c, coalesce(sum(k * k / n) FILTER (n > 0), 0) AS q"
    a, b = "(k + ds * dm)", "(n - k + ds * (1 - dm))"
    logit = _plain(f"{digamma(a)} - {digamma(b)} - {u.BOUND_Z} * sqrt({trigamma(a)} + {trigamma(b)})")
    blocked = ", ".join(f"'{r}'" for r, v in u.RULES.items() if v == "block")
    return rf"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{u.URL}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{u.URL}', 2) AS path FROM pages),
r AS (SELECT *, CASE {" ".join(cases)} END AS rule, TRY_CAST(nullif(regexp_extract(path, '/([0-9]+)(?:[.]html)?/?$', 1), '') AS BIGINT) AS doc FROM p),
m AS (SELECT doc_id, min(quality) = 0 AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') AS name, string_split(name, '.') AS l, CASE {depth} ELSE 1 END AS m, regexp_matches(name, '{u.ADDRESS}') AS address, count(bad)::DOUBLE AS n, count(*) FILTER (bad)::DOUBLE AS k FROM r LEFT JOIN m ON doc = doc_id GROUP BY host),
h AS (SELECT host, n, k, CASE WHEN address THEN name ELSE array_to_string(l[-(m + 1):], '.') END AS domain, CASE WHEN address THEN '#' ELSE array_to_string(l[-m:], '.') END AS suffix FROM h0),
d AS (SELECT domain, suffix, {up} FROM h GROUP BY ALL), s AS (SELECT suffix, {up} FROM d GROUP BY ALL), g AS (SELECT {up} FROM s),
gs AS (SELECT coalesce(k, 0) + 0.5 AS ga, coalesce(n, 0) + 1 AS gb, {strength} AS gk FROM g),
ss AS (SELECT suffix, (k + gk * ga / gb) / (n + gk) AS sm, {strength} AS sk FROM s, gs),
dd AS (SELECT domain, (k + sk * sm) / (n + sk) AS dm, {strength} AS ds FROM d JOIN ss USING (suffix)),
b AS (SELECT host, n, k, 1 / (1 + exp(-({logit}))) > {u.BAD_SHARE} AS blocked FROM h JOIN dd USING (domain))
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE WHEN rule IN ({blocked}) THEN 'block' ELSE 'allow' END WHEN blocked THEN 'block' ELSE 'allow' END AS verdict, n::BIGINT AS host_labelled, k::BIGINT AS host_bad FROM r LEFT JOIN b USING (host)"""


def op6() -> str:
    return rf"""WITH a AS (SELECT dense_rank() OVER (ORDER BY doc_id NULLS FIRST, ('0x' || substring(md5(coalesce(text, '')), 1, 15))::BIGINT) AS r, doc_id, {_WORDS} AS ws FROM documents),
d AS (SELECT DISTINCT r, ws FROM a),
w AS (SELECT r, i, array_to_string(ws[i:i + 19], ' ') AS win FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY win ORDER BY r, i) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 19)) AS pos FROM again),
kept AS (SELECT t.r, string_agg(word, ' ' ORDER BY t.pos) AS text FROM (SELECT r, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos FROM d) t LEFT JOIN gone ON t.r = gone.r AND t.pos = gone.pos WHERE gone.r IS NULL GROUP BY t.r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM a LEFT JOIN n USING (r) LEFT JOIN kept USING (r)"""


def op9() -> str:
    letters = " || ".join(
        f"substring('{warc_index.ALPHABET}', ((('0x' || substring(h, {5 * g + 1}, 5))::BIGINT >> {15 - 5 * j}) & 31)::INT + 1, 1)" for g in range(8) for j in range(4)
    )
    return rf"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS kept, {letters} AS digest, substring(url, position('://' IN url) + 3) AS rest FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to,
CASE WHEN contains(url, '://') THEN array_to_string(list_reverse(string_split(lower(split_part(rest, '/', 1)), '.')), ',') || ')' || lower(substring(rest, length(split_part(rest, '/', 1)) + 1)) ELSE lower(url) END AS urlkey, {warc_index.EPOCH} + page_id AS captured FROM r"""


def op13() -> str:
    share = lambda n, total: f"1 + ((1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * terms))::BIGINT"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(terms, 0) AS terms FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, terms FROM l) USING (lang)),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "g.total")} AS p, q FROM g JOIN (SELECT lang, term, {share("n", "total")} AS q FROM kept JOIN l USING (lang)) k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""


def _ints(scale: int) -> str:
    usable = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"SELECT *, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings WHERE {usable}"


def op11() -> str:
    product = "list_dot_product(a.v, b.v)::BIGINT"
    return f"""WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM ({_ints(256)}) WHERE label IS NOT NULL),
s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, {product} AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id) AS n FROM s WHERE same) WHERE n <= 5),
c AS (SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, s.other_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor, n ORDER BY s.score DESC, s.other_id)::INT AS rank FROM p JOIN s USING (anchor)
WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM c WHERE rank <= 3"""


def op12() -> str:
    return f"""WITH e AS (SELECT row_number() OVER () AS r, vec_id, v FROM ({_ints(64)})),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 20 = 0),
k AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT * FROM k WHERE rank <= 20"""
