"""SQL for DuckDB that gives the rows of the operators' queries, where SQL can express them."""

_DOC_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_MASKED = r"list_transform(list_filter(string_split(regexp_replace(raw, '[ \t\x0B\f\r]+', ' ', 'g'), ' '), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END)"


def _crc32(text: str) -> str:
    """The checksum of a string's bytes, four bits a step by a table that follows from the polynomial."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    halves = f"list_transform(regexp_extract_all(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), '.'), lambda h: (strpos('0123456789ABCDEF', h) - 1)::BIGINT)"
    step = f"xor(list_extract({[*table]}::BIGINT[], (xor(c, h) & 15) + 1), c >> 4)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda c, h: {step}), 4294967295)"


_SPACED = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _discounts(n: int) -> str:
    """Factors of the counts 1 to 5 of n-grams, from ``c{n}`` (their counts): Good-Turing, or half a count off."""
    factors = ", ".join(f"({r + 1} * n{r + 1} / nullif({r} * n{r}, 0) - rest) / nullif(1 - rest, 0)" for r in range(1, 6))
    return f"""m{n} AS (SELECT {', '.join(f'count(*) FILTER (c = {r})::DOUBLE AS n{r}' for r in range(1, 7))} FROM c{n}),
f{n} AS (SELECT [{factors}] AS d FROM (SELECT *, 6 * n6 / nullif(n1, 0) AS rest FROM m{n})),
d{n} AS (SELECT CASE WHEN len(list_filter(d, lambda x: x > 0 AND x < 1)) = 5 AND (SELECT n1 * n2 * n3 * n4 * n5 * n6 > 0 FROM m{n}) THEN d ELSE [0.5, 0.75, 2.5 / 3, 0.875, 0.9] END AS d FROM f{n})"""


def _level(n: int, history: str, lower: str) -> str:
    """Divisors (``total``), weights and probabilities of the n-grams of one order."""
    return f"""{_discounts(n)},
t{n} AS (SELECT *, CASE WHEN c <= 5 THEN list_extract((SELECT d FROM d{n}), c::INTEGER) ELSE 1 END * c AS kept FROM c{n}),
h{n} AS (SELECT {history}, sum(c) AS c, sum(kept) AS used FROM c{n} JOIN t{n} USING ({history}, w, c) GROUP BY {history}),
w{n} AS (SELECT {history}, c + CASE WHEN c - used <= 1e-9 THEN 0.5 ELSE 0 END AS total, used FROM h{n}),
p{n} AS (SELECT {history}, w, kept / total AS p FROM t{n} JOIN w{n} USING ({history})),
a{n} AS (SELECT {history}, (1 - any_value(used) / any_value(total)) / (1 - sum(low.p)) AS alpha FROM w{n} JOIN c{n} USING ({history}) JOIN {lower} GROUP BY {history})"""


ORACLES = {
    "op1_line_template_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line FROM d WHERE text IS NOT NULL),
m AS (SELECT r, line, raw, {_MASKED} AS t FROM l),
o AS (SELECT DISTINCT r, t, len(t) AS n, t[1:3] AS leaf FROM m WHERE len(t) > 0),
leaves AS (SELECT n, leaf, count(DISTINCT r) AS total, count(DISTINCT t) AS kinds FROM o GROUP BY n, leaf HAVING count(DISTINCT r) >= 3),
c AS (SELECT o.*, total, kinds FROM o JOIN leaves USING (n, leaf)),
alone AS (SELECT DISTINCT t FROM c WHERE kinds = 1 AND len(list_filter(t, lambda x: x <> '<*>')) >= 0.5 * n),
tok AS (SELECT n, leaf, pos, t[pos] AS token, count(DISTINCT r) AS s FROM c, unnest(range(1, n + 1)) AS u(pos) WHERE kinds > 1 AND t[pos] <> '<*>' GROUP BY ALL HAVING count(DISTINCT r) >= 3),
lines AS (SELECT DISTINCT t, n, leaf, total FROM c WHERE kinds > 1),
marked AS (SELECT lines.t, lines.n, lines.leaf, share, list(CASE WHEN s >= greatest(3, share * total) THEN tok.token END ORDER BY u.pos) AS x
           FROM lines CROSS JOIN (VALUES (0.0), (0.1), (0.5)) AS v(share) CROSS JOIN unnest(range(1, n + 1)) AS u(pos)
           LEFT JOIN tok ON tok.n = lines.n AND tok.leaf = lines.leaf AND tok.pos = u.pos AND tok.token = lines.t[u.pos] GROUP BY lines.t, lines.n, lines.leaf, share),
fit AS (SELECT * FROM marked WHERE len(list_filter(x, lambda y: y IS NOT NULL)) >= 0.5 * n
        AND (share = 0 OR (n > 3 AND len(list_filter(x[4:], lambda y: y IS NOT NULL)) >= 0.5 * (n - 3)))),
often AS (SELECT share, n, leaf, x FROM fit JOIN c USING (t, n, leaf) GROUP BY ALL HAVING count(DISTINCT r) >= 3),
gone AS (SELECT t FROM alone UNION SELECT t FROM fit JOIN often ON fit.share = often.share AND fit.n = often.n AND fit.leaf = often.leaf AND fit.x IS NOT DISTINCT FROM often.x),
k AS (SELECT r, count(*) AS n_lines, count(*) FILTER (m.t IN (SELECT t FROM gone)) AS n_dropped,
      coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (m.t NOT IN (SELECT t FROM gone)), '') AS kept FROM m GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)""",
    "op2_katz_backoff": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_crc32("doc_id::VARCHAR")} % 7 = 2, false) AS held_out, ['<s>'] || list_transform({_SPACED.format(t=_LOWER)}, lambda x: '=' || x) || ['</s>'] AS x FROM documents),
s AS (SELECT r, held_out, i, x[i - 2] AS u, x[i - 1] AS v, x[i] AS w FROM d, unnest(range(2, len(x) + 1)) AS q(i)),
c1 AS (SELECT w, count(*) AS c FROM s WHERE NOT held_out GROUP BY w),
{_discounts(1)},
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS types FROM c1),
t1 AS (SELECT w, c, CASE WHEN c <= 5 THEN list_extract((SELECT d FROM d1), c::INTEGER) ELSE 1 END * c AS kept FROM c1),
z AS (SELECT n, types, sum(kept) / n AS mass, greatest(1 - sum(kept) / n, 0.5 / n) AS rest FROM t1, n GROUP BY n, types),
p1 AS (SELECT w, (1 - rest) / mass * kept / n AS p FROM t1, z),
c2 AS (SELECT v, w, count(*) AS c FROM s WHERE NOT held_out GROUP BY v, w),
{_level(2, 'v', 'p1 AS low USING (w)')},
c3 AS (SELECT u, v, w, count(*) AS c FROM s WHERE NOT held_out AND i > 2 GROUP BY u, v, w),
{_level(3, 'u, v', 'p2 AS low USING (v, w)')},
e AS (SELECT s.r, c1.c AS c, coalesce(p3.p, coalesce(a3.alpha, 1) * coalesce(p2.p, coalesce(a2.alpha, 1) * coalesce(p1.p, (SELECT rest FROM z)))) AS p
      FROM s LEFT JOIN c1 ON s.w = c1.w LEFT JOIN p1 ON s.w = p1.w LEFT JOIN p2 ON s.v = p2.v AND s.w = p2.w LEFT JOIN a2 ON s.v = a2.v
      LEFT JOIN p3 ON i > 2 AND s.u = p3.u AND s.v = p3.v AND s.w = p3.w LEFT JOIN a3 ON i > 2 AND s.u = a3.u AND s.v = a3.v)
SELECT any_value(doc_id) AS doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, (SELECT n FROM n) AS train_tokens,
       sum(log10((coalesce(c, 0) + 1) / ((SELECT n + types + 1 FROM n)::DOUBLE))) AS base_score, sum(log10(p)) AS score FROM e JOIN d USING (r) GROUP BY r""",
    "op3_byte_prefix_shards": f"""
WITH s AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, size, crc) AS r, * FROM (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size, {_crc32("coalesce(text, '')")} AS crc FROM documents)),
p AS (SELECT *, sum(size) OVER (ORDER BY r)::HUGEINT AS upto, sum(size) OVER ()::HUGEINT AS total FROM s),
h AS (SELECT *, least(23, ((2 * upto - size) * 24) // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY r) - 1 AS slot, NULL::INTEGER AS grown_shard FROM h""",
    "op4_prefix_free_repeats": """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, o) AS r, doc_id, x, length(x) // 2 AS n FROM (SELECT row_number() OVER () AS o, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents)),
w AS (SELECT r, s, md5(substr(x, 2 * s + 1, 200)) AS k FROM d, unnest(range(0, n - 99)) AS u(s)),
f AS (SELECT k, min(r * 1000000000000 + s) AS first FROM w GROUP BY k HAVING count(*) > 1),
again AS (SELECT r, s FROM w JOIN f USING (k) WHERE r * 1000000000000 + s > first),
b AS (SELECT r, s, coalesce(s - lag(s) OVER (PARTITION BY r ORDER BY s) > 100, true) AS new FROM again),
i AS (SELECT r, min(s) AS lo, max(s) + 100 AS hi FROM (SELECT *, sum(new::INTEGER) OVER (PARTITION BY r ORDER BY s) AS g FROM b) GROUP BY r, g),
e AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM i),
k AS (SELECT r, sum(hi - lo)::BIGINT AS gone, count(*) AS spans, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS kept FROM e JOIN d USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (r)""",
    "op5_prefix_filtered_decontamination": rf"""
WITH d AS (SELECT doc_id, {_DOC_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_DOC_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s + 1 : s + least(10, len(w))], ' ') AS t
       FROM i, unnest(range(0, greatest(1, len(w) - 9))) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS t FROM d, sizes, unnest(range(0, len(w) - n + 1)) AS u(s)),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.t = iw.t AND dw.n = iw.n),
hits AS (SELECT doc_id, count(DISTINCT s + k) AS n_hit FROM hit, unnest(range(0, n)) AS u(k) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op6_host_trust": r"""
WITH RECURSIVE u AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
     coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
     WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM u),
v AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule FROM r),
l AS (SELECT host AS a, translate(unnest(list_distinct(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"''\s>]*)', 1))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS b FROM u WHERE html IS NOT NULL),
g AS (SELECT a, b, count(*) AS n FROM l WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b),
e AS (SELECT 'trust' AS side, a, b, n / sum(n) OVER (PARTITION BY a) AS share FROM g UNION ALL SELECT 'distrust', b, a, n / sum(n) OVER (PARTITION BY b) FROM g),
seed AS (SELECT side, host, n / sum(n) OVER (PARTITION BY side) AS s FROM (SELECT CASE by_rule WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS side, host, count(*) AS n FROM v WHERE by_rule IS NOT NULL GROUP BY 1, 2)),
walk AS (SELECT 0 AS k, side, host, s AS x FROM seed
  UNION ALL SELECT k + 1, side, host, sum(x) + any_value(coalesce(s, 0)) * (1 - any_value(flow)) FROM (
    SELECT m.*, sum(x) OVER (PARTITION BY side) AS flow, seed.s FROM (
      SELECT k, side, b AS host, 0.85 * sum(x * share) AS x FROM walk JOIN e USING (side) WHERE walk.host = e.a GROUP BY k, side, b
      UNION ALL SELECT k, side, seed.host, 0 FROM (SELECT DISTINCT k, side FROM walk) JOIN seed USING (side)) AS m LEFT JOIN seed USING (side, host)) WHERE k < 300 AND (SELECT count(*) FROM g) > 0 GROUP BY k, side, host),
score AS (SELECT host, coalesce(sum(x) FILTER (side = 'trust'), 0) AS t, coalesce(sum(x) FILTER (side = 'distrust'), 0) AS d FROM walk WHERE k = (SELECT max(k) FROM walk) GROUP BY host)
SELECT page_id, v.host, path, rule, coalesce(by_rule, CASE WHEN d > 0 AND d > 0.5 * (t + d) THEN 'block' ELSE 'allow' END) AS verdict FROM v LEFT JOIN score ON v.host = score.host""",
    "op8_rotated_codes": """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
ok AS (SELECT vec_id, v FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT reach.x, p.y FROM reach JOIN p ON reach.y = p.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN c ON c.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id""",
    "op9_temperature_mixing": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, greatest(1, len({_SPACED.format(t="coalesce(text, '')")}))::BIGINT AS tokens, md5(coalesce(text, '')) AS h, count(*) AS copies FROM documents GROUP BY ALL),
s AS (SELECT source, coalesce('=' || source, 'null') AS name, sum(tokens * copies)::BIGINT AS n, count(*) AS rows FROM d GROUP BY source),
z AS (SELECT count(*) AS k, max(n)::DOUBLE AS big, min(n)::DOUBLE AS small, sum(n)::DOUBLE AS total FROM s),
b AS (SELECT 0 AS round, 0::DOUBLE AS lo, 1::DOUBLE AS hi
  UNION ALL SELECT round + 1, found, least(1, found + (hi - lo) / 64) FROM (
    SELECT round, lo, hi, coalesce((SELECT max(a) FROM (SELECT a, sum(exp(a * ln(n / big))) AS y, sum(exp(a * ln(n / big)) * a * ln(n / big)) AS e FROM s, z, (SELECT lo + (hi - lo) / 64 * i AS a FROM range(65) AS g(i)) GROUP BY a)
      WHERE ln(y) - e / y >= 0.95 * ln((SELECT k FROM z)) - 1e-12), 0) AS found FROM b WHERE round < 4)),
x AS (SELECT CASE WHEN k <= 1 OR big = small THEN 1 ELSE greatest((SELECT lo FROM b WHERE round = 4), 1 - ln(4.0) / ln(big / small), 0) END AS alpha FROM z),
m AS (SELECT source, name, n, rows, alpha, pow(n / total, alpha) / (SELECT sum(pow(n / total, alpha)) FROM s, z, x) AS weight, greatest(1, pow(big / n, 1 - alpha)) AS repeats FROM s, z, x),
p AS (SELECT *, round(repeats * n)::BIGINT AS budget FROM m),
t AS (SELECT d.*, p.* EXCLUDE (source), epoch, ('0x' || substr(md5('17|' || epoch || '|' || coalesce(doc_id::VARCHAR, '') || '|' || h), 1, 15))::BIGINT AS o
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(0, ceil(repeats - 1e-9)::BIGINT)) AS u(epoch)),
w AS (SELECT *, epoch * n + sum(tokens * copies) OVER (PARTITION BY name, epoch ORDER BY o, doc_id, tokens, h) - tokens * copies AS start FROM t),
c AS (SELECT *, start + j * tokens AS place, greatest(1, round((SELECT sum(budget) FROM p) / 1000000.0))::BIGINT AS blocks FROM w, unnest(range(0, copies)) AS u(j) WHERE start < budget),
k AS (SELECT *, least(blocks - 1, floor(place / budget::DOUBLE * blocks))::INTEGER AS block FROM c)
SELECT doc_id, source, tokens, epoch::INTEGER AS epoch, block, row_number() OVER (PARTITION BY block ORDER BY o, name, doc_id NULLS FIRST, epoch, h, j) - 1 AS slot, alpha AS exponent, weight, repeats FROM k""",
}
