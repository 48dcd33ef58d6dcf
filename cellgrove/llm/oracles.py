"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from cellgrove.llm.hosts import RULES, SUFFIXES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = """WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages), d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS digest FROM p),
m AS (SELECT digest, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN last IS NOT NULL AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM d LEFT JOIN m USING (digest)"""


def _strength(source: str, by: str) -> str:
    """Method of moments for the beta-binomial over the children of each parent."""
    keys = f"{by}, " if by else ""
    return f"""(SELECT {keys}1 / least(greatest(COALESCE(CASE WHEN rate > 0 AND rate < 1 AND g > 1 AND room > 0 THEN ((k2n - nn * rate * rate) / (rate * (1 - rate)) - (g - 1)) / room END, 0.01E0), 0.001E0), 0.9E0) - 1 AS strength
 FROM (SELECT *, kk / nn AS rate, nn - n2 / nn - (g - 1) AS room FROM (SELECT {keys}CAST(sum(n) AS DOUBLE) AS nn, CAST(sum(k) AS DOUBLE) AS kk, count(*) AS g, CAST(sum(n * n) AS DOUBLE) AS n2, sum(k * k / n) AS k2n FROM {source}{' GROUP BY ' + by if by else ''})))"""


_TWO = "array_to_string(string_split(host, '.')[-2:], '.')"
_IS = f"{_TWO} IN ({', '.join(repr(x) for x in SUFFIXES)})"
_DOMAIN = f"CASE WHEN {_IS} THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE {_TWO} END"
_SUFFIX = f"CASE WHEN {_IS} THEN {_TWO} ELSE string_split(host, '.')[-1] END"


def op8() -> str:
    rules = ", ".join(f"('{kind}', '{host}', '{path}')" for kind, host, path in RULES)
    return f"""WITH p AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT page_id, url, COALESCE(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host, COALESCE(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
rules AS (SELECT * FROM (VALUES {rules}) AS t(kind, rh, rp)),
hit AS (SELECT page_id, rh || rp AS rule, kind FROM q JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC, kind DESC) = 1),
o AS (SELECT host, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM q JOIN labels ON doc_id = TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT)),
hosts AS (SELECT host, {_DOMAIN} AS domain, {_SUFFIX} AS suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS k FROM o GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix), suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix),
whole AS (SELECT COALESCE(sum(k) / sum(n), 0.5E0) AS rate FROM hosts),
s AS (SELECT suffix, k + strength * rate AS alpha, n - k + strength * (1 - rate) AS beta FROM suffixes, whole, {_strength('suffixes', '')}),
d AS (SELECT domain, d.k + COALESCE(strength, 99) * (s.alpha / (s.alpha + s.beta)) AS alpha, d.n - d.k + COALESCE(strength, 99) * (1 - s.alpha / (s.alpha + s.beta)) AS beta FROM domains d JOIN s USING (suffix) LEFT JOIN {_strength('domains', 'suffix')} USING (suffix)),
h AS (SELECT host, h.k + COALESCE(strength, 99) * (d.alpha / (d.alpha + d.beta)) AS alpha, h.n - h.k + COALESCE(strength, 99) * (1 - d.alpha / (d.alpha + d.beta)) AS beta FROM hosts h JOIN d USING (domain) LEFT JOIN {_strength('hosts', 'domain')} USING (domain)),
risk AS (SELECT host, COALESCE(h.alpha, d.alpha, s.alpha, rate * 99) AS a, COALESCE(h.beta, d.beta, s.beta, (1 - rate) * 99) AS b FROM (SELECT DISTINCT host, {_DOMAIN} AS own_domain, {_SUFFIX} AS own_suffix FROM q) LEFT JOIN h USING (host) LEFT JOIN d ON d.domain = own_domain LEFT JOIN s ON s.suffix = own_suffix, whole)
SELECT page_id, host, path, rule, COALESCE(kind, CASE WHEN a / (a + b) - 1.645E0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.25E0 THEN 'block' ELSE 'allow' END) AS verdict FROM q LEFT JOIN hit USING (page_id) JOIN risk USING (host)"""


def _components(nodes: str, links: str) -> str:
    return f"""reach(a, b) AS (SELECT id, id FROM {nodes} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON r.b = l.a), comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""


OP9 = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
ok AS (SELECT * FROM n WHERE norm > 0 AND isfinite(norm) AND list_count(e) = len(e)),
links AS (SELECT x.id AS a, y.id AS b FROM ok x JOIN ok y ON x.id <> y.id AND len(x.e) = len(y.e) WHERE list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.9E0),
{_components('v', 'links')}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = comp.id) AS n_links, component_id, id = component_id AS kept FROM comp"""

OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
flat AS (SELECT DISTINCT id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT w.id, count(flat.s) AS n FROM w LEFT JOIN flat USING (id) GROUP BY w.id),
pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM flat x JOIN flat y USING (s) WHERE x.id <> y.id GROUP BY x.id, y.id),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
{_components('w', 'links')}
SELECT id AS doc_id, n AS n_shingles, component_id, id = component_id AS kept FROM comp JOIN sizes USING (id)"""

OP13 = f"""WITH said AS (SELECT doc_id AS id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
f AS (SELECT part, COALESCE(good, false) AS good, COALESCE(toxic, false) AS toxic, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
 + CASE WHEN 100 * (length(text) - length(translate(text, '{_UPPER}', ''))) > 2 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN least < doc_id THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN said ON id = doc_id),
n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(letter, bit)),
orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS own, CAST(COALESCE(list_sum(bits[1:i - 1]), 0) AS INTEGER) AS before FROM orders, range(1, 6) AS r(i)),
counts AS (SELECT part, filter_order, step, own, CAST(sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
 CAST(sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
 CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM n, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counts"""

ORACLES = {"op5_warc": OP5, "op8_hosts": op8(), "op9_vectors": OP9, "op10_minhash": OP10, "op13_interplay": OP13}
