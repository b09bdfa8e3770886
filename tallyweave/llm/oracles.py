"""The queries of this subpackage as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from .licences import BLANK, CUES, END, SENTENCES, TAGS, any_known, doubled
from .licences import steps as rule_steps


def _op3() -> str:
    plain = lambda c: f"trim(regexp_replace(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    cased = " ".join(f"WHEN '{doubled(v)}' THEN '{k}'" for k, v in SENTENCES.items())
    cued = " OR ".join(f"contains(p, '{x}')" for x in CUES)
    steps, last = [], "s0"
    for i, (name, run) in enumerate(rule_steps(), 1):
        named = f"contains(seq, '{run}')" if name else "false"
        steps.append(f"s{i} AS (SELECT doc_id, replace(seq, '{run}', '|') AS seq, CASE WHEN {named} THEN list_append(found, '{name}') ELSE found END AS found FROM {last})")
        last = f"s{i}"
    text = "coalesce(text, '')"
    for pattern, put in TAGS:
        text = f"regexp_replace({text}, '{pattern}', '{put.format('', *(chr(92) + x for x in '123'))}', 'g')"
    return f"""
WITH cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace({text}, '{BLANK}', chr(1), 'g'), '{END}', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
one AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM cut),
plain AS (SELECT doc_id, i, {plain("s")} AS p FROM one),
matched AS (SELECT doc_id, i, regexp_extract_all(' ' || replace(p, ' ', '  ') || ' ', '{any_known()}', 1) AS m FROM plain WHERE {cued}),
named AS (SELECT doc_id, i, CASE WHEN len(m) = 0 THEN ['?'] ELSE list_transform(m, lambda x: CASE x {cased} END) END AS id FROM matched),
ids AS (SELECT d.doc_id, coalesce(n.ids, []::VARCHAR[]) AS ids FROM documents d
        LEFT JOIN (SELECT doc_id, flatten(list(id ORDER BY i)) AS ids FROM named GROUP BY doc_id) n ON d.doc_id = n.doc_id),
s0 AS (SELECT doc_id, '<' || array_to_string(ids, '><') || '>' AS seq, []::VARCHAR[] AS found FROM ids),
{", ".join(steps)}
SELECT ids.doc_id, list_filter(ids.ids, lambda x: x <> '?') AS sentences,
       list_filter({last}.found, lambda x, k: list_position({last}.found, x) = k) AS licences,
       (len(ids.ids) - len(list_filter(ids.ids, lambda x: x <> '?')))::BIGINT AS n_unknown
FROM ids JOIN {last} ON ids.doc_id = {last}.doc_id
"""


_ADDRESSES = r"""
rest AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
query AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1), '&'),
                 lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref)(=|$)'))) AS kept FROM parts),
addressed AS (SELECT page_id, host, path, CASE WHEN host <> '' THEN
                 regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
                 || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS address FROM query),
"""

OP6 = f"""
WITH {_ADDRESSES}
listed AS (SELECT DISTINCT address FROM addressed
           WHERE list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])),
ruled AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM addressed)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN l.address IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       l.address IS NOT NULL AS listed
FROM ruled r LEFT JOIN listed l ON r.address = l.address
"""

OP7 = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(-144115188075855872, least(144115188075855872, floor(x::DOUBLE * 64)))::BIGINT) AS v FROM embeddings
               WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, greatest(-9223372036854775807::HUGEINT, least(9223372036854775807::HUGEINT,
                  list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1]::HUGEINT * p[2]::HUGEINT))))::BIGINT AS score
           FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP9 = r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM cut WHERE len(words) >= 50),
windows AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS w FROM starts),
least AS (SELECT w, min(doc_id) AS m FROM windows GROUP BY w),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS k FROM windows JOIN least USING (w) WHERE doc_id > m),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM cut),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.k) AS text, count(*) AS n FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k
         WHERE g.k IS NULL GROUP BY e.doc_id)
SELECT c.doc_id, len(c.words)::BIGINT AS n_words, (len(c.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM cut c LEFT JOIN kept k ON c.doc_id = k.doc_id
"""

OP10 = r"""
WITH counted AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                        ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0 AS chance FROM documents),
sized AS (SELECT *, length(bin(size))::BIGINT AS digits FROM counted),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM totals),
weighed AS (SELECT *, [5, 2, 1][((k - 1) % 3 + 1)::INTEGER] AS weight, source_size * 3 AS cap FROM named),
running AS (SELECT *, (SELECT sum(source_size)::BIGINT FROM weighed)
                      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS remains,
                      (SELECT sum(weight)::BIGINT FROM weighed)
                      - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS share FROM weighed),
limits AS (SELECT *, cap * share < remains * weight AS limited FROM running),
opened AS (SELECT remains AS r, share AS s FROM limits WHERE NOT limited ORDER BY share DESC, remains DESC LIMIT 1),
goals AS (SELECT source, source_size, CASE WHEN limited OR s IS NULL THEN cap::DOUBLE ELSE (r * weight)::DOUBLE / s END AS target
          FROM limits LEFT JOIN opened ON true),
classes AS (SELECT d.source, d.digits, sum(d.size)::BIGINT AS words FROM sized d GROUP BY d.source, d.digits),
shared AS (SELECT c.*, g.source_size, g.target, round(g.target)::BIGINT
                  - 3 * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS open_words,
                  sum(words * digits) OVER (PARTITION BY c.source ORDER BY digits ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS open_share
           FROM classes c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source),
firsts AS (SELECT source, max(digits) AS top, arg_max(open_words, digits) AS w, arg_max(open_share, digits) AS a FROM shared WHERE digits * open_words < 3 * open_share GROUP BY source),
timed AS (SELECT s.source, s.digits, s.words, s.source_size, s.target,
                 CASE WHEN s.source_size = 0 THEN 0.0::DOUBLE WHEN f.top IS NULL OR s.digits > f.top THEN 3.0::DOUBLE ELSE (s.digits * f.w)::DOUBLE / f.a END AS times
          FROM shared s LEFT JOIN firsts f ON s.source IS NOT DISTINCT FROM f.source),
parts AS (SELECT *, floor(times)::BIGINT AS copies, times - floor(times) AS inclusion,
                 round(target)::BIGINT - (sum(floor(times)::BIGINT * words) OVER (PARTITION BY source))::BIGINT AS rest FROM timed),
chosen AS (SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.copies, p.rest,
                  CASE WHEN p.inclusion > 0 THEN d.chance / (1 - d.chance) * (1 - p.inclusion) / p.inclusion END AS odds
           FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source AND d.digits = p.digits),
ranked AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM chosen)
SELECT doc_id, source, size, source_size, target, (copies * size + CASE WHEN odds IS NULL THEN 0 ELSE greatest(0, least(size, rest - before)) END)::BIGINT AS taken FROM ranked
"""


def _op11(k: int, rounds: int, dims: int, scale: int, seed: int, largest: int) -> str:
    far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        f"""kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: greatest(-{largest}, least({largest}, floor(x::DOUBLE * {scale})))::BIGINT) AS v FROM embeddings
             WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT k, v AS c FROM (SELECT v, (row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INTEGER AS k FROM kept) x WHERE k < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT rid, min(struct_pack(d := {far}, k := k)) AS best FROM kept CROSS JOIN c{i} GROUP BY rid)")
        if i < rounds:
            steps += [
                f"s{i} AS (SELECT best.k AS k, j, sum(v[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} JOIN kept USING (rid) CROSS JOIN (SELECT unnest(range(1, {dims + 1})) AS j) d GROUP BY best.k, j)",
                f"n{i} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM s{i} GROUP BY k)",
                f"c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN n{i} n ON o.k = n.k)",
            ]
    return f"""WITH {", ".join(steps)}
SELECT vec_id, best.k AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN kept USING (rid) JOIN c{rounds} f ON a.best.k = f.k"""


_WRITTEN = "coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_WRITTEN.format(c=c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"

OP12 = f"""
WITH RECURSIVE
crc AS (SELECT list(list_reduce(list_concat([i::BIGINT], range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) x(i)),
rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '-') AS grp, {_LEAF.format(n="n_chars")} AS leaf, {_LEAF.format(n="(n_chars::HUGEINT + 1)")} AS changed,
         coalesce(xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 7 = 0, false) AS tampered FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY coalesce(doc_id, -9223372036854775808), leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM rows),
tree AS (SELECT grp, 0 AS level, i, leaf AS h, n FROM placed
         UNION ALL SELECT grp, any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM tree WHERE n > 1 GROUP BY grp, i // 2),
subroots AS (SELECT grp, h AS subroot, level AS depth, row_number() OVER (ORDER BY grp) - 1 AS g, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, g AS i, subroot AS h, n FROM subroots
        UNION ALL SELECT any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM top WHERE n > 1 GROUP BY i // 2),
root AS (SELECT h AS root, level AS height FROM top WHERE n = 1),
steps AS (SELECT p.rid, t.level AS step, (p.i >> t.level) % 2 AS odd, s.h FROM placed p JOIN (SELECT DISTINCT grp, level, n FROM tree) t ON p.grp = t.grp AND t.n > 1
              LEFT JOIN tree s ON s.grp = p.grp AND s.level = t.level AND s.i = xor(p.i >> t.level, 1)
          UNION ALL SELECT p.rid, r.depth + t.level, (r.g >> t.level) % 2, s.h FROM placed p JOIN subroots r ON p.grp = r.grp JOIN (SELECT DISTINCT level, n FROM top) t ON t.n > 1
              LEFT JOIN top s ON s.level = t.level AND s.i = xor(r.g >> t.level, 1)),
proofs AS (SELECT rid, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof FROM steps GROUP BY rid),
fold AS (SELECT rid, 0 AS step, CASE WHEN tampered THEN changed ELSE leaf END AS h FROM placed
         UNION ALL SELECT f.rid, f.step + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.odd = 1 THEN s.h || f.h ELSE f.h || s.h END) FROM fold f JOIN steps s ON f.rid = s.rid AND f.step = s.step)
SELECT p.doc_id, p.leaf, r.subroot, root.root, coalesce(q.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root.root AS verified
FROM placed p JOIN subroots r ON p.grp = r.grp CROSS JOIN root LEFT JOIN proofs q ON p.rid = q.rid JOIN fold f ON p.rid = f.rid AND f.step = r.depth + root.height
"""

ORACLES = {
    "op3_licences": _op3(),
    "op6_url_filter": OP6,
    "op7_topk": OP7,
    "op9_substrings": OP9,
    "op10_mixing": OP10,
    "op11_clusters": _op11(40, 5, 64, 256, 2, 1 << 27),
    "op12_manifest": OP12,
}
