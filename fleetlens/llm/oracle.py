"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from . import collocations, mixing, sharding, warc


def _hash52(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


def _mix() -> str:
    u = _hash52(f"'{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || part::VARCHAR")
    at = _hash52(f"'{mixing.SEED}:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR")
    return f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT source, n, pow(n::DOUBLE, {mixing.ALPHA}) AS w FROM n),
r AS (SELECT source, 1.0::DOUBLE * (w / (SELECT sum(w) FROM w)) * (SELECT sum(n) FROM w)::DOUBLE / n::DOUBLE AS rate FROM w),
p AS (SELECT source, ceil(rate / {mixing.CHUNK})::INTEGER AS parts, rate / ceil(rate / {mixing.CHUNK}) AS m FROM r),
t AS (SELECT source, parts, m, 0 AS k, exp(-m) AS p, exp(-m) AS c FROM p
      UNION ALL
      SELECT source, parts, m, k + 1, p * m / (k + 1)::DOUBLE, c + p * m / (k + 1)::DOUBLE FROM t WHERE k < {mixing.STEPS}),
s AS (SELECT source, any_value(parts) AS parts, list(c ORDER BY k) FILTER (c < 1.0) AS cs FROM t GROUP BY source),
d AS (SELECT documents.*, cs, unnest(range(1, parts + 1)) AS part FROM documents JOIN s ON documents.source IS NOT DISTINCT FROM s.source),
e AS (SELECT doc_id, text, lang, source, n_chars,
             sum(len(list_filter(cs, lambda c: c <= {u}::DOUBLE / 4503599627370496.0))) AS n
      FROM d GROUP BY ALL),
x AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(0, n::BIGINT))::INTEGER AS copy FROM e)
SELECT doc_id, text, lang, source, n_chars, copy, {at}::DOUBLE / 4503599627370496.0 AS position FROM x"""


def _place() -> str:
    n, size = sharding.SHARDS, sharding.SLOTS
    offset = _hash52("'offset:' || name")
    skip = _hash52("'skip:' || name")
    return f"""
WITH RECURSIVE names AS (SELECT i, 'shard-' || lpad(i::VARCHAR, 5, '0') AS name FROM range({n}) x(i)),
pref AS (SELECT list({offset} % {size} ORDER BY i) AS o, list(1 + {skip} % {size - 1} ORDER BY i) AS s FROM names),
turn AS (
  SELECT 0 AS t, -1::BIGINT AS slot, list_transform(range({size}), lambda z: 0::TINYINT) AS taken
  UNION ALL
  SELECT t + 1, pick, list_concat(list_concat(taken[:pick], [1::TINYINT]), taken[pick + 2:])
  FROM (SELECT t, taken, list_filter(list_transform(range({size}), lambda j: (o[t % {n} + 1] + j * s[t % {n} + 1]) % {size}),
                                     lambda q: taken[q + 1] = 0)[1] AS pick
        FROM turn, pref WHERE t < {size}))
SELECT doc_id, source, documents_slot AS slot, ((turn.t - 1) % {n})::INTEGER AS shard
FROM (SELECT doc_id, source, {_hash52("coalesce(doc_id::VARCHAR, '')")} % {size} AS documents_slot FROM documents) d
JOIN turn ON turn.slot = documents_slot"""


def _revisits() -> str:
    rest = "regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '')"
    host = "regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^(?:[^@]*@)?(?:www[0-9]*\\.)?([^:]*?)(?::(?:80|443))?$', '\\1')"
    query = f"list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda f: f <> '' AND NOT regexp_matches(lower(f), '{warc.TRACKING}')))"
    kept = ", ".join(f"'{f}'" for f in warc.KEPT_FIELDS)

    def headers(*pairs):
        return "[" + ", ".join(f"{{'name': '{n}', 'value': ({v})::VARCHAR}}" for n, v in pairs) + "]"

    def full(body, etag):
        return headers(("Content-Type", "'text/html'"), ("ETag", etag), ("Content-Length", f"length({body})"), ("Cache-Control", "'max-age=60'"))

    def first(name):
        return f"list_filter(headers, lambda h: lower(h.name) = '{name}')[1].value"

    return f"""
WITH p AS (SELECT *, 1700000000 + page_id * 60 AS start, page_id // 50 AS block, '"' || md5(coalesce(html, '')) || '"' AS tag,
                  '"' || md5(coalesce(html, '') || '2') || '"' AS tag2, coalesce(html, '') || '<!-- 2 -->' AS html2 FROM pages),
v AS (
  SELECT page_id, 0 AS visit, url, start AS ts, 200 AS status, html AS body, {full('html', 'tag')} AS headers FROM p
  UNION ALL
  SELECT page_id, 1, regexp_replace(url, '^https?://', 'http://WWW.') || '#again', start + CASE WHEN page_id % 5 = 0 THEN -86400 ELSE 86400 END, 304, NULL,
         {headers(('etag', "'W/' || tag"), ('Content-Length', '0'), ('cache-control', "'max-age=600'"))} FROM p
  UNION ALL
  SELECT page_id, 2, url, start + 172800, 304, NULL,
         {headers(('ETag', """CASE WHEN page_id % 7 = 0 THEN '"other"' WHEN page_id % 3 = 0 AND page_id % 4 <> 0 THEN tag2 ELSE tag END"""), ('Age', '1'))} FROM p
  UNION ALL
  SELECT page_id, 3, url, start + 129630, 200, html2, {full('html2', 'tag2')} FROM p WHERE page_id % 3 = 0
  UNION ALL
  SELECT page_id, 4, 'http://Hot.example/?utm_source=' || page_id, start, CASE WHEN page_id % 50 = 0 THEN 200 ELSE 304 END,
         CASE WHEN page_id % 50 = 0 THEN '<p>' || page_id || '</p>' END,
         CASE WHEN page_id % 50 = 0 THEN {headers(('Content-Type', "'text/html'"), ('Last-Modified', 'block'))}
              WHEN page_id % 11 = 0 THEN {headers(('Age', '1'))}
              ELSE {headers(('Last-Modified', 'CASE WHEN page_id % 13 = 0 THEN block - 1 ELSE block END'))} END FROM p
  UNION ALL
  SELECT page_id, 5, 'http://Hot.example/?utm_source=' || page_id, start + 20, 304, NULL, {headers(('last-modified', 'block'), ('Set-Cookie', "'k=1'"))} FROM p),
r AS (SELECT *, {rest} AS rest, regexp_replace(trim({first('etag')}), '^W/', '') AS etag, {first('last-modified')} AS modified FROM v),
c AS (SELECT *, {host} || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') ||
        CASE WHEN len({query}) > 0 THEN '?' || array_to_string({query}, '&') ELSE '' END AS page FROM r),
j AS (SELECT a.*, b.page_id * 6 + b.visit AS old, b.etag AS old_tag, b.modified AS old_modified, b.body AS old_body, b.headers AS old_headers
      FROM (SELECT * FROM c WHERE status = 304) a
      ASOF LEFT JOIN (SELECT * FROM c WHERE status = 200) b ON a.page = b.page AND a.ts > b.ts),
o AS (SELECT *, CASE WHEN old IS NULL THEN 'no_earlier'
                     WHEN (etag IS NULL OR etag IS NOT DISTINCT FROM old_tag) AND (modified IS NULL OR modified IS NOT DISTINCT FROM old_modified) THEN 'resolved'
                     ELSE 'mismatch' END AS outcome, list_filter(headers, lambda h: lower(h.name) NOT IN ({kept})) AS fresh FROM j),
m AS (SELECT *, CASE WHEN outcome = 'resolved' THEN
                     list_concat(list_filter(old_headers, lambda s: NOT list_contains(list_transform(fresh, lambda h: lower(h.name)), lower(s.name))), fresh)
                ELSE headers END AS merged FROM o)
SELECT page_id * 6 + visit AS record_id, page_id, url, ts::BIGINT AS ts,
       CASE WHEN outcome = 'resolved' THEN 200 ELSE 304 END::INTEGER AS status, outcome,
       CASE WHEN outcome = 'resolved' THEN old END AS refers_to,
       array_to_string(list_transform(merged, lambda h: concat_ws('=', h.name, h.value)), chr(10)) AS headers,
       CASE WHEN outcome = 'resolved' THEN length(old_body) END AS n_chars,
       CASE WHEN outcome = 'resolved' THEN sha256(old_body) END AS body_sha256
FROM m"""


def _merkle() -> str:
    def field(c):
        return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    # CRC-32 of the decimal id, byte by byte and bit by bit
    byte = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)"
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
           f"lambda a, b: {byte}), 4294967295)")
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tree = """{nodes}(tree, grp, level, pos, n, hash) AS (
  SELECT * FROM {leaves}
  UNION ALL
  SELECT tree, grp, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM {nodes}
  WHERE n > 1 GROUP BY tree, grp, level, pos // 8, n)"""
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {leaf('text')} AS leaf, {leaf(f"CASE WHEN {crc} % 3 = 0 THEN {lower} ELSE text END")} AS claimed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM docs),
bottom AS (SELECT 0 AS tree, grp, 0 AS level, pos, n, leaf AS hash FROM placed),
{tree.format(nodes="nodes", leaves="bottom")},
subroots AS (SELECT 1 AS tree, grp AS of, level AS height, '' AS grp, 0 AS level, row_number() OVER (ORDER BY grp) - 1 AS pos,
                    count(*) OVER () AS n, hash FROM nodes WHERE n = 1),
ends AS (SELECT tree, grp, level, pos, n, hash FROM subroots),
{tree.format(nodes="upper", leaves="ends")},
runs AS (SELECT tree, grp, level, pos // 8 AS run, list(hash ORDER BY pos) AS h
         FROM (SELECT * FROM nodes WHERE n > 1 UNION ALL SELECT * FROM upper WHERE n > 1) GROUP BY tree, grp, level, pos // 8),
-- a place is (tree, grp, level, pos); at the top of a group's tree it becomes the subroot's in the upper one
climb AS (
  SELECT doc_id, leaf, grp AS own, 0 AS tree, grp, 0 AS level, pos, n, claimed AS fold, '' AS proof, row_number() OVER () AS id FROM placed
  UNION ALL
  SELECT c.doc_id, c.leaf, c.own,
         CASE WHEN c.n = 1 THEN 1 ELSE c.tree END, CASE WHEN c.n = 1 THEN '' ELSE c.grp END,
         CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END, CASE WHEN c.n = 1 THEN s.pos ELSE c.pos // 8 END,
         CASE WHEN c.n = 1 THEN s.n ELSE (c.n + 7) // 8 END,
         CASE WHEN c.n = 1 THEN c.fold ELSE sha256(array_to_string(list_concat(list_concat(r.h[:c.pos % 8], [c.fold]), r.h[c.pos % 8 + 2:]), '')) END,
         CASE WHEN c.n = 1 THEN c.proof ELSE c.proof || array_to_string(list_concat(r.h[:c.pos % 8], r.h[c.pos % 8 + 2:]), '') END, c.id
  FROM climb c LEFT JOIN runs r ON r.tree = c.tree AND r.grp = c.grp AND r.level = c.level AND r.run = c.pos // 8
  LEFT JOIN subroots s ON c.tree = 0 AND c.n = 1 AND s.of = c.grp
  WHERE NOT (c.tree = 1 AND c.n = 1))
SELECT doc_id, leaf, s.hash AS subroot, u.hash AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = u.hash AS verified
FROM climb c JOIN subroots s ON s.of = c.own CROSS JOIN (SELECT hash FROM upper WHERE n = 1) u
WHERE c.tree = 1 AND c.n = 1"""


def _collocations() -> str:
    least, top = collocations.LEAST, collocations.TOP
    lengths = range(2, collocations.LONGEST + 1)
    grams = " UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase, {k} AS k FROM pieces"
                               for k in (1, *lengths))
    return f"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
grams AS ({grams}),
f AS (SELECT lang, phrase, k, count(*) AS a FROM grams GROUP BY lang, phrase, k),
total AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= {least}),
parts AS (SELECT lang, a, unnest([array_to_string(w[:k - 1], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM c WHERE k > 2),
kept AS (SELECT * FROM c ANTI JOIN parts USING (lang, phrase, a)),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y
         FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, fx.a AS l, fy.a AS r, n, (1000::HUGEINT * cuts.a * n) // (fx.a::HUGEINT * fy.a) AS score
           FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y JOIN total ON total.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= {top}"""


LLM_ORACLE = {"op2_mix_sources": _mix(), "op7_revisits": _revisits(), "op8_place_shards": _place(), "op12_merkle": _merkle(),
              "op13_collocations": _collocations()}
