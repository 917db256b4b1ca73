"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from strandgraph.llm.chat import CLOSE, OPEN

_SPACE = r"'[^\x20\x09-\x0D]+'"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), h AS (
  SELECT *, sha1(html) AS hex FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""

OP3 = """
WITH cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), each AS (
  SELECT doc_id, unnest(lines) AS raw, generate_subscripts(lines, 1) AS ix FROM cut
), filled AS (
  SELECT doc_id, ix, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM each
), seq AS (
  SELECT doc_id, ix, line, row_number() OVER (PARTITION BY doc_id ORDER BY ix) AS pos FROM filled WHERE line <> ''
), two AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS line2, lead(ix) OVER (PARTITION BY doc_id ORDER BY pos) AS ix2 FROM seq
), single AS (
  SELECT doc_id, ix FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM seq) WHERE nth > 1 AND length(line) >= 100
), pairs AS (
  SELECT doc_id, ix, ix2 FROM (SELECT *, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, pos) AS nth FROM two WHERE line2 IS NOT NULL) WHERE nth > 1
), gone AS (
  SELECT doc_id, ix FROM single UNION SELECT doc_id, ix FROM pairs UNION SELECT doc_id, ix2 FROM pairs
), kept AS (
  SELECT e.doc_id, count(*) AS n_lines, count(g.ix) AS n_removed, count(s.ix) AS n_filled,
    coalesce(string_agg(raw, chr(10) ORDER BY e.ix) FILTER (WHERE g.ix IS NULL), '') AS text
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.ix = g.ix LEFT JOIN seq s ON e.doc_id = s.doc_id AND e.ix = s.ix
  GROUP BY e.doc_id
)
SELECT c.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_filled - n_removed, 0)::BIGINT AS n_left, CASE WHEN c.text IS NOT NULL THEN sha256(coalesce(k.text, c.text)) END AS kept_sha256
FROM cut c LEFT JOIN kept k ON c.doc_id = k.doc_id
"""

OP4 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_SPACE})), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, z, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM (SELECT source, sum(size)::DOUBLE AS z FROM d GROUP BY source)
), l AS (
  SELECT *, (1.5::DOUBLE * sum(z) OVER () - 2.0::DOUBLE * coalesce(sum(z) OVER (ORDER BY z / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY z / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT source, z, CASE WHEN 2.0::DOUBLE * z <= level * w THEN 2.0::DOUBLE * z ELSE w * max(CASE WHEN 2.0::DOUBLE * z > level * w THEN level END) OVER () END AS target,
    ('0x' || substr(md5('7:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off
  FROM l
), r AS (
  SELECT d.*, z::BIGINT AS source_size, target, off, CASE WHEN z > 0 THEN target / z ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY size, md5(doc_id::VARCHAR), doc_id) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(n * rate + off) - floor((n - 1) * rate + off)) * size)::BIGINT AS taken FROM r
"""

OP5 = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, {_SPACE}), []) AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS ix FROM d WHERE len(words) >= 20
), w AS (
  SELECT doc_id, ix, md5(array_to_string(words[ix : ix + 19], ' ')) AS h FROM starts
), later AS (
  SELECT doc_id, ix FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, ix) AS nth FROM w) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, ix + i AS ix FROM later, range(0, 20) r(i)
), each AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS ix FROM d
), kept AS (
  SELECT e.doc_id, count(*) AS n, count(g.ix) AS r, coalesce(string_agg(word, ' ' ORDER BY e.ix) FILTER (WHERE g.ix IS NULL), '') AS t
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.ix = g.ix GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

_SAFE = "replace(coalesce({}, ''), '<|', '< |')"
_HEAD = f"('{OPEN}' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10))"
_BODY = f"({_SAFE.format('text')} || '{CLOSE}')"

OP6 = f"""
WITH t AS (
  SELECT conv_id // 2 AS pair, conv_id % 2 AS side, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations WHERE conv_id IS NOT NULL
), sides AS (
  SELECT pair, max(n) FILTER (WHERE side = 0) AS a, max(n) FILTER (WHERE side = 1) AS b FROM t GROUP BY pair HAVING count(DISTINCT side) = 2
), same AS (
  SELECT x.pair, x.n FROM t x JOIN t y ON x.pair = y.pair AND x.n = y.n AND x.side = 0 AND y.side = 1
  WHERE x.role IS NOT DISTINCT FROM y.role AND x.text IS NOT DISTINCT FROM y.text
), run AS (
  SELECT pair, count(*) AS p FROM (SELECT pair, n, row_number() OVER (PARTITION BY pair ORDER BY n) AS i FROM same) WHERE n = i GROUP BY pair
), cut AS (
  SELECT s.pair, a, b, coalesce(p, 0) AS p FROM sides s LEFT JOIN run r ON s.pair = r.pair
), piece AS (
  SELECT t.pair, side, n, p, {_HEAD} || {_BODY} || chr(10) AS line,
    length({_HEAD}) || ':0,' || length({_BODY}) || ':' || CASE WHEN role = 'assistant' THEN '1' ELSE '0' END || ',1:0' AS mask
  FROM t JOIN cut c ON t.pair = c.pair
)
SELECT c.pair, c.p::BIGINT AS n_prefix, (c.a - c.p)::BIGINT AS n_chosen, (c.b - c.p)::BIGINT AS n_rejected,
  coalesce(string_agg(line, '' ORDER BY n) FILTER (WHERE side = 0 AND n <= x.p), '') AS prompt,
  coalesce(string_agg(line, '' ORDER BY n) FILTER (WHERE side = 0 AND n > x.p), '') AS chosen,
  coalesce(string_agg(mask, ',' ORDER BY n) FILTER (WHERE side = 0 AND n > x.p), '') AS chosen_mask,
  coalesce(string_agg(line, '' ORDER BY n) FILTER (WHERE side = 1 AND n > x.p), '') AS rejected,
  coalesce(string_agg(mask, ',' ORDER BY n) FILTER (WHERE side = 1 AND n > x.p), '') AS rejected_mask
FROM cut c JOIN piece x ON c.pair = x.pair GROUP BY c.pair, c.p, c.a, c.b
"""

OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
) WHERE rank <= 20
"""

_WORDS_OF = f"coalesce(regexp_extract_all({_LOWER.format('text')}, {_PLAIN}), [])"

OP10 = f"""
WITH d AS (
  SELECT doc_id, {_WORDS_OF} AS words FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, {_WORDS_OF} AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(13, len(words)) AS n, array_to_string(words[ix : ix + least(13, len(words)) - 1], ' ') AS phrase
  FROM (SELECT item, words, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS ix FROM b WHERE len(words) > 0)
), lengths AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, n, ix, array_to_string(words[ix : ix + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS ix FROM d, lengths WHERE len(words) >= n)
), found AS (
  SELECT p.doc_id, p.n, p.ix, w.item FROM places p JOIN windows w ON p.n = w.n AND p.phrase = w.phrase
), hits AS (
  SELECT doc_id, count(DISTINCT ix + i) AS n_hit FROM (SELECT DISTINCT doc_id, n, ix FROM found), range(0, 13) r(i) WHERE i < n GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""

_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}, ''), lambda c: ord(c)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda i: 0::BIGINT)), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))))"""

OP12 = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), kinds AS (
  SELECT k, {_CRC.format("k")} % 20 AS kind FROM (SELECT DISTINCT k FROM raw)
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM raw JOIN kinds USING (k) WHERE kind <> 0
), placed AS (
  SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt
), turns AS MATERIALIZED (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') OR row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS gone,
    CASE WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 0 ELSE 3 END AS cut,
    CASE initial WHEN 's' THEN [1, -1, -1, -1] WHEN 'u' THEN [2, 2, -1, 2] WHEN 'a' THEN [-1, -1, 3, -1] WHEN '' THEN [0, 1, 2, 3] ELSE [-1, -1, -1, -1] END AS step,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prior
  FROM placed
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE gone AND NOT blank) AS duplicate, count(*) FILTER (WHERE NOT gone AND cut > 0) AS truncated,
    count(*) FILTER (WHERE prior || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id
), best AS (
  SELECT conv_id, n AS i, [0, 6, 3, 0]::BIGINT[] AS d FROM counts
  UNION ALL
  SELECT conv_id, i, [least(r[1], 3 + least(r[3], 3 + r[4])), least(r[2], 3 + least(r[3], 3 + r[4])), least(r[3], 3 + r[4]), least(r[4], 3 + r[3])]
  FROM (
    SELECT b.conv_id, t.i - 1 AS i, list_transform([1, 2, 3, 4], lambda q: least(4 + b.d[q],
      CASE WHEN gone THEN 999999999 ELSE 3 + cut + b.d[([3, 3, 4, 3])[q]] END,
      CASE WHEN gone OR step[q] < 0 THEN 999999999 ELSE cut + b.d[step[q] + 1] END)) AS r
    FROM best b JOIN turns t ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.i = t.i
  )
), kept AS MATERIALIZED (
  SELECT * FROM best
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, '' AS audit, []::VARCHAR[] AS lines FROM counts
  UNION ALL
  SELECT conv_id, i + CASE WHEN letter = 'I' THEN 0 ELSE 1 END, CASE letter WHEN 'D' THEN q WHEN 'K' THEN step[q + 1] ELSE ([2, 2, 3, 2])[q + 1] END, audit || letter,
    CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, (['user:', 'user:', 'assistant:', 'user:'])[q + 1] || CASE WHEN letter = 'R' THEN text ELSE '' END) END
  FROM (
    SELECT w.*, t.role, t.text, t.step, CASE WHEN a.d[w.q + 1] = 4 + b.d[w.q + 1] THEN 'D' WHEN a.d[w.q + 1] = 3 + a.d[([3, 3, 4, 3])[w.q + 1]] THEN 'I'
      WHEN NOT gone AND step[w.q + 1] >= 0 AND a.d[w.q + 1] = cut + b.d[step[w.q + 1] + 1] THEN 'K' ELSE 'R' END AS letter
    FROM walk w JOIN kept a ON w.conv_id IS NOT DISTINCT FROM a.conv_id AND w.i = a.i
    LEFT JOIN kept b ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i + 1 = b.i
    LEFT JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.i + 1 = t.i
    WHERE a.d[w.q + 1] > 0 OR b.i IS NOT NULL
  )
), last AS (
  SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM walk GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(k.d[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts n ON c.conv_id IS NOT DISTINCT FROM n.conv_id
LEFT JOIN kept k ON c.conv_id IS NOT DISTINCT FROM k.conv_id AND k.i = 0
LEFT JOIN last l ON c.conv_id IS NOT DISTINCT FROM l.conv_id
"""

_ASSIGN = """, a{i} AS MATERIALIZED (
  SELECT vec_id, part, x, (m % 256)::INT AS k, m // 256 AS d FROM (
    SELECT p.vec_id, p.part, p.x, min((list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x))::BIGINT * 256 + c.k) AS m
    FROM p JOIN c{i} c ON p.part = c.part GROUP BY ALL)
)"""
_MOVE = """, c{j} AS MATERIALIZED (
  SELECT c.part, c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT part, k, list(floor_s ORDER BY pos) AS x FROM (
      SELECT part, k, pos, ((s - ((s % n) + n) % n) // n)::DOUBLE AS floor_s FROM (
        SELECT part, k, pos, sum(x[pos]::BIGINT) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS pos FROM a{i}) GROUP BY part, k, pos)
    ) GROUP BY part, k) m ON c.part = m.part AND c.k = m.k
)"""

OP13 = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM v, range(4) r(part)
), c0 AS MATERIALIZED (
  SELECT part, k, x FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, x FROM p) WHERE k < 256
){"".join(_ASSIGN.format(i=i) + _MOVE.format(i=i, j=i + 1) for i in range(4))}{_ASSIGN.format(i=4)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id
)
SELECT v.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY part, k)) FROM c4) AS codebooks_sha256
FROM v JOIN coded ON v.vec_id = coded.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": OP2, "op3_line_dedup": OP3, "op4_mixing": OP4, "op5_substring_dedup": OP5,
        "op6_preferences": OP6, "op8_topk": OP8, "op10_decontamination": OP10,
        "op12_repair": OP12, "op13_vector_codes": OP13,
    }
