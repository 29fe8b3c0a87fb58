"""DuckDB SQL for the operators whose rows SQL can give."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_B32 = "".join(f" || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || substr(x, {5 * i + 1}, 5))::INTEGER) >> {s}) & 31) + 1]" for i in range(8) for s in (15, 10, 5, 0))[4:]

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h
  FROM pages), d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to FROM d"""

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []
  WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
c AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
g AS (SELECT node, n, unnest(s) AS x FROM c),
l AS (SELECT a.node AS a, b.node AS b FROM g a JOIN g b ON a.x = b.x AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT node, node AS other FROM c UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, coalesce(m.component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN m ON m.node = c.node"""

TOP = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5"""

_WORDS = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
#: Windows of 8 words; proximity within 2 positions, looked for around the window's rarest word.
CONTAMINATION = f"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_WORDS}), []) AS w FROM documents),
i AS (SELECT item_id, coalesce(regexp_extract_all({_LOWER}, {_WORDS}), []) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id::VARCHAR AS item_id, w[k:k + least(len(w), 8) - 1] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS k FROM i WHERE len(w) > 0)),
num AS (SELECT g, row_number() OVER () AS win_id FROM (SELECT DISTINCT g FROM win)),
grams AS (SELECT doc_id, pos, n, w[pos:pos + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT len(g) AS n FROM num)
  WHERE len(w) >= n)),
hit AS (SELECT doc_id, pos, n, item_id FROM grams JOIN win USING (g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY doc_id),
per AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id),
term AS (SELECT win_id, k - 1 AS k, g[k] AS t, len(g) AS n FROM (SELECT win_id, g, unnest(range(1, len(g) + 1)) AS k FROM num)),
word AS (SELECT doc_id, w[pos] AS t, pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d) WHERE w[pos] IN (SELECT t FROM term)),
df AS (SELECT t, count(*) AS c FROM word GROUP BY t),
rare AS (SELECT win_id, arg_min(k, c) AS k, arg_min(t, c) AS t FROM (SELECT win_id, k, term.t, coalesce(c, 0) AS c FROM term LEFT JOIN df USING (t)) GROUP BY win_id),
cand AS (SELECT DISTINCT doc_id, win_id, pos - k + e AS p FROM rare JOIN word USING (t), (SELECT unnest(range(-2, 3)) AS e)),
near AS (SELECT cand.doc_id, cand.win_id FROM cand JOIN term USING (win_id) JOIN word ON word.doc_id = cand.doc_id AND word.t = term.t AND abs(word.pos - cand.p - term.k) <= 2
  GROUP BY cand.doc_id, cand.win_id, cand.p, term.n HAVING count(DISTINCT term.k) = term.n),
nears AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near JOIN num USING (win_id) JOIN win USING (g) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_items, 0) >= 2 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN per USING (doc_id) LEFT JOIN nears USING (doc_id)"""

#: CRC-32 byte by byte; the table follows from the polynomial's fixed value 0xEDB88320.
SHARDS = """WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, coalesce(text, '') AS s, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, strlen(s) + 1 AS size, md5(s) AS key,
  xor(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(range(strlen(s)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tab),
o AS (SELECT *, sum(size) OVER (ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before, row_number() OVER (ORDER BY key, doc_id) AS place, sum(size) OVER () AS total FROM c),
r AS (SELECT *, least(floor(((2 * before + size) * 16)::DOUBLE / (2 * total)::DOUBLE)::INTEGER, 15) AS own, min(before) OVER g AS start, sum(size) OVER g AS bytes FROM o
  WINDOW g AS (PARTITION BY key)),
s AS (SELECT *, CASE WHEN bytes * 16 * 100 <= total THEN least(floor(((2 * start + bytes) * 16)::DOUBLE / (2 * total)::DOUBLE)::INTEGER, 15) ELSE own END AS shard FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s"""

_SPACE = "\\x20\\x09-\\x0D"
_MASKS = ", ".join(f"({a}, {b})" for a in range(8) for b in range(a, 8))
#: Templates as lists of tokens; what a mask hides is the empty string.
LINES = f"""WITH l AS (
  SELECT doc_id, pos, lines[pos] AS line
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text <> ''))),
raw AS (SELECT *, regexp_extract_all(line, '[^{_SPACE}]+') AS r FROM l),
k AS (
  SELECT doc_id, pos, line, CASE
    WHEN 10 * len(list_filter(r, lambda x: NOT regexp_matches(x, '[0-9]'))) >= 7 * len(r) THEN list_transform(r, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END)
    ELSE r END AS k
  FROM raw),
u AS (SELECT k, len(k) AS n, min(doc_id) AS first, max(doc_id) AS last, count(DISTINCT doc_id) AS docs FROM k WHERE len(k) > 0 GROUP BY k),
plain AS (SELECT k, first FROM u WHERE first < last AND docs >= CASE WHEN n < 8 THEN 10 ELSE 2 END),
mask(a, b) AS (VALUES {_MASKS}),
leaf AS (SELECT n, k[1:3] AS lead FROM u WHERE n > 3 GROUP BY ALL HAVING count(*) > 1),
able AS (SELECT u.* FROM u JOIN leaf ON leaf.n = u.n AND leaf.lead = u.k[1:3]),
masked AS (
  SELECT k, n, first, last, docs, a, b, list_transform(range(1, n + 1), lambda i: CASE
    WHEN i > 3 AND (CASE WHEN n >= 11 THEN (i - 4) * 8 // (n - 3) ELSE i - 4 END) IN (a, b) THEN ''
    ELSE k[i] END) AS shown
  FROM able, mask WHERE n - 3 > b),
fit AS (SELECT * FROM masked WHERE 10 * len(list_filter(shown, lambda x: x NOT IN ('', '<*>'))) >= 7 * n),
grp AS (
  SELECT a, b, shown, min(first) AS least FROM fit GROUP BY a, b, shown, n
  HAVING count(*) > 1 AND min(first) < max(last) AND sum(docs) >= CASE WHEN n < 8 THEN 10 ELSE 2 END),
firsts AS (SELECT k, min(first) AS first FROM (SELECT * FROM plain UNION ALL SELECT fit.k, grp.least FROM fit JOIN grp USING (a, b, shown)) GROUP BY k),
gone AS (SELECT k.doc_id, k.pos, k.line, coalesce(firsts.first <> k.doc_id, false) AS gone FROM k LEFT JOIN firsts ON firsts.k = k.k),
out AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(kept, d.text) AS text FROM documents d LEFT JOIN out USING (doc_id)"""


def licenses(templates: list[tuple[str, str]], phrases: dict[str, str], threshold: float) -> str:
    """The scan for the given templates and phrases, without the join's filters: every window against every template. (Only documents that have
    enough of a template's words at all are cut into windows.)"""
    from math import ceil

    from dictspark.llm.common import alnum_words

    def listed(words: list[bytes]) -> str:
        return "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"

    sets = [(label, sorted(set(words)), ceil(len(words) / threshold - 1e-9)) for label, text in templates if (words := alnum_words(text))]
    t = ",\n".join(f"('{label}', {listed(s)}, {ceil(threshold * len(s) - 1e-9)}, {window})" for label, s, window in sets)
    p = ", ".join(f"('{label}', {listed(alnum_words(phrase))})" for phrase, label in phrases.items())
    return f"""WITH t(label, s, need, size) AS (VALUES {t}),
p(label, s) AS (VALUES {p}),
d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_WORDS}), []) AS w FROM documents),
place AS (SELECT doc_id, label, i FROM (SELECT doc_id, w, label, s, unnest(range(1, len(w) - len(s) + 2)) AS i FROM d, p) WHERE w[i:i + len(s) - 1] = s),
base AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word FROM place GROUP BY doc_id),
able AS (SELECT doc_id, w, label, s, need, size FROM d, t WHERE len(list_intersect(list_distinct(w), s)) >= need),
b AS (SELECT doc_id, label, s, need, list_distinct(w[i:i + size - 1]) AS b FROM (SELECT *, unnest(range(1, greatest(1, len(w) - size + 1) + 1)) AS i FROM able)),
hit AS (SELECT doc_id, label, len(list_intersect(b, s)) / len(s) AS share FROM b WHERE len(list_intersect(b, s)) >= need),
best AS (SELECT doc_id, max(share) AS share FROM hit GROUP BY doc_id),
own AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY doc_id),
every AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM place UNION SELECT doc_id, label FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(own.labels, '') AS base_labels,
coalesce(every.labels, '') AS labels, CASE WHEN n_base IS NOT NULL THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN every USING (doc_id)"""


def packing(n_buckets: int, token_budget: int, cell_rows: int) -> str:
    """The dynamic program bucket by bucket, for at most as many distinct lengths as the histogram has bins. A state's cost and the place where
    its last bucket begins are one number, so that the least is the cheapest and, of these, the earliest."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, len(coalesce(regexp_extract_all(text, '[^{_SPACE}]+'), []))::BIGINT AS n, md5(concat(doc_id, ':', coalesce(text, ''))) AS h FROM documents),
x AS (SELECT row_number() OVER (ORDER BY n) AS j, n, sum(c) OVER (ORDER BY n)::BIGINT AS number, sum(c * n) OVER (ORDER BY n)::BIGINT AS total FROM (SELECT n, count(*) AS c FROM d
  GROUP BY n)),
z AS (SELECT 0::BIGINT AS j, 0::BIGINT AS n, 0::BIGINT AS number, 0::BIGINT AS total UNION ALL SELECT * FROM x),
k AS (SELECT least({n_buckets}, count(*)) AS k FROM x),
dp AS (SELECT 0::BIGINT AS b, 0::BIGINT AS j, 0::BIGINT AS code UNION ALL
SELECT dp.b + 1, e.j, min((dp.code // 65536 + e.n * (e.number - s.number) - (e.total - s.total)) * 65536 + s.j) FROM dp JOIN z s ON s.j = dp.j JOIN x e ON e.j > dp.j
  WHERE dp.b < (SELECT k FROM k) GROUP BY dp.b, e.j),
way AS (SELECT k AS b, (SELECT max(j) FROM x) AS j FROM k WHERE k > 0 UNION ALL SELECT way.b - 1, dp.code % 65536 FROM way JOIN dp ON dp.b = way.b AND dp.j = way.j WHERE way.b > 1),
up AS (SELECT way.b - 1 AS bucket, n AS bucket_len FROM way JOIN x USING (j)),
p AS (SELECT doc_id, n, h, min(bucket_len) AS bucket_len, min(bucket) AS bucket FROM d JOIN up ON up.bucket_len >= n GROUP BY doc_id, n, h),
c AS (SELECT *, (('0x' || substr(h, 1, 8))::BIGINT) % greatest(1, (count(*) OVER (PARTITION BY bucket) + {cell_rows - 1}) // {cell_rows}) AS cell,
  greatest(1, {token_budget} // greatest(bucket_len, 1)) AS each FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY bucket, cell ORDER BY h, doc_id) - 1 AS place FROM c)
SELECT doc_id, n AS n_tokens, bucket::INTEGER AS bucket, bucket_len, concat(bucket, '-', cell, '-', place // each) AS batch_id, place % each AS slot, bucket_len - n AS padding FROM o"""


def chats(moves: dict, close: dict, roles: tuple, aliases: dict, part_turns: int, insert: int) -> str:
    """Costs ahead from the last turn back, then the steps forward. moves, close, roles and aliases are the automaton's own tables."""
    steps = ", ".join(f"({s}, {r}, {i}, {cost}, {to}, '{what}', {put})" for (s, r), own in moves.items() for i, (cost, to, what, put) in enumerate(own))
    named = " ".join(f"WHEN '{name}' THEN {state}" for name, state in aliases.items())
    role = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(roles))
    ends = ", ".join(f"({s}, {insert * len(own)}, {len(own)}, '{''.join(f'<|end|>{chr(10)}<|{roles[x]}|>{chr(10)}' for x in own)}', '{''.join(f',close:{roles[x]}' for x in own)}')" for s, own in close.items())
    return f"""WITH RECURSIVE m(s, role, i, cost, dst, what, put) AS (VALUES {steps}), e(s, cost, n, piece, acts) AS (VALUES {ends}),
t AS (SELECT conv_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
  CASE lower(trim(coalesce(role, ''))) {named} ELSE 0 END AS role,
  replace(coalesce(text, ''), '<|', '<\\|') AS text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, md5(text) NULLS LAST)),
g AS (SELECT DISTINCT conv_id, t.n + 1 AS pos, e.s, e.cost::BIGINT AS cost FROM t, e UNION ALL
SELECT g.conv_id, t.pos, m.s, min(m.cost + g.cost) FROM g JOIN t ON t.conv_id IS NOT DISTINCT FROM g.conv_id AND t.pos = g.pos - 1 JOIN m ON m.role = t.role AND m.dst = g.s
  GROUP BY g.conv_id, t.pos, m.s),
f AS (SELECT DISTINCT conv_id, 1::BIGINT AS pos, 0 AS s FROM t UNION ALL
SELECT f.conv_id, f.pos + 1, arg_min(m.dst, (m.cost + g.cost) * 100 + m.i) FROM f JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.pos = f.pos
  JOIN m ON m.s = f.s AND m.role = t.role JOIN g ON g.conv_id IS NOT DISTINCT FROM f.conv_id AND g.pos = f.pos + 1 AND g.s = m.dst GROUP BY f.conv_id, f.pos),
o AS (SELECT t.conv_id, t.pos, t.n, t.text, f.s, arg_min(struct_pack(cost := m.cost, dst := m.dst, what := m.what, put := m.put), (m.cost + g.cost) * 100 + m.i) AS x FROM f
  JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.pos = f.pos JOIN m ON m.s = f.s AND m.role = t.role JOIN g ON g.conv_id IS NOT DISTINCT
  FROM f.conv_id AND g.pos = f.pos + 1 AND g.s = m.dst GROUP BY t.conv_id, t.pos, t.n, t.text, f.s),
p AS (SELECT conv_id, pos, pos = n AS last, x, CASE WHEN x.what = 'merge' THEN chr(10) || text ELSE CASE WHEN s <> 0 THEN '<|end|>' || chr(10) ELSE '' END ||
  CASE WHEN x.put > 0 THEN '<|' || CASE x.put {role} END || '|>' || chr(10) || '<|end|>' || chr(10) ELSE '' END ||
  '<|' || CASE x.dst {role} END || '|>' || chr(10) || text END AS piece,
  CASE WHEN x.what = 'merge' THEN 0 WHEN x.put > 0 THEN 2 ELSE 1 END AS n_out FROM o)
SELECT conv_id, ((pos - 1) // {part_turns})::INTEGER AS part, count(*) AS n_turns,
  (sum(n_out) + sum(CASE WHEN last THEN e.n ELSE 0 END))::BIGINT AS n_out,
  (sum(x.cost) + sum(CASE WHEN last THEN e.cost ELSE 0 END))::BIGINT AS cost,
  string_agg(x.what || CASE WHEN last THEN e.acts ELSE '' END, ',' ORDER BY pos) AS actions,
  string_agg(p.piece || CASE WHEN last THEN e.piece || '<|end|>' || chr(10) ELSE '' END, '' ORDER BY pos) AS rendered
FROM p JOIN e ON e.s = x.dst GROUP BY conv_id, (pos - 1) // {part_turns}"""
