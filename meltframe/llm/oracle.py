"""DuckDB SQL with the same answers as the registered queries, where SQL can express them."""

from __future__ import annotations

from meltframe.llm.common import UPPER

ORACLE_SQL: dict[str, str] = {}

# The strings the template uses for control, in the order of their one-letter codes a, b, c ...
CONTROLS = ["<s>", "</s>", "[ROLE]", "[/ROLE]", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[OUT]", "[/OUT]"]

# What may follow what.
MOVES = ["start>system", "start>user", "system>user", "user>assistant", "assistant>user"]


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\0')"
    for i, mark in enumerate(CONTROLS):
        out = f"replace({out}, '{mark}', '\\{chr(97 + i)}')"
    return out


ORACLE_SQL["op5_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, CASE role WHEN 'system' THEN '<s>[SYS]' || {_escaped("text")} || '[/SYS]</s>'
  WHEN 'user' THEN '<s>[INST]' || {_escaped("text")} || '[/INST]</s>'
  WHEN 'assistant' THEN '<s>[OUT]' || {_escaped("text")} || '[/OUT]</s>'
  ELSE '<s>[ROLE]' || {_escaped("role")} || '[/ROLE]' || {_escaped("text")} || '</s>' END AS shown,
  row_number() OVER turns - 1 AS place, coalesce(lag(role) OVER turns, 'start') || '>' || role IN ({", ".join(f"'{m}'" for m in MOVES)}) AS goes FROM t
  WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
b AS (SELECT *, CASE WHEN NOT goes THEN place WHEN place = max(place) OVER (PARTITION BY conv_id) AND role <> 'assistant' THEN place + 1 END AS bad FROM f)
SELECT conv_id, count(*) AS n_turns, min(bad) IS NULL AS valid, CAST(min(bad) AS INT) AS bad_turn,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(shown)) AS BIGINT) AS formatted_chars
FROM b GROUP BY conv_id
"""

ORACLE_SQL["op8_source_mix"] = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS stop FROM s),
l AS (SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(stop) OVER before, 0))
    / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY stop / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(stop, coalesce(weight * (SELECT level FROM l WHERE stop / weight > level ORDER BY stop / weight, place LIMIT 1), stop)) AS target FROM l),
q AS (SELECT g.*, s.place, CAST(floor(target) AS BIGINT) AS words, CAST(ceil(floor(target) / 1024) AS BIGINT) AS slots
  FROM g JOIN s ON g.source IS NOT DISTINCT FROM s.source),
-- a source's interval of [0, 2^32), as wide as its share of all slots
i AS (SELECT place, slots, "all", CAST(floor((upto - slots) / "all" * 4294967296) AS BIGINT) AS low, CAST(floor(upto / "all" * 4294967296) AS BIGINT) AS high
  FROM (SELECT *, (sum(slots) OVER (ORDER BY place))::DOUBLE AS upto, (sum(slots) OVER ())::DOUBLE AS "all" FROM q WHERE target >= 1)),
-- golden-ratio points; a source's points in order take its blocks
c AS (SELECT slot, place, block FROM (
    SELECT slot, place, slots, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS block
    FROM (SELECT r AS slot, (r % 2147483648) * 2654435769 % 4294967296 AS spot FROM range(CAST((SELECT 3 * max("all") + 8 FROM i) AS BIGINT)) t(r))
    JOIN i ON spot >= low AND spot < high) WHERE block < slots),
o AS (SELECT row_number() OVER () AS row, d.doc_id, d.size, q.place, q.source_size, q.target, q.words,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT row, min(slot) AS first_slot
  FROM (SELECT row, place, unnest([start, source_size + start]) AS a, size, words FROM o) p
  JOIN c ON c.place = p.place AND least(p.a + p.size, p.words, (block + 1) * 1024) > greatest(p.a, block * 1024) GROUP BY row)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(start + size, words) - start) + greatest(0, least(source_size + start + size, words) - source_size - start) AS BIGINT) AS taken,
  CAST(first_slot AS BIGINT) AS first_slot
FROM o LEFT JOIN k USING (row)
"""

ORACLE_SQL["op9_exact_dedup"] = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

ORACLE_SQL["op2_minhash_near_dedup"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(list_transform(s, lambda g: hash(g))) AS shingle FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN least_of USING (doc_id)
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(sha, {1 + 5 * g}, 5) AS INT) >> {shift}) & 31), 1)"
    for g in range(8) for shift in (15, 10, 5, 0))

ORACLE_SQL["op4_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""

ORACLE_SQL["op10_nearest_vectors"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""


def _framed(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# CRC-32 bit by bit over the ASCII codes of the decimal id
_CRC32 = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))))"""

ORACLE_SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {_CRC32} % 5 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} END AS altered
  FROM documents),
p AS (SELECT row_number() OVER () AS row, doc_id, leaf, altered, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, altered) - 1 AS spot FROM d),
n(tree, lvl, spot, width, digest) AS (
  SELECT tree, 0, spot, count(*) OVER (PARTITION BY tree), leaf FROM p
  UNION ALL SELECT tree, lvl + 1, spot // 16, (width + 15) // 16, sha256(string_agg(digest, '' ORDER BY spot)) FROM n WHERE width > 1
  GROUP BY tree, lvl, spot // 16, width),
s AS (SELECT tree, digest AS subroot FROM n WHERE width = 1),
m(lvl, spot, width, digest) AS (
  SELECT 0, tree, count(*) OVER (), subroot FROM s
  UNION ALL SELECT lvl + 1, spot // 16, (width + 15) // 16, sha256(string_agg(digest, '' ORDER BY spot)) FROM m WHERE width > 1 GROUP BY lvl, spot // 16, width),
r AS (SELECT digest AS root FROM m WHERE width = 1),
h AS (SELECT tree, max(lvl) AS height FROM n GROUP BY tree),
-- one step per level of the source's tree, then of the tree of subroots
step(row, tree, lvl, spot, node, proof) AS (
  SELECT row, tree, 0, spot, coalesce(altered, leaf), '' FROM p
  UNION ALL SELECT row, tree, lvl + 1, any_value(CASE WHEN lvl + 1 = height THEN tree ELSE spot // 16 END),
    sha256(string_agg(CASE WHEN mine THEN node ELSE digest END, '' ORDER BY sibling)),
    any_value(proof) || coalesce(string_agg(digest, '' ORDER BY sibling) FILTER (WHERE NOT mine), '')
  FROM (
    SELECT step.*, h.height, x.spot AS sibling, x.digest, x.spot = step.spot AS mine FROM step JOIN h USING (tree)
    JOIN n x ON x.tree = step.tree AND x.lvl = step.lvl AND x.spot // 16 = step.spot // 16 WHERE step.lvl < h.height AND x.width > 1
    UNION ALL
    SELECT row, tree, u.lvl, u.at_top, node, proof, -1, x.spot, x.digest, x.spot = u.at_top
    FROM (SELECT step.*, height, CASE WHEN lvl = height THEN tree ELSE spot END AS at_top FROM step JOIN h USING (tree) WHERE lvl >= height) u
    JOIN m x ON x.lvl = u.lvl - u.height AND x.width > 1 AND x.spot // 16 = u.at_top // 16)
  GROUP BY row, tree, lvl),
last AS (SELECT row, arg_max(node, lvl) AS folded_root, arg_max(proof, lvl) AS proof FROM step GROUP BY row)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN last USING (row) JOIN s USING (tree), r
"""
