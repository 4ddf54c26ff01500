"""DuckDB SQL twins of the registered queries, written on their own from the operators' definitions."""

from __future__ import annotations

#: Two snapshots of the documents, and their lines and words.
UNITS = r"""
du AS (SELECT coalesce(lang, '?') AS diff_id, doc_id, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT diff_id, 'L' AS side, doc_id + 1 AS addr, 'doc_' || doc_id AS name, CASE WHEN doc_id % 10 = 4 THEN text || ' #1' ELSE text END AS text FROM du WHERE doc_id % 10 <> 9
  UNION ALL
  SELECT diff_id, 'R', doc_id + 1, CASE WHEN doc_id % 10 = 1 THEN 'ren_' ELSE 'doc_' END || doc_id,
    CASE doc_id % 10 WHEN 2 THEN text || chr(10) || 'appended tail line' WHEN 3 THEN array_to_string(list_reverse(string_split(text, chr(10))), chr(10)) WHEN 4 THEN text || ' #2' ELSE text END
  FROM du WHERE doc_id % 10 <> 0),
b AS (SELECT diff_id, side, addr AS func_addr, i AS block_addr, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS ls FROM u))),
bw AS (SELECT *, list_filter(string_split(line, ' '), lambda w: w <> '') AS ws FROM b),
t AS (SELECT diff_id, side, func_addr, block_addr, k - 1 AS line_no, ws[k] AS text, regexp_full_match(ws[k], '#?[0-9]+') AS imm FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM bw))
"""

BLOCKS = r"""
bs AS (SELECT diff_id, side, func_addr, block_addr, line, md5(line) AS byte_hash, len(ws) AS instr_count,
  CASE WHEN len(ws) = 0 THEN '' ELSE array_to_string(list_transform(ws, lambda w: CASE WHEN regexp_full_match(w, '#?[0-9]+') THEN '' ELSE w || ' ' END), chr(10)) || chr(10) END AS mnemonic_sig,
  CASE WHEN block_addr > 1 THEN 1 ELSE 0 END AS in_degree, CASE WHEN block_addr < count(*) OVER (PARTITION BY diff_id, side, func_addr) THEN 1 ELSE 0 END AS out_degree FROM bw)
"""

HASHES = r"""
uh AS (SELECT diff_id, side, func_addr, md5(string_agg(hex(encode(line)), '' ORDER BY block_addr)) AS byte_hash, md5(string_agg(mnemonic_sig, '' ORDER BY block_addr)) AS norm_hash, count(*) AS nodes, count(*) - 1 AS edges, CAST(sum(instr_count) AS BIGINT) AS instr_count FROM bs GROUP BY ALL),
uc AS (SELECT diff_id, side, func_addr, count(*) AS calls FROM t WHERE text LIKE '%.' GROUP BY ALL)
"""

PRIMES = r"""
ops AS (SELECT diff_id, side, func_addr, 'op' AS kind, lower(substr(text, 1, 2)) AS m FROM t WHERE NOT imm UNION ALL SELECT diff_id, side, func_addr, 'ast', 'hlil:' || length(text) FROM t WHERE NOT imm),
pr AS (SELECT p, row_number() OVER (ORDER BY p) AS rn FROM range(2, 30000) r(p) WHERE NOT EXISTS (SELECT 1 FROM range(2, 174) q(d) WHERE d * d <= p AND p % d = 0)),
dict AS (SELECT m, p FROM (SELECT m, row_number() OVER (ORDER BY encode(m)) AS rn FROM (SELECT DISTINCT m FROM ops)) JOIN pr USING (rn)),
pp AS (SELECT diff_id, side, func_addr, kind, list_reduce(list_prepend(CAST(1 AS UHUGEINT), list(CAST(p AS UHUGEINT))), lambda a, x: (a * x) % CAST(18446744073709551557 AS UHUGEINT)) AS product FROM ops JOIN dict USING (m) GROUP BY ALL),
sp AS (SELECT diff_id, side, func_addr, max(product) FILTER (kind = 'op') AS spp, max(product) FILTER (kind = 'ast') AS pseudo_primes FROM pp GROUP BY ALL),
ph AS (SELECT diff_id, side, func_addr, md5(string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY block_addr, line_no)) AS pseudo_hash FROM t WHERE NOT imm GROUP BY ALL)
"""

GRAPH = r"""
md AS (SELECT diff_id, side, func_addr, sum(1 / sqrt(sqrt(2) * a.in_degree + sqrt(3) * a.out_degree + sqrt(5) * z.in_degree + sqrt(7) * z.out_degree)) AS md_index
  FROM bs a JOIN bs z USING (diff_id, side, func_addr) WHERE z.block_addr = a.block_addr + 1 GROUP BY ALL)
"""

REFS = r"""
rc AS (SELECT diff_id, side, addr AS func_addr, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: CASE WHEN length(x) <= 18 THEN TRY_CAST(x AS BIGINT) ELSE CAST('0x' || substr(md5(x), 1, 15) AS BIGINT) END))) AS constants FROM u),
rs AS (SELECT diff_id, side, func_addr, list_sort(list_distinct(list(CAST('0x' || substr(md5(text), 1, 15) AS BIGINT)))) AS string_hashes FROM t WHERE contains(text, '@') GROUP BY ALL)
"""

FEATURES = r"""
f AS (SELECT u.diff_id, u.side, u.addr, u.name, h.nodes, h.edges, coalesce(c.calls, 0) AS calls, h.instr_count, h.byte_hash, h.norm_hash, coalesce(s.spp, 1) AS spp, s.pseudo_primes, p.pseudo_hash,
  coalesce(m.md_index, 0.0) AS md_index, CAST(round(coalesce(m.md_index, 0.0) * 1e6) AS BIGINT) AS md_q, coalesce(rc.constants, []) AS constants, coalesce(rs.string_hashes, []) AS string_hashes
  FROM u JOIN uh h ON u.diff_id = h.diff_id AND u.side = h.side AND u.addr = h.func_addr
  LEFT JOIN uc c ON u.diff_id = c.diff_id AND u.side = c.side AND u.addr = c.func_addr
  LEFT JOIN sp s ON u.diff_id = s.diff_id AND u.side = s.side AND u.addr = s.func_addr
  LEFT JOIN ph p ON u.diff_id = p.diff_id AND u.side = p.side AND u.addr = p.func_addr
  LEFT JOIN md m ON u.diff_id = m.diff_id AND u.side = m.side AND u.addr = m.func_addr
  LEFT JOIN rc ON u.diff_id = rc.diff_id AND u.side = rc.side AND u.addr = rc.func_addr
  LEFT JOIN rs ON u.diff_id = rs.diff_id AND u.side = rs.side AND u.addr = rs.func_addr)
"""

ALL = ",".join((UNITS, BLOCKS, HASHES, PRIMES, GRAPH, REFS, FEATURES))


def over(*parts: str) -> str:
    return "WITH " + ",".join(parts)


#: Key and eligibility of each pass, in execution order.
PASS_SQL = {
    "bytehash": ("byte_hash", "true", 1.00),
    "normhash": ("norm_hash", "true", 0.99),
    "name+shape": ("name || '|' || nodes || '|' || edges || '|' || calls", "name <> ''", 0.98),
    "name": ("name", "name <> ''", 0.92),
    "mdindex": ("CAST(md_q AS VARCHAR)", "nodes >= 5", 0.95),
    "mdindex+spp": ("md_q || '|' || spp", "nodes >= 2", 0.90),
    "pseudocode": ("pseudo_hash", "pseudo_hash IS NOT NULL", 0.88),
    "pseudoprimes": ("pseudo_primes || '|' || nodes", "pseudo_primes > 1", 0.85),
    "nec": ("nodes || '|' || edges || '|' || calls", "nodes >= 5", 0.82),
    "spp": ("CAST(spp AS VARCHAR)", "instr_count >= 8", 0.80),
    "constants+strings": ("array_to_string(list_concat(constants, string_hashes), ',')", "len(constants) + len(string_hashes) >= 2", 0.65),
}


def unique_pairs(name: str, source: str) -> str:
    key, when, confidence = PASS_SQL[name]
    one = "SELECT diff_id, {0} AS k, min(addr) AS addr FROM {1} WHERE side = '{2}' AND {3} AND {0} IS NOT NULL GROUP BY ALL HAVING count(*) = 1"
    left, right = (f"({one.format(f'({key})', source, s, when)})" for s in "LR")
    return f"SELECT l.diff_id, l.addr AS left_addr, r.addr AS right_addr, CAST({confidence} AS DOUBLE) AS confidence, '{name}' AS algorithm FROM {left} l JOIN {right} r ON l.diff_id = r.diff_id AND l.k = r.k"


def cascade_ctes(names: tuple[str, ...] = tuple(PASS_SQL)) -> str:
    out, seen = ["fm AS MATERIALIZED (SELECT * FROM f)"], None
    for i, name in enumerate(names):
        source = "fm"
        if seen:
            out.append(f"o{i} AS MATERIALIZED (SELECT * FROM fm WHERE NOT EXISTS (SELECT 1 FROM c{i - 1} c WHERE c.diff_id = fm.diff_id AND CASE WHEN fm.side = 'L' THEN c.left_addr ELSE c.right_addr END = fm.addr))")
            source = f"o{i}"
        pairs = unique_pairs(name, source)
        out.append(f"c{i} AS MATERIALIZED ({f'SELECT * FROM c{i - 1} UNION ALL ' if seen else ''}{pairs})")
        seen = True
    return ",\n".join(out)


LAST = f"c{len(PASS_SQL) - 1}"
CASCADE = over(ALL, cascade_ctes())

BLOCK_BASE = r"""
mb AS MATERIALIZED (SELECT * FROM c1),
bl AS (SELECT m.diff_id, m.left_addr AS left_func, m.right_addr AS right_func, s.block_addr, s.byte_hash, s.mnemonic_sig, s.instr_count, s.in_degree, s.out_degree, row_number() OVER (PARTITION BY m.diff_id, m.left_addr ORDER BY s.block_addr) AS pos FROM mb m JOIN bs s ON m.diff_id = s.diff_id AND s.side = 'L' AND m.left_addr = s.func_addr),
br AS (SELECT m.diff_id, m.left_addr AS left_func, m.right_addr AS right_func, s.block_addr, s.byte_hash, s.mnemonic_sig, s.instr_count, s.in_degree, s.out_degree, row_number() OVER (PARTITION BY m.diff_id, m.left_addr ORDER BY s.block_addr) AS pos FROM mb m JOIN bs s ON m.diff_id = s.diff_id AND s.side = 'R' AND m.right_addr = s.func_addr),
ba AS MATERIALIZED (SELECT l.diff_id, l.left_func, l.right_func, l.block_addr AS left_addr, r.block_addr AS right_addr, 'identical' AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY diff_id, left_func, right_func, byte_hash ORDER BY pos) AS n FROM bl) l
  JOIN (SELECT *, row_number() OVER (PARTITION BY diff_id, left_func, right_func, byte_hash ORDER BY pos) AS n FROM br) r USING (diff_id, left_func, right_func, byte_hash, n)),
bl1 AS (SELECT * FROM bl WHERE NOT EXISTS (SELECT 1 FROM ba WHERE ba.diff_id = bl.diff_id AND ba.left_func = bl.left_func AND ba.left_addr = bl.block_addr)),
br1 AS (SELECT * FROM br WHERE NOT EXISTS (SELECT 1 FROM ba WHERE ba.diff_id = br.diff_id AND ba.right_func = br.right_func AND ba.right_addr = br.block_addr)),
bb AS (SELECT l.diff_id, l.left_func, l.right_func, l.block_addr AS left_addr, r.block_addr AS right_addr, 'changed' AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY diff_id, left_func, right_func, mnemonic_sig ORDER BY pos) AS n FROM bl1) l
  JOIN (SELECT *, row_number() OVER (PARTITION BY diff_id, left_func, right_func, mnemonic_sig ORDER BY pos) AS n FROM br1) r USING (diff_id, left_func, right_func, mnemonic_sig, n))
"""


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END"


def fuzzy_score() -> str:
    rel = lambda c: f"(1.0::DOUBLE - abs(l.{c} - r.{c})::DOUBLE / greatest(l.{c}, r.{c}, 1)::DOUBLE)"
    terms = ["0.0::DOUBLE", *(rel(c) for c in ("nodes", "edges", "calls", "instr_count"))]
    terms.append("(1.0::DOUBLE - least(1.0::DOUBLE, abs(l.md_index - r.md_index) / (greatest(l.md_index, r.md_index) + 1e-9::DOUBLE)))")
    terms.append("CASE WHEN l.spp = r.spp THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END")
    terms.append(f"2.0::DOUBLE * ({jaccard('l.constants', 'r.constants')})")
    both = "(l.pseudo_primes IS NOT NULL AND r.pseudo_primes IS NOT NULL)"
    terms.append(f"CASE WHEN {both} AND l.pseudo_primes = r.pseudo_primes THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END")
    return f"(({' + '.join(terms)}) / CASE WHEN {both} THEN 11.0::DOUBLE ELSE 9.0::DOUBLE END)"


#: Events: halves of each user's events, transitions between types.
EVENTS = r"""
e0 AS (SELECT *, ntile(2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS half FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
e AS (SELECT CASE WHEN half = 1 THEN 'L' ELSE 'R' END AS side, user_id + 1 AS func_addr, ts, event_id, event_type AS block FROM e0),
eg AS (SELECT DISTINCT side, func_addr, block AS src, nxt AS dst FROM (SELECT *, lead(block) OVER (PARTITION BY side, func_addr ORDER BY ts, event_id) AS nxt FROM e) WHERE nxt IS NOT NULL),
eb AS (SELECT DISTINCT side, func_addr, block FROM e),
ed AS (SELECT eb.side, eb.func_addr, eb.block, (SELECT count(*) FROM eg WHERE eg.side = eb.side AND eg.func_addr = eb.func_addr AND eg.dst = eb.block) AS in_degree, (SELECT count(*) FROM eg WHERE eg.side = eb.side AND eg.func_addr = eb.func_addr AND eg.src = eb.block) AS out_degree FROM eb)
"""
