"""DuckDB twins of the catalogue's queries."""

from __future__ import annotations

_M = """o AS (SELECT CAST(o_orderkey AS BIGINT) i, CAST(o_custkey AS BIGINT) c FROM orders),
tot AS (SELECT max(i) + 1 AS n FROM o),
m0 AS (SELECT i, c, CAST(j AS INTEGER) j, i // 64 AS b, (j > 0 AND (i // 64 + j) % 11 = 0) AS inv FROM o, (SELECT unnest(range(5)) AS j)),
m1 AS (SELECT *, CASE WHEN inv THEN b * 64 + 63 - i % 64 WHEN j = 2 AND i % 37 = 5 AND i % 64 <> 63 THEN i + 1
  WHEN j = 2 AND i % 37 = 6 AND i % 64 <> 0 THEN i - 1 ELSE i END AS slot FROM m0),
mums AS MATERIALIZED (SELECT i AS mum_id, j AS seq_idx, CAST(slot * {slot} + (c * (j + 3) + i) % 136 AS BIGINT) AS start, CAST(20 + c % 100 AS BIGINT) AS length, NOT inv AS strand FROM m1),
part_ AS (SELECT mum_id, seq_idx, CASE WHEN seq_idx > 0 AND mum_id % 29 = seq_idx THEN -1 ELSE start END AS start, length, strand FROM mums),
c0 AS (SELECT CAST(n_nationkey AS BIGINT) k, n_name AS contig, CAST(j AS INTEGER) AS seq_idx, CAST((n * 256 + 24) // 25 + (n_nationkey * 37 + j * 101) % 1000 AS BIGINT) AS length
  FROM nation, tot, (SELECT unnest(range(5)) AS j)),
contigs AS (SELECT seq_idx, CAST(k AS INTEGER) AS contig_idx, contig, length, CAST(sum(length) OVER (PARTITION BY seq_idx ORDER BY k) - length AS BIGINT) AS off FROM c0),
regions AS (SELECT CAST(s_suppkey AS BIGINT) AS region_id, CAST(s_suppkey % 5 AS INTEGER) AS seq_idx, (s_suppkey * 38197) % (n * 256 - 60000) AS start,
  (s_suppkey * 38197) % (n * 256 - 60000) + 1000 + s_nationkey * 1000 AS "end" FROM supplier, tot)"""
_B = """,
np AS (SELECT seq_idx, CASE WHEN strand THEN mum_id ELSE nid END AS l, CASE WHEN strand THEN nid ELSE mum_id END AS r
  FROM (SELECT *, lead(mum_id) OVER w AS nid, lead(strand) OVER w AS nstrand FROM mums WINDOW w AS (PARTITION BY seq_idx ORDER BY start, mum_id)) WHERE strand = nstrand),
ca AS MATERIALIZED (SELECT l, r FROM np GROUP BY l, r HAVING count(*) = 5),
bl AS MATERIALIZED (SELECT min(l) AS s, max(l) + 1 AS e FROM (SELECT l, l - row_number() OVER (ORDER BY l) AS g FROM ca WHERE r = l + 1) GROUP BY g)"""
_O = """,
mk AS (SELECT mum_id, CAST(sum(CASE WHEN strand THEN 0 ELSE 1 << seq_idx END) AS BIGINT) AS mask FROM mums GROUP BY mum_id),
op AS (SELECT l FROM ca JOIN mk a ON a.mum_id = l JOIN mk b ON b.mum_id = r WHERE r = l + 1 AND a.mask = b.mask),
ob0 AS (SELECT min(l) AS s, max(l) + 1 AS e FROM (SELECT l, l - row_number() OVER (ORDER BY l) AS g FROM op) GROUP BY g),
ob AS (SELECT row_number() OVER (ORDER BY s) - 1 AS block, s, e, e - s + 1 AS n FROM ob0)"""
_L = """,
ml AS MATERIALIZED (SELECT seq_idx, start, max(mum_id) AS mum_id FROM mums GROUP BY seq_idx, start),
mr AS MATERIALIZED (SELECT seq_idx, start + length AS "end", min(mum_id) AS mum_id FROM mums GROUP BY ALL),
lf AS (SELECT r.region_id, r.seq_idx, r.start AS s, r."end" - 1 AS e_incl, a.mum_id AS left_id, b.mum_id AS right_id FROM regions r
  ASOF JOIN ml a ON a.seq_idx = r.seq_idx AND a.start <= r.start ASOF JOIN mr b ON b.seq_idx = r.seq_idx AND b."end" >= r."end"),
bd AS MATERIALIZED (SELECT lf.*, a.start AS left_start, a.start + a.length AS left_end, b.start AS right_start, b.start + b.length AS right_end
  FROM lf JOIN mums a ON a.mum_id = left_id AND a.seq_idx = lf.seq_idx JOIN mums b ON b.mum_id = right_id AND b.seq_idx = lf.seq_idx),
ofs AS (SELECT *, CASE WHEN s < left_end THEN s - left_start ELSE 0 END AS left_off, CASE WHEN e_incl >= right_start THEN e_incl - right_start ELSE 0 END AS right_off,
  CASE WHEN s < left_end THEN 0 ELSE s - (left_end - 1) END AS left_margin, CASE WHEN e_incl >= right_start THEN 0 ELSE right_start - e_incl END AS right_margin FROM bd),
lift AS (SELECT region_id, a.seq_idx, a.start + left_off AS start, b.start + right_off AS end_incl FROM ofs
  JOIN mums a ON a.mum_id = left_id JOIN mums b ON b.mum_id = right_id AND b.seq_idx = a.seq_idx),
loc AS (SELECT lift.*, a.contig AS ac, a.off AS ao, b.contig AS bc, b.off AS bo FROM lift
  LEFT JOIN contigs a ON a.seq_idx = lift.seq_idx AND a.off <= start AND start < a.off + a.length
  LEFT JOIN contigs b ON b.seq_idx = lift.seq_idx AND b.off <= end_incl AND end_incl < b.off + b.length)"""
_G = """,
gp AS MATERIALIZED (SELECT unnest(range(s, e)) AS gap FROM bl),
nx AS MATERIALIZED (SELECT mum_id - 1 AS gap, seq_idx, start, length FROM mums),
gaps AS MATERIALIZED (SELECT gp.gap, a.seq_idx, CASE WHEN b.start < a.start THEN b.start + b.length ELSE a.start + a.length END AS "left",
    CASE WHEN b.start < a.start THEN a.start ELSE b.start END AS "right",
    abs(a.start - b.start) - CASE WHEN b.start < a.start THEN b.length ELSE a.length END AS gap_len
  FROM gp JOIN mums a ON a.mum_id = gp.gap JOIN nx b ON b.gap = gp.gap AND b.seq_idx = a.seq_idx),
md AS (SELECT gap, median(gap_len) AS med FROM gaps GROUP BY gap),
mdd AS (SELECT gap, seq_idx, gap_len, med FROM gaps JOIN md USING (gap)),
mad AS (SELECT gap, CASE WHEN median(abs(gap_len - med)) = 0 THEN 1.0 ELSE median(abs(gap_len - med)) END AS mad FROM mdd GROUP BY gap),
outl AS (SELECT gap, seq_idx, gap_len, med, mad, gap_len < med - 2.0 * mad AS masked FROM mdd JOIN mad USING (gap))"""
_C = """,
cr AS (SELECT mum_id, row_number() OVER (ORDER BY mum_id) AS rn FROM (SELECT unnest(range(s, e + 1)) AS mum_id FROM bl)),
ce AS (SELECT cr.rn, a.mum_id, a.seq_idx, a.start + a.length AS "end", b.start AS nstart FROM cr JOIN mums a USING (mum_id)
  LEFT JOIN cr n ON n.rn = cr.rn + 1 LEFT JOIN mums b ON b.mum_id = n.mum_id AND b.seq_idx = a.seq_idx),
cb AS (SELECT ce.mum_id, bool_or(x.contig IS NULL OR x.off = ce."end" OR coalesce(x.contig_idx <> y.contig_idx, false)) AS brk FROM ce
  LEFT JOIN contigs x ON x.seq_idx = ce.seq_idx AND x.off <= ce."end" AND ce."end" < x.off + x.length
  LEFT JOIN contigs y ON y.seq_idx = ce.seq_idx AND y.off <= ce.nstart AND ce.nstart < y.off + y.length GROUP BY ce.mum_id)"""
_S = """,
sr AS (SELECT cr.rn, mum_id, brk, bool_and(strand) AS fwd, max(start + length) FILTER (seq_idx = 0) AS e0, max(start + length) FILTER (seq_idx = 1) AS e1,
    max(start + length) FILTER (seq_idx = 2) AS e2, max(start + length) FILTER (seq_idx = 3) AS e3, max(start + length) FILTER (seq_idx = 4) AS e4
  FROM cr JOIN cb USING (mum_id) JOIN mums USING (mum_id) GROUP BY cr.rn, mum_id, brk),
fold AS (
  SELECT CAST(0 AS BIGINT) AS rn, false AS cut, CAST(0 AS BIGINT) AS l0, CAST(0 AS BIGINT) AS l1, CAST(0 AS BIGINT) AS l2, CAST(0 AS BIGINT) AS l3, CAST(0 AS BIGINT) AS l4
  UNION ALL
  SELECT sr.rn, x.cut, CASE WHEN x.cut THEN e0 ELSE l0 END, CASE WHEN x.cut THEN e1 ELSE l1 END, CASE WHEN x.cut THEN e2 ELSE l2 END, CASE WHEN x.cut THEN e3 ELSE l3 END, CASE WHEN x.cut THEN e4 ELSE l4 END
  FROM fold JOIN sr ON sr.rn = fold.rn + 1, LATERAL (SELECT sr.brk OR (sr.fwd AND e0 + e1 + e2 + e3 + e4 - l0 - l1 - l2 - l3 - l4 > 5 * 20000) AS cut) x),
cuts AS (SELECT mum_id, unnest([0, 1, 2, 3, 4]) AS seq_idx, unnest([e0, e1, e2, e3, e4]) AS "end" FROM fold JOIN sr USING (rn) WHERE fold.cut)"""
_SP = """,
sp0 AS (SELECT seq_idx, start // 200 AS bin, min(start) AS span_min, max(start + length) AS span_max FROM mums GROUP BY ALL)"""

#: Unique matches by trying every substring of the first sequence: t holds each sequence, or both its strands, n its length.
_UNIQUE = """,
u AS (SELECT grp, i AS p0, l, substr(s0, i, l) AS w, t0, t1, t2, n0, n1, n2 FROM
  (SELECT *, unnest(range(16, CAST(n0 - i + 2 AS BIGINT))) AS l FROM (SELECT *, unnest(range(1, n0 - 14)) AS i FROM q))),
f AS (SELECT *, instr(t0, w) AS a0, instr(t1, w) AS a1, instr(t2, w) AS a2 FROM u),
g AS (SELECT * FROM f WHERE a0 = p0 AND a1 > 0 AND a2 > 0 AND instr(substr(t0, a0 + 1), w) = 0 AND instr(substr(t1, a1 + 1), w) = 0 AND instr(substr(t2, a2 + 1), w) = 0),
e AS (SELECT *, [substr('<' || t0, a0, 1), substr('>' || t1, a1, 1), substr('=' || t2, a2, 1)] AS lc, [substr(t0 || '<', a0 + l, 1), substr(t1 || '>', a1 + l, 1), substr(t2 || '=', a2 + l, 1)] AS rc FROM g),
h AS (SELECT grp, l, row_number() OVER (PARTITION BY grp ORDER BY b0, b1, b2, l) - 1 AS match, [b0, b1, b2] AS starts, [true, a1 <= n1, a2 <= n2] AS fwd FROM
  (SELECT *, a0 - 1 AS b0, CASE WHEN a1 <= n1 THEN a1 - 1 ELSE 2 * n1 + 2 - a1 - l END AS b1, CASE WHEN a2 <= n2 THEN a2 - 1 ELSE 2 * n2 + 2 - a2 - l END AS b2 FROM e
   WHERE NOT (lc[1] = lc[2] AND lc[2] = lc[3]) AND NOT (rc[1] = rc[2] AND rc[2] = rc[3]))),
z AS (SELECT grp, match, l AS length, unnest([0, 1, 2]) AS seq_idx, unnest(starts) AS pos, unnest(fwd) AS strand FROM h)
"""


#: Unique matches of whole sequences x (seq_idx, s) by sorting all suffixes of both strands as strings; a text ends in a digit of its own.
_SUFFIXES = """tx AS (SELECT seq_idx, true AS fwd, length(s) AS n, s || CAST(seq_idx * 2 AS VARCHAR) AS t FROM x
  UNION ALL SELECT seq_idx, false, length(s), reverse(translate(s, 'acgt', 'tgca')) || CAST(seq_idx * 2 + 1 AS VARCHAR) FROM x),
su AS (SELECT seq_idx, fwd, n, i - 1 AS place, substr(t, i) AS a, CASE WHEN i = 1 THEN right(t, 1) ELSE substr(t, i - 1, 1) END AS bef FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM tx)),
l99 AS (SELECT *, row_number() OVER (ORDER BY a) AS rn, lag(a) OVER (ORDER BY a) AS b, 0 AS off FROM su),
""" + "".join(
    f"l{t} AS (SELECT * REPLACE (off + CASE WHEN substr(a, off + 1, {1 << t}) = substr(b, off + 1, {1 << t}) THEN {1 << t} ELSE 0 END AS off) FROM l{t + 1 if t < 16 else 99}),\n" for t in range(16, -1, -1)
) + """sa AS MATERIALIZED (SELECT seq_idx, fwd, n, place, bef, rn, off AS lcp, a FROM l0),
""" + "".join(
    f"""k{m} AS (SELECT rn AS r0, {m} AS m, long FROM (SELECT rn, lcp, min(lcp) OVER (ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND {m - 1} FOLLOWING) AS long,
  count(*) OVER (ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND {m - 1} FOLLOWING) AS have, lead(lcp, {m}, 0) OVER (ORDER BY rn) AS nxt FROM sa)
  WHERE have = {m - 1} AND long >= 16 AND lcp < long AND nxt < long),
""" for m in (3, 6)
) + """me AS (SELECT k.*, sa.seq_idx, sa.fwd, sa.bef, substr(a, long + 1, 1) AS aft, CASE WHEN fwd THEN place ELSE n - place - long END AS start
  FROM (SELECT * FROM k3 UNION ALL SELECT * FROM k6) k JOIN sa ON sa.rn BETWEEN r0 AND r0 + m - 1),
go AS (SELECT r0, m, long, list(start ORDER BY seq_idx) FILTER (m = 3 OR fwd) AS starts FROM me GROUP BY r0, m, long
  HAVING (m = 3 AND count(DISTINCT seq_idx) = 3 AND bool_or(fwd AND seq_idx = 0) AND min(bef) <> max(bef))
    OR (m = 6 AND count(DISTINCT (seq_idx, start)) = 3 AND count(DISTINCT (seq_idx, fwd)) = 6 AND min(bef) FILTER (fwd) <> max(bef) FILTER (fwd) AND min(aft) FILTER (fwd) <> max(aft) FILTER (fwd))),
nu AS (SELECT *, row_number() OVER (ORDER BY starts, long) - 1 AS match FROM go)
SELECT match, me.seq_idx, CAST(me.start AS BIGINT) AS pos, CAST(me.long AS BIGINT) AS length, me.fwd AS strand FROM nu JOIN me USING (r0, m) WHERE m = 3 OR fwd"""


#: The table with new matches in its gaps: unique matches by sorted suffixes for every item and set of genomes (x: part, genomes, seq_idx, s).
_REMATCH = """,
op AS (SELECT g.gap, g.seq_idx, "left" FROM gaps g JOIN outl o ON o.gap = g.gap AND o.seq_idx = g.seq_idx
  JOIN contigs a ON a.seq_idx = g.seq_idx AND a.off <= "left" AND "left" < a.off + a.length
  JOIN contigs b ON b.seq_idx = g.seq_idx AND b.off <= "right" - 1 AND "right" - 1 < b.off + b.length
  WHERE NOT masked AND "left" >= 0 AND "right" > "left" AND a.contig = b.contig AND g.gap IN (SELECT gap FROM gaps GROUP BY gap HAVING max(gap_len) >= 300)),
it AS (SELECT CAST(item_id AS BIGINT) AS grp, upper({dna}) AS t FROM benchmark),
pr AS MATERIALIZED (SELECT gap, grp, grp || ':' || present AS part, genomes FROM
  (SELECT gap, gap % n AS grp, string_agg(CAST(seq_idx AS VARCHAR), '' ORDER BY seq_idx) AS present, count(*) AS genomes FROM op, (SELECT max(grp) + 1 AS n FROM it) GROUP BY 1, 2) WHERE grp IN (SELECT grp FROM it)),
x0 AS (SELECT part, genomes, t, CAST(unnest(string_split(split_part(part, ':', 2), '')) AS INTEGER) AS seq_idx FROM (SELECT DISTINCT part, grp, genomes FROM pr) JOIN it USING (grp)),
x1 AS (SELECT part, genomes, seq_idx, left(t, length(t) // 2) || repeat(substr('ACGTA', seq_idx + 1, 1), seq_idx + 3) || substr(t, length(t) // 2 + 1) AS s FROM x0),
x AS (SELECT part, genomes, seq_idx, CASE WHEN seq_idx = 1 THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS s FROM x1),
tx AS (SELECT part, genomes, seq_idx, true AS fwd, length(s) AS n, s || CAST(seq_idx * 2 AS VARCHAR) AS t FROM x
  UNION ALL SELECT part, genomes, seq_idx, false, length(s), reverse(translate(s, 'ACGT', 'TGCA')) || CAST(seq_idx * 2 + 1 AS VARCHAR) FROM x),
su AS (SELECT part, genomes, seq_idx, fwd, n, i - 1 AS place, substr(t, i) AS a, CASE WHEN i = 1 THEN right(t, 1) ELSE substr(t, i - 1, 1) END AS bef FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM tx)),
l99 AS (SELECT *, row_number() OVER w AS rn, lag(a) OVER w AS b, 0 AS off FROM su WINDOW w AS (PARTITION BY part ORDER BY a)),
""" + "".join(
    f"l{t} AS (SELECT * REPLACE (off + CASE WHEN substr(a, off + 1, {1 << t}) = substr(b, off + 1, {1 << t}) THEN {1 << t} ELSE 0 END AS off) FROM l{t + 1 if t < 10 else 99}),\n" for t in range(10, -1, -1)
) + """sa AS MATERIALIZED (SELECT part, genomes, seq_idx, fwd, n, place, bef, rn, off AS lcp, a FROM l0),
k AS (""" + "\nUNION ALL ".join(
    f"""SELECT part, rn AS r0, {m} AS m, long FROM (SELECT part, rn, lcp, min(lcp) OVER f AS long, count(*) OVER f AS have, lead(lcp, {m}, 0) OVER (PARTITION BY part ORDER BY rn) AS nxt FROM sa
  WHERE genomes = {m} OR 2 * genomes = {m} WINDOW f AS (PARTITION BY part ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND {m - 1} FOLLOWING)) WHERE have = {m - 1} AND long >= 16 AND lcp < long AND nxt < long""" for m in (2, 3, 4, 5, 6, 8, 10)
) + """),
me AS MATERIALIZED (SELECT k.*, genomes, seq_idx, fwd, bef, substr(a, long + 1, 1) AS aft, CASE WHEN fwd THEN place ELSE n - place - long END AS start, min(seq_idx) OVER (PARTITION BY sa.part) AS lead_seq
  FROM k JOIN sa ON sa.part = k.part AND sa.rn BETWEEN r0 AND r0 + m - 1),
go AS (SELECT part, r0, m, long, list(start ORDER BY seq_idx) FILTER (m = genomes OR fwd) AS starts FROM me WHERE genomes > 1 GROUP BY part, r0, m, long, genomes
  HAVING (m = genomes AND count(DISTINCT seq_idx) = genomes AND bool_or(fwd AND seq_idx = lead_seq) AND min(bef) <> max(bef))
    OR (m = 2 * genomes AND count(DISTINCT (seq_idx, start)) = genomes AND count(DISTINCT (seq_idx, fwd)) = m AND min(bef) FILTER (fwd) <> max(bef) FILTER (fwd) AND min(aft) FILTER (fwd) <> max(aft) FILTER (fwd))),
nu AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY starts, long) - 1 AS match FROM go),
z AS (SELECT nu.part, match, seq_idx, me.start AS pos, me.long AS length, fwd AS strand FROM nu JOIN me ON me.part = nu.part AND me.r0 = nu.r0 AND me.m = nu.m WHERE nu.m = genomes OR fwd),
fd AS MATERIALIZED (SELECT pr.gap, match, z.seq_idx, "left" + pos AS start, length, strand FROM pr JOIN z USING (part) JOIN op ON op.gap = pr.gap AND op.seq_idx = z.seq_idx),
nb AS (SELECT gap, match, strand, lead(match) OVER w AS nm, lead(strand) OVER w AS ns FROM fd WINDOW w AS (PARTITION BY gap, seq_idx ORDER BY start, match)),
ck AS (SELECT gap, l, r FROM (SELECT gap, CASE WHEN strand THEN match ELSE nm END AS l, CASE WHEN strand THEN nm ELSE match END AS r FROM nb WHERE ns = strand) JOIN pr USING (gap) GROUP BY gap, l, r, genomes HAVING count(*) = genomes),
kp AS (SELECT DISTINCT gap, unnest([l, r]) AS match FROM ck),
le AS (SELECT gap, match, any_value(length) AS length FROM fd JOIN kp USING (gap, match) GROUP BY gap, match),
al AS MATERIALIZED (SELECT mum_id AS a, -1 AS b, seq_idx, start, length, strand FROM part_
  UNION ALL SELECT gap, match, j, coalesce(fd.start, -1), le.length, coalesce(fd.strand, false) FROM (SELECT *, CAST(unnest(range(5)) AS INTEGER) AS j FROM le) le LEFT JOIN fd USING (gap, match) WHERE fd.seq_idx = j
  UNION ALL SELECT gap, match, j, -1, le.length, false FROM (SELECT *, CAST(unnest(range(5)) AS INTEGER) AS j FROM le) le WHERE NOT EXISTS (SELECT 1 FROM fd WHERE fd.gap = le.gap AND fd.match = le.match AND fd.seq_idx = le.j)),
rk AS (SELECT a, b, row_number() OVER (ORDER BY start, a, b) - 1 AS mum_id FROM al WHERE seq_idx = 0)"""


def _q(select: str, *extra: str, slot: int = 256, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_M.replace('{slot}', str(slot))}{''.join(extra)}\n{select}"


_DNA = "translate(regexp_replace(lower({x}), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac')"
_SLICE = """WITH sl AS (SELECT 'doc' || doc_id AS contig, (doc_id * 131) % n_chars AS start, least(n_chars, (doc_id * 131) % n_chars + 80) AS "end", source AS path, text FROM documents WHERE n_chars > 0)
"""
_LR = """WITH lr AS (SELECT CAST(s_suppkey AS BIGINT) AS region_id, CAST(s_suppkey % 5 AS INTEGER) AS seq_idx, CASE WHEN s_suppkey % 10 = 4 THEN 'nowhere' ELSE n_name END AS contig,
  CAST((s_suppkey * 37) % 1000 AS BIGINT) AS s, CASE WHEN s_suppkey % 7 = 3 THEN 1000000000000 ELSE (s_suppkey * 37) % 1000 + 100 END AS e FROM supplier JOIN nation ON s_suppkey % 25 = n_nationkey)"""

_GROUPS = f"""WITH b AS (SELECT CAST(item_id AS BIGINT) AS grp, {_DNA.format(x="text")} AS t FROM benchmark),
q0 AS (SELECT grp, t AS s0, substr(t, length(t) // 2 + 1) || left(t, length(t) // 2) AS s1, 'acgtta' || t || 'ttgaca' AS s2 FROM b WHERE length(t) >= 16),
"""
_TURN = "reverse(translate({s}, 'acgt', 'tgca'))"

SQL = {
    "whole_matches": f"""WITH b AS (SELECT CAST(item_id AS BIGINT) AS i, {_DNA.format(x="text")} AS t FROM benchmark),
x AS (SELECT 0 AS seq_idx, string_agg(t, '' ORDER BY i) AS s FROM b UNION ALL SELECT 1, {_TURN.format(s="string_agg(t, '' ORDER BY i)")} FROM b
  UNION ALL SELECT 2, string_agg(t, '' ORDER BY i % 3, i) FROM b),
"""
    + _SUFFIXES,
    "multi_mums": _GROUPS + "q AS (SELECT grp, s0, s0 AS t0, s1 AS t1, s2 AS t2, length(s0) AS n0, length(s1) AS n1, length(s2) AS n2 FROM q0)" + _UNIQUE
    + "SELECT grp, match, CAST(seq_idx AS INTEGER) AS seq_idx, CAST(pos AS BIGINT) AS pos, CAST(length AS BIGINT) AS length FROM z",
    "multi_mums_stranded": _GROUPS
    + f"""q1 AS (SELECT grp, s0, {_TURN.format(s="s1")} AS s1, s2 FROM q0),
q AS (SELECT grp, s0, s0 || '#' || {_TURN.format(s="s0")} AS t0, s1 || '$' || {_TURN.format(s="s1")} AS t1, s2 || '%' || {_TURN.format(s="s2")} AS t2,
  length(s0) AS n0, length(s1) AS n1, length(s2) AS n2 FROM q1)"""
    + _UNIQUE
    + "SELECT grp, match, CAST(seq_idx AS INTEGER) AS seq_idx, CAST(pos AS BIGINT) AS pos, CAST(length AS BIGINT) AS length, strand FROM z",
    "subset_overlap": _q("SELECT mum_id, seq_idx, start, length, strand FROM mums WHERE seq_idx = 0 AND start < 200000 AND start + length > 100000"),
    "subset_batch": _q('SELECT region_id, mum_id, m.seq_idx, m.start, length, strand FROM regions r JOIN mums m ON m.seq_idx = r.seq_idx AND m.start < r."end" AND m.start + length > r.start'),
    "subset_indexed": _q('SELECT region_id, mum_id, m.seq_idx, m.start, length, strand FROM regions r JOIN mums m ON m.seq_idx = r.seq_idx AND m.start < r."end" AND m.start + length > r.start'),
    "subset_partial": _q('SELECT region_id, mum_id, m.start FROM regions r JOIN part_ m ON m.seq_idx = r.seq_idx AND m.start >= 0 AND m.start < r."end" AND m.start + length > r.start'),
    "extract_bounds": _q("SELECT region_id, seq_idx, s, e_incl, left_id, left_start, left_end, right_id, right_start, right_end FROM bd", _L),
    "extract_margins": _q("SELECT region_id, left_off, right_off, left_margin, right_margin FROM ofs", _L),
    "extract_liftover": _q("SELECT region_id, seq_idx, start, end_incl, end_incl + 1 AS \"end\", CASE WHEN start > end_incl THEN '-' ELSE '+' END AS orientation FROM lift", _L),
    "extract_liftover_stranded": _q(
        """SELECT region_id, seq_idx, least(x, y) AS start, greatest(x, y) AS end_incl, greatest(x, y) + 1 AS "end", CASE WHEN x > y THEN '-' ELSE '+' END AS orientation FROM (
SELECT region_id, a.seq_idx, CASE WHEN a.strand THEN a.start + left_off ELSE a.start + a.length - 1 - left_off END AS x,
  CASE WHEN b.strand THEN b.start + right_off ELSE b.start + b.length - 1 - right_off END AS y
FROM ofs JOIN mums a ON a.mum_id = left_id JOIN mums b ON b.mum_id = right_id AND b.seq_idx = a.seq_idx)""",
        _L,
    ),
    "extract_bed": _q('SELECT region_id, seq_idx, ac AS contig, start - ao AS start, end_incl - bo AS end_incl, end_incl - bo + 1 AS "end" FROM loc WHERE ac = bc AND start <= end_incl', _L),
    "extract_select_seqs": _q('SELECT region_id, seq_idx, CAST(CASE seq_idx WHEN 3 THEN 0 ELSE 1 END AS BIGINT) AS position, start, end_incl + 1 AS "end" FROM lift WHERE seq_idx IN (3, 1)', _L),
    "cross_contig_rejects": _q("SELECT region_id, seq_idx, start, end_incl, CASE WHEN ac IS NULL OR bc IS NULL THEN 'out of range' ELSE 'cross contig' END AS reason FROM loc WHERE ac IS NULL OR bc IS NULL OR ac <> bc", _L),
    "local_to_global": _q(
        """SELECT region_id, lr.seq_idx, CASE WHEN reason IS NULL THEN off + s END AS g_start, CASE WHEN reason IS NULL THEN off + e - 1 END AS g_end_incl, CASE WHEN reason IS NULL THEN off + e END AS g_end, reason
FROM (SELECT lr.*, off, CASE WHEN c.contig IS NULL THEN 'unknown contig' WHEN NOT (s >= 0 AND s < e AND e <= length) THEN 'out of range' END AS reason
FROM lr LEFT JOIN contigs c ON c.seq_idx = lr.seq_idx AND c.contig = lr.contig) lr""",
        "," + _LR.removeprefix("WITH"),
    ),
    "global_to_local": _q(
        """SELECT mum_id, m.seq_idx, CASE WHEN a.contig = b.contig THEN a.contig END AS contig, CASE WHEN a.contig = b.contig THEN start - a.off END AS l_start,
CASE WHEN a.contig = b.contig THEN start + m.length - b.off END AS l_end, CASE WHEN a.contig IS NULL OR b.contig IS NULL THEN 'out of range' WHEN a.contig <> b.contig THEN 'cross contig' END AS reason
FROM mums m LEFT JOIN contigs a ON a.seq_idx = m.seq_idx AND a.off <= start AND start < a.off + a.length
LEFT JOIN contigs b ON b.seq_idx = m.seq_idx AND b.off <= start + m.length - 1 AND start + m.length - 1 < b.off + b.length"""
    ),
    "sort_by_genome_rank": _q("SELECT mum_id, row_number() OVER (ORDER BY start, mum_id) - 1 AS new_id FROM mums WHERE seq_idx = 2"),
    "sortedness_violations": _q("SELECT seq_idx, CAST(count(*) FILTER (nx < start) AS BIGINT) AS n_violations FROM (SELECT *, lead(start) OVER (PARTITION BY seq_idx ORDER BY mum_id) AS nx FROM mums) GROUP BY seq_idx"),
    "bin_ranges_rle": _q(
        """SELECT seq_idx, bin, min(mum_id) AS lo, max(mum_id) + 1 AS hi FROM (
SELECT *, row_number() OVER (PARTITION BY seq_idx ORDER BY mum_id) - row_number() OVER (PARTITION BY seq_idx, bin ORDER BY mum_id) AS g
FROM (SELECT seq_idx, mum_id, CASE WHEN start < 0 THEN -1 ELSE start // 1000 END AS bin FROM part_)) WHERE bin >= 0 GROUP BY seq_idx, bin, g"""
    ),
    "bin_spans": _q(
        """SELECT t.seq_idx, t.bin, span_min, span_max, CAST(coalesce(n, 0) AS BIGINT) AS n FROM
(SELECT seq_idx, unnest(range(0, max(start) // 1000 + 1)) AS bin FROM part_ GROUP BY seq_idx) t
LEFT JOIN (SELECT seq_idx, start // 1000 AS bin, min(start) AS span_min, max(start + length) AS span_max, count(*) AS n FROM part_ WHERE start >= 0 GROUP BY ALL) x ON x.seq_idx = t.seq_idx AND x.bin = t.bin"""
    ),
    "bin_index_offsets": _q(
        """SELECT bin, CAST(sum(n) OVER (ORDER BY bin) - n AS BIGINT) AS first_row, n FROM (SELECT t.bin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM
(SELECT unnest(range(0, max(start) // 1000 + 1)) AS bin FROM mums WHERE seq_idx = 0) t
LEFT JOIN (SELECT start // 1000 AS bin, count(*) AS n FROM mums WHERE seq_idx = 0 GROUP BY 1) x ON x.bin = t.bin)"""
    ),
    "nearest_nonempty_bin": _q(
        """SELECT region_id, r.seq_idx, start // 200 AS bin, (SELECT max(bin) FROM sp0 WHERE sp0.seq_idx = r.seq_idx AND sp0.bin <= r.start // 200) AS left_bin,
(SELECT min(bin) FROM sp0 WHERE sp0.seq_idx = r.seq_idx AND sp0.bin >= r.start // 200) AS right_bin FROM regions r""",
        _SP,
    ),
    "flank_bins": _q(
        """SELECT region_id, CASE WHEN a.span_min <= s THEN l1 WHEN a2.span_min <= s THEN l2 END AS left_bin, CASE WHEN b.span_max > e THEN r1 WHEN b2.span_max > e THEN r2 END AS right_bin
FROM (SELECT *, (SELECT max(bin) FROM sp0 WHERE sp0.seq_idx = q.seq_idx AND sp0.bin < l1) AS l2, (SELECT min(bin) FROM sp0 WHERE sp0.seq_idx = q.seq_idx AND sp0.bin > r1) AS r2 FROM (
SELECT region_id, seq_idx, start AS s, "end" - 1 AS e, (SELECT max(bin) FROM sp0 WHERE sp0.seq_idx = r.seq_idx AND sp0.bin <= r.start // 200) AS l1,
(SELECT min(bin) FROM sp0 WHERE sp0.seq_idx = r.seq_idx AND sp0.bin >= (r."end" - 1) // 200) AS r1 FROM regions r) q) p
LEFT JOIN sp0 a ON a.seq_idx = p.seq_idx AND a.bin = l1 LEFT JOIN sp0 a2 ON a2.seq_idx = p.seq_idx AND a2.bin = l2
LEFT JOIN sp0 b ON b.seq_idx = p.seq_idx AND b.bin = r1 LEFT JOIN sp0 b2 ON b2.seq_idx = p.seq_idx AND b2.bin = r2""",
        _SP,
    ),
    "region_bin_candidates": _q(
        """SELECT region_id, count(*) FILTER (c) AS n_candidates, count(*) FILTER (c AND x) AS n_kept, count(*) FILTER (x) AS n_exact FROM (
SELECT region_id, m.start // 1000 >= r.start // 1000 AND m.start // 1000 <= (r."end" - 1) // 1000 AS c, m.start < r."end" AND m.start + m.length > r.start AS x
FROM regions r LEFT JOIN mums m ON m.seq_idx = r.seq_idx AND m.start + 2000 > r.start AND m.start - 2000 < r."end") GROUP BY region_id"""
    ),
    "lengths_checksum": _q(
        """SELECT CAST(count(*) AS BIGINT) AS n_sampled, CAST(CAST('0x' || left(sha256(unhex(string_agg(substr(h,15,2)||substr(h,13,2)||substr(h,11,2)||substr(h,9,2)||substr(h,7,2)||substr(h,5,2)||substr(h,3,2)||substr(h,1,2), '' ORDER BY mum_id))), 16) AS UBIGINT) AS VARCHAR) AS checksum
FROM (SELECT mum_id, lpad(hex(length), 16, '0') AS h FROM mums WHERE seq_idx = 0 ORDER BY mum_id LIMIT 1000)"""
    ),
    "table_stats": _q("SELECT count(DISTINCT mum_id) AS n_mums, count(DISTINCT seq_idx) AS n_seqs, count(*) FILTER (start >= 0) AS n_present, count(*) FILTER (NOT strand) AS n_reverse, max(length) AS max_length FROM part_"),
    "genome_lengths": _q("SELECT seq_idx, CAST(sum(length) AS BIGINT) AS total, count(*) AS n_contigs FROM contigs GROUP BY seq_idx"),
    "contig_offsets": _q('SELECT seq_idx, contig_idx, contig, length, off AS "offset" FROM contigs'),
    "last_mum_end": _q("SELECT seq_idx, max(start + length) AS last_end, arg_max(mum_id, (start, mum_id)) AS last_id FROM part_ WHERE start >= 0 GROUP BY seq_idx"),
    "presence_counts": _q("SELECT seq_idx, count(*) FILTER (start >= 0) AS n_present, count(*) FILTER (start < 0) AS n_absent FROM part_ GROUP BY seq_idx"),
    "wide_to_long": _q("SELECT mum_id, CAST(seq_idx AS BIGINT) AS seq_idx, start, length, strand FROM mums"),
    "long_to_wide": _q("SELECT mum_id, any_value(length) AS length, string_agg(CAST(start AS VARCHAR), ',' ORDER BY seq_idx) AS starts, string_agg(CASE WHEN strand THEN 'true' ELSE 'false' END, ',' ORDER BY seq_idx) AS strands FROM mums GROUP BY mum_id"),
    "neighbour_pairs": _q("SELECT seq_idx, l, r FROM np", _B),
    "common_adjacency": _q("SELECT l, r FROM ca", _B),
    "collinear_blocks": _q("SELECT s, e FROM bl", _B),
    "filter_collinear": _q("SELECT mum_id, row_number() OVER (ORDER BY mum_id) - 1 AS new_id, min(rn) OVER (PARTITION BY s) AS block FROM (SELECT s, mum_id, row_number() OVER (ORDER BY mum_id) - 1 AS rn FROM (SELECT s, unnest(range(s, e + 1)) AS mum_id FROM bl))", _B),
    "block_renumber": _q("SELECT s, e, CAST(u - (e - s + 1) AS BIGINT) AS new_s, CAST(u - 1 AS BIGINT) AS new_e FROM (SELECT s, e, sum(e - s + 1) OVER (ORDER BY s) AS u FROM bl)", _B),
    "collinear_pct": _q("SELECT count(*) AS n_blocks, CAST(sum(e - s + 1) AS BIGINT) AS n_collinear, any_value(n) AS n_mums, round(sum(e - s + 1) * 100.0 / CAST(any_value(n) AS DOUBLE), 3) AS percent FROM bl, tot", _B),
    "oriented_blocks": _q("SELECT block, s, e, n FROM ob", _B, _O),
    "rearranged_blocks": _q(
        """SELECT block, seq_idx FROM rr UNION SELECT nb, seq_idx FROM rr""",
        _B, _O,
        """,
rr AS (SELECT block, nb, seq_idx FROM (SELECT block, seq_idx, start, lead(block) OVER w AS nb, lead(start) OVER w AS ns FROM ob JOIN mums ON mum_id = s WINDOW w AS (PARTITION BY seq_idx ORDER BY block)) WHERE ns < start)""",
    ),
    "walk_steps": _q("SELECT seq_idx, row_number() OVER (PARTITION BY seq_idx ORDER BY start, mum_id) - 1 AS place, block, CASE WHEN strand THEN '+' ELSE '-' END AS direction FROM ob JOIN mums ON mum_id = s", _B, _O),
    "walk_links_distinct": _q(
        """SELECT DISTINCT block AS a, d AS a_dir, nb AS b, nd AS b_dir FROM (SELECT block, d, lead(block) OVER w AS nb, lead(d) OVER w AS nd
FROM (SELECT *, CASE WHEN strand THEN '+' ELSE '-' END AS d FROM ob JOIN mums ON mum_id = s) WINDOW w AS (PARTITION BY seq_idx ORDER BY start, mum_id)) WHERE nb IS NOT NULL""",
        _B, _O,
    ),
    "contig_breaks": _q("SELECT mum_id FROM cb WHERE brk", _B, _C),
    "shred_cuts": _q('SELECT mum_id, seq_idx, "end" FROM cuts', _B, _C, _S, recursive=True),
    "shred_intervals": _q(
        """SELECT seq_idx, cut_id, start, "end" FROM (SELECT seq_idx, CASE WHEN o = 1152921504606846976 THEN -1 ELSE o END AS cut_id, lag("end", 1, 0) OVER (PARTITION BY seq_idx ORDER BY o) AS start, "end" FROM (
SELECT seq_idx, mum_id AS o, "end" FROM cuts UNION ALL SELECT seq_idx, 1152921504606846976, CAST(sum(length) AS BIGINT) FROM contigs GROUP BY seq_idx)) WHERE "end" > start""",
        _B, _C, _S, recursive=True,
    ),
    "enhanced_gaps": _q("SELECT mum_id, seq_idx, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, strand FROM al JOIN rk USING (a, b)", _B, _G, _REMATCH.replace("{dna}", _DNA.format(x="text"))),
    "gap_lengths": _q('SELECT gap, seq_idx, "left", "right", gap_len FROM gaps', _B, _G),
    "gaps_to_enhance": _q("SELECT gap, max(gap_len) AS max_len FROM gaps GROUP BY gap HAVING max(gap_len) >= 300", _B, _G),
    "gap_outliers": _q("SELECT gap, seq_idx, gap_len, med, mad, masked FROM outl", _B, _G),
    "gap_coords": _q(
        """SELECT g.gap, g.seq_idx, a.contig, "left" - a.off AS l_start, "right" - b.off AS l_end FROM gaps g JOIN outl o ON o.gap = g.gap AND o.seq_idx = g.seq_idx
JOIN contigs a ON a.seq_idx = g.seq_idx AND a.off <= "left" AND "left" < a.off + a.length
JOIN contigs b ON b.seq_idx = g.seq_idx AND b.off <= "right" - 1 AND "right" - 1 < b.off + b.length WHERE NOT masked AND "left" >= 0 AND "right" > "left" AND a.contig = b.contig""",
        _B, _G,
    ),
    "trim_overlaps": _q(
        """SELECT mum_id, max(-g) AS cut FROM (SELECT CASE WHEN ln > rn THEN l ELSE r END AS mum_id, g FROM (SELECT l, r, any_value(a.length) AS ln, any_value(b.length) AS rn,
min(abs(a.start - b.start) - CASE WHEN b.start < a.start THEN b.length ELSE a.length END) AS g FROM ca JOIN mums a ON a.mum_id = l JOIN mums b ON b.mum_id = r AND b.seq_idx = a.seq_idx GROUP BY l, r) WHERE g < 0) GROUP BY mum_id""",
        _B, slot=64,
    ),
    "overlaps_removed": _q(
        """SELECT m.mum_id, m.seq_idx, m.start + CASE WHEN strand THEN coalesce(head, 0) ELSE coalesce(tail, 0) END AS start, length - coalesce(head, 0) - coalesce(tail, 0) AS length, strand
FROM mums m LEFT JOIN cu ON cu.mum_id = m.mum_id WHERE length - coalesce(head, 0) - coalesce(tail, 0) > 0""",
        _B,
        """,
ov AS MATERIALIZED (SELECT l, r, any_value(a.length) > any_value(b.length) AS left_loses, -min(abs(a.start - b.start) - CASE WHEN b.start < a.start THEN b.length ELSE a.length END) AS cut
  FROM ca JOIN mums a ON a.mum_id = l JOIN mums b ON b.mum_id = r AND b.seq_idx = a.seq_idx GROUP BY l, r),
cu AS (SELECT CASE WHEN left_loses THEN l ELSE r END AS mum_id, max(CASE WHEN left_loses THEN cut ELSE 0 END) AS tail, max(CASE WHEN left_loses THEN 0 ELSE cut END) AS head FROM ov WHERE cut > 0 GROUP BY 1)""",
        slot=64,
    ),
    "unique_kmer_anchors": """WITH s AS (SELECT item_id % 2 AS seq_id, string_agg(lower(text), ' ' ORDER BY item_id) AS seq FROM benchmark GROUP BY 1),
x AS (SELECT seq_id, i - 1 AS pos, substr(seq, i, 5) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - 3)) AS i FROM s))
SELECT kmer, CAST(seq_id AS BIGINT) AS seq_id, pos FROM x WHERE kmer IN (SELECT kmer FROM x GROUP BY kmer HAVING count(*) = 2 AND count(DISTINCT seq_id) = 2)""",
    "pairwise_mems": """WITH x AS (SELECT a, i - 1 AS p, substr(seq, i, 24) AS kmer FROM (SELECT CAST(doc_id AS BIGINT) AS a, lower(text) AS seq, unnest(range(1, length(text) - 22)) AS i FROM documents WHERE length(text) >= 24)),
y AS (SELECT b, i - 1 AS p, substr(seq, i, 24) AS kmer FROM (SELECT CAST(item_id AS BIGINT) AS b, lower(text) AS seq, unnest(range(1, length(text) - 22)) AS i FROM benchmark WHERE length(text) >= 24)),
h AS (SELECT a, b, x.p, x.p - y.p AS d FROM x JOIN y USING (kmer)),
g AS (SELECT *, p - row_number() OVER (PARTITION BY a, b, d ORDER BY p) AS i FROM h)
SELECT a, b, min(p) AS a_pos, min(p) - d AS b_pos, max(p) - min(p) + 24 AS length FROM g GROUP BY a, b, d, i""",
    "enhanced_union": _q(
        """SELECT mum_id, seq_idx, start, length, strand FROM part_ UNION ALL
SELECT n + t.cut, CAST(t.seq_idx AS INTEGER), coalesce(f.start, -1), 20, coalesce(f.strand, true) FROM tot, (SELECT cut, unnest(range(5)) AS seq_idx FROM (SELECT DISTINCT cut FROM fo)) t LEFT JOIN fo f ON f.cut = t.cut AND f.seq_idx = t.seq_idx""",
        _B, _G,
        """,
fo AS (SELECT gap AS cut, seq_idx, "left" + gap_len // 2 AS start, true AS strand FROM gaps WHERE gap_len >= 300)""",
    ),
    "fasta_slices": _SLICE + 'SELECT contig, start, "end", substr(text, start + 1, "end" - start) AS slice FROM sl',
    "fasta_pieces": _SLICE + 'SELECT contig, start, "end", substr(text, start + 1, "end" - start) AS slice FROM sl',
    "bubble_nodes": _q(
        """SELECT block, gap, seq_idx, CASE WHEN seq <> '' THEN 'oblock' || block || '_g' || gap || '_a' || (dense_rank() OVER (PARTITION BY block, gap ORDER BY first) - 1) END AS name
FROM (SELECT *, min(seq_idx) OVER (PARTITION BY block, gap, seq) AS first FROM iv)""",
        _B, _O,
        """,
iv0 AS (SELECT block, l - s AS gap, a.seq_idx, CASE WHEN a.strand THEN a.start + a.length ELSE b.start + b.length END AS x, CASE WHEN a.strand THEN b.start ELSE a.start END AS y
  FROM (SELECT block, s, unnest(range(s, e)) AS l FROM ob) p JOIN mums a ON a.mum_id = l JOIN mums b ON b.mum_id = l + 1 AND b.seq_idx = a.seq_idx),
iv AS (SELECT block, gap, seq_idx, substr('acgtgcatcgatgc', CAST((x - y) % 5 + 6 AS INTEGER), CAST((gap + seq_idx * seq_idx) % 4 AS INTEGER)) AS seq FROM iv0)""",
    ),
    "block_walk_links": _q(
        """SELECT DISTINCT name AS a, dir AS a_dir, nn AS b, nd AS b_dir FROM (SELECT *, lead(name) OVER w AS nn, lead(dir) OVER w AS nd FROM st WINDOW w AS (PARTITION BY block, seq_idx ORDER BY place)) WHERE nn IS NOT NULL""",
        _B, _O,
        """,
iv0 AS (SELECT block, l - s AS gap, a.seq_idx, CASE WHEN a.strand THEN a.start + a.length ELSE b.start + b.length END AS x, CASE WHEN a.strand THEN b.start ELSE a.start END AS y, a.strand
  FROM (SELECT block, s, unnest(range(s, e)) AS l FROM ob) p JOIN mums a ON a.mum_id = l JOIN mums b ON b.mum_id = l + 1 AND b.seq_idx = a.seq_idx),
iv AS (SELECT block, gap, seq_idx, strand, substr('acgtgcatcgatgc', CAST((x - y) % 5 + 6 AS INTEGER), CAST((gap + seq_idx * seq_idx) % 4 AS INTEGER)) AS seq FROM iv0),
al AS (SELECT block, gap, seq_idx, strand, seq, dense_rank() OVER (PARTITION BY block, gap ORDER BY first) - 1 AS a FROM (SELECT *, min(seq_idx) OVER (PARTITION BY block, gap, seq) AS first FROM iv)),
st0 AS (SELECT block, seq_idx, 2 * gap + 1 AS k, 'oblock' || block || '_g' || gap || '_a' || a AS name, strand FROM al WHERE seq <> ''
  UNION ALL SELECT block, m.seq_idx, 2 * (m.mum_id - s), 'oblock' || block || '_m' || m.mum_id, strand FROM ob JOIN mums m ON m.mum_id BETWEEN s AND e),
st AS (SELECT block, seq_idx, name, CASE WHEN strand THEN k ELSE -k END AS place, CASE WHEN strand THEN '+' ELSE '-' END AS dir FROM st0)""",
    ),
    "interblock_walks": _q(
        """SELECT seq_idx, block, lo, hi, joined, CAST(sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY seq_idx ORDER BY block) AS BIGINT) AS walk FROM
(SELECT g.seq_idx, g.block, lo, hi, m.block IS NULL AND hi > lo AND (g.seq_idx = 0 OR hi - lo <= 60) AS joined FROM ig g LEFT JOIN mv m ON m.seq_idx = g.seq_idx AND m.block = g.block)""",
        _B, _O,
        """,
sp AS (SELECT block, m.seq_idx, min(m.start) AS start, max(m.start + m.length) AS "end", any_value(h.start) AS head FROM ob JOIN mums m ON m.mum_id = s OR m.mum_id = e
  JOIN mums h ON h.mum_id = s AND h.seq_idx = m.seq_idx GROUP BY block, m.seq_idx),
ig AS (SELECT seq_idx, block, lag("end", 1, 0) OVER w AS lo, start AS hi, head < lag(head) OVER w AS back FROM sp WINDOW w AS (PARTITION BY seq_idx ORDER BY block)),
mv AS (SELECT DISTINCT seq_idx, unnest([block - 1, block, block + 1]) AS block FROM ig WHERE back)""",
    ),
    "fasta_headers": _SLICE + """SELECT contig, '>' || contig || ':' || (start + 1) || '-' || "end" AS header, contig || ':' || (start + 1) || '-' || "end" AS interval FROM sl""",
    "fasta_filenames": _SLICE
    + """, p AS (SELECT contig, start, "end", '/data/in/' || path || (start % 40) || (['', '.fa', '.fna.gz', '.x y'])[start % 4 + 1] AS path FROM sl),
q AS (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM p),
r AS (SELECT *, regexp_replace(base, '\\.[^.]*$', '') AS stem, CASE WHEN base LIKE '%.%' THEN regexp_extract(base, '\\.[^.]*$') ELSE '.fa' END AS ext FROM q)
SELECT contig, path, CASE WHEN count(*) OVER (PARTITION BY stem, ext) = 1 THEN stem || '_extract' || ext ELSE stem || '_extract_' || contig || '_' || start || '_' || "end" || ext END AS name FROM r""",
    "fasta_missing": _SLICE + "SELECT DISTINCT path || '.absent' AS path, contig FROM sl",
    "reverse_complement": f"SELECT doc_id, reverse(translate({_DNA.format(x="coalesce(text, '')")}, 'ACGTacgt', 'TGCAtgca')) AS rc FROM documents",
    "strand_mirror": _q("SELECT mum_id, m.seq_idx, CASE WHEN strand THEN start ELSE CAST(total AS BIGINT) - start - m.length END AS start FROM mums m JOIN (SELECT seq_idx, sum(length) AS total FROM contigs GROUP BY seq_idx) t ON t.seq_idx = m.seq_idx"),
    "region_parse": _LR + ' SELECT region_id, contig, s AS start, e AS "end" FROM lr',
    "path_functions": """SELECT page_id, url LIKE 'http://%' OR url LIKE 'https://%' AS is_url, left(coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_.\\-]+', '_', 'g'), '._'), ''), 'region'), 40) AS safe,
regexp_extract(url, '[^/]*$') AS base FROM pages""",
    "haplotype_ids": "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'CHM13#1#chr7' ELSE lower(left(n_name, 5)) || '#' || (n_nationkey % 2 + 1) || '#chr7' END AS hap FROM nation",
    "split_multifasta": """SELECT item_id % 7 AS file_id, row_number() OVER (PARTITION BY item_id % 7 ORDER BY item_id) - 1 AS record, '>r' || item_id AS header, replace(text, '>', '') AS seq FROM benchmark""",
    "block_polygons": _q(
        """SELECT block, seq_idx, x0, x1, y0, y1 FROM (SELECT *, lead(x0) OVER w AS y0, lead(x1) OVER w AS y1 FROM (SELECT block, a.seq_idx, least(a.start, b.start) AS x0, greatest(a.start + a.length, b.start + b.length) AS x1
FROM ob JOIN mums a ON a.mum_id = s JOIN mums b ON b.mum_id = e AND b.seq_idx = a.seq_idx) WINDOW w AS (PARTITION BY block ORDER BY seq_idx)) WHERE y0 IS NOT NULL""",
        _B, _O,
    ),
}
