"""The scan as DuckDB SQL over the view ``dna``: chains of named tables that the queries' equivalents select from.

The SQL is written from the declarative definition, not from the kernel: it lists centres, spacers and lengths.  Two
facts keep the lists short without changing the result.  An arm of ``k`` bases is pure only if ``F(r + k) >= F(r)`` for
``F(i) = 100 count(class, i) - P i``, so maxima of F over a few ranges of lengths bound the arm; and mismatches only grow
along an arm, so a pair with more of them in its first bases than the bound allows is out.
"""

from __future__ import annotations

from .params import ScanParams
from .views import DNA_SQL


def raw_sql(p: ScanParams, name: str = "raw") -> str:
    """``name``: record_ix, seq_id, r (first base of the right arm, 1-based), sp, k, ga, ct, mis: the longest valid arm per (centre, spacer)."""
    edges = [p.minrep]
    while (wider := edges[-1] * 3 // 2 + 1 if edges[-1] < 48 else edges[-1] * 6 // 5) < p.maxrep:
        edges.append(wider)
    spans = list(zip(edges, [e - 1 for e in edges[1:]] + [p.maxrep], strict=True))
    top = lambda f: ", ".join(f"max({f}) OVER (PARTITION BY record_ix ORDER BY i ROWS BETWEEN {lo} FOLLOWING AND {hi} FOLLOWING) AS {f}{n}" for n, (lo, hi) in enumerate(spans))
    pure = "list_filter([" + ", ".join(f"{{'lo': {lo}, 'hi': {hi}, 'ok': a{n} >= a OR b{n} >= b}}" for n, (lo, hi) in enumerate(spans)) + "], lambda x: x.ok)"
    P, M, B = p.purity_percent, p.mismatch_percent, p.mismatch_budget
    return f"""{name}_at AS (SELECT record_ix, unnest(range(0, length(seq) + 1)) AS i, unnest(list_prepend('', string_split(seq, ''))) AS c FROM dna WHERE length(seq) >= {2 * p.minrep}),
{name}_f AS MATERIALIZED (SELECT record_ix, i, c, sum(CASE WHEN c IN ('g', 'a') THEN 100 ELSE 0 END) OVER w - {P} * i AS a, sum(CASE WHEN c IN ('c', 't') THEN 100 ELSE 0 END) OVER w - {P} * i AS b,
  min(CASE WHEN c NOT IN ('', 'a', 'c', 'g', 't') THEN i END) OVER (PARTITION BY record_ix ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS bad FROM {name}_at WINDOW w AS (PARTITION BY record_ix ORDER BY i ROWS UNBOUNDED PRECEDING)),
{name}_m AS (SELECT record_ix, i, c, a, b, bad, {top('a')}, {top('b')} FROM {name}_f),
{name}_r AS (SELECT record_ix, i + 1 AS r, {pure} AS spans, coalesce(bad, 1000000000) - i - 1 AS clean FROM {name}_m),
{name}_y AS (SELECT record_ix, r, spans, least(list_max(list_transform(spans, lambda x: x.hi)), clean) AS most FROM {name}_r WHERE len(spans) > 0),
{name}_c AS MATERIALIZED (SELECT record_ix, seq_id, r, spans, length(seq) AS size, substr(seq, r, most) AS rs, reverse(substr(seq, greatest(1, r - most - {p.maxspacer}), r - greatest(1, r - most - {p.maxspacer}))) AS lc
  FROM {name}_y JOIN dna USING (record_ix) WHERE most >= {p.minrep} AND r > {p.minrep}),
{name}_s AS (SELECT *, unnest(range(0, {p.maxspacer + 1})) AS sp FROM {name}_c),
{name}_p AS (SELECT record_ix, seq_id, r, sp, lc, rs, unnest(spans) AS span, least(length(rs), r - sp - 1) AS n, lc[sp + 1:sp + length(rs)] AS ls FROM {name}_s WHERE r - sp - 1 >= {p.minrep} AND r - sp - 1 <= size - {p.minrep}),
{name}_t AS (SELECT *, least(span.hi, n) AS top FROM {name}_p WHERE n >= span.lo AND ls[1] IN ('a', 'c', 'g', 't')),
{name}_z AS (SELECT *, top - length(translate(rs[1:top], 'ga', '')) AS ga, top - length(translate(rs[1:top], 'ct', '')) AS ct FROM {name}_t WHERE hamming(ls[1:span.lo], rs[1:span.lo]) * 100 <= {M} * top),
{name}_k AS (SELECT record_ix, seq_id, r, sp, ls, rs, lc, unnest(CASE WHEN hamming(ls[1:top], rs[1:top]) <= least({B}, {M} * top // 100) AND (ga * 100 >= {P} * top OR ct * 100 >= {P} * top) THEN [top] ELSE range(span.lo, top + 1) END) AS k FROM {name}_z),
{name}_h AS MATERIALIZED (SELECT *, hamming(ls[1:k], rs[1:k]) AS mis, k - length(translate(rs[1:k], 'ga', '')) AS ga, k - length(translate(rs[1:k], 'ct', '')) AS ct FROM {name}_k),
{name}_v AS (SELECT record_ix, seq_id, r, sp, any_value(lc) AS lc, any_value(rs) AS rs, max(k) AS k, arg_max({{'ga': ga, 'ct': ct, 'mis': mis}}, k) AS g FROM {name}_h
  WHERE mis * 100 <= {M} * k AND (ga * 100 >= {P} * k OR ct * 100 >= {P} * k) AND (k = {p.minrep} OR mis <= {B} OR hamming(ls[1:k - 1], rs[1:k - 1]) <= {B}) GROUP BY record_ix, seq_id, r, sp),
{name} AS (SELECT record_ix, seq_id, r, CAST(sp AS INTEGER) AS sp, lc, rs, CAST(k AS INTEGER) AS k, CAST(g.ga AS INTEGER) AS ga, CAST(g.ct AS INTEGER) AS ct, CAST(g.mis AS INTEGER) AS mis FROM {name}_v)"""


def candidates_sql(p: ScanParams, name: str = "cand") -> str:
    """``name``: extended and deduplicated candidates with the columns of the hit table and the counts."""
    P = p.purity_percent
    gained = lambda letters: f"j - length(translate(lc[1:j], '{letters}', ''))"
    share = lambda c: f"CAST(CAST({c} AS FLOAT) * (CAST(1 AS FLOAT) / CAST(arm_length AS FLOAT)) * CAST(100 AS FLOAT) AS DOUBLE)"
    return f"""{raw_sql(p, name + '_raw')},
{name}_step AS (SELECT *, list_transform(range(1, least(sp // 2, {p.maxrep} - k) + 1), lambda j: lc[sp + 1 - j] = lc[j] AND lc[j] IN ('a', 'c', 'g', 't') AND ((ga + {gained('ga')}) * 100 >= {P} * (k + j) OR (ct + {gained('ct')}) * 100 >= {P} * (k + j))) AS ok FROM {name}_raw),
{name}_far AS (SELECT *, CASE WHEN list_position(ok, false) > 0 THEN list_position(ok, false) - 1 ELSE len(ok) END AS j FROM {name}_step),
{name}_ext AS (SELECT DISTINCT record_ix, seq_id, r - sp - k AS start, r + k - 1 AS "end", CAST(k + j AS INTEGER) AS arm_length, CAST(sp - 2 * j AS INTEGER) AS spacer_length, reverse(lc[1:sp + k]) || rs[1:k] AS full_sequence,
  CAST(ga + {gained('ga')} AS INTEGER) AS ga, CAST(ct + {gained('ct')} AS INTEGER) AS ct, mis AS mismatches FROM {name}_far),
{name} AS (SELECT record_ix, seq_id, 'findHDNA' AS source, start, "end", arm_length, spacer_length, CAST(2 * arm_length + spacer_length AS INTEGER) AS total_length, {share('ga')} AS ga_pct, {share('ct')} AS ct_pct,
  CAST((CAST(1 AS FLOAT) - CAST(mismatches AS FLOAT) * (CAST(1 AS FLOAT) / CAST(arm_length AS FLOAT))) * CAST(100 AS FLOAT) AS DOUBLE) AS mirror_identity, (ga = arm_length OR ct = arm_length) AND mismatches = 0 AS is_perfect,
  full_sequence[1:arm_length] AS left_arm, CASE WHEN spacer_length = 0 THEN '.' ELSE full_sequence[arm_length + 1:arm_length + spacer_length] END AS spacer, full_sequence[arm_length + spacer_length + 1:] AS right_arm,
  full_sequence, ga, ct, mismatches FROM {name}_ext)"""


def g_rate_sql(source: str, name: str, least: float) -> str:
    n = lambda arm, b: f"length({arm}) - length(replace({arm}, '{b}', ''))"
    rate = lambda b: f"greatest({n('left_arm', b)}, {n('right_arm', b)})"
    return f"{name} AS (SELECT * FROM {source} WHERE CASE WHEN ga_pct >= ct_pct THEN {rate('g')} ELSE {rate('c')} END / arm_length >= {least})"


def islands_sql(source: str, name: str, order: str, key: str = "record_ix") -> str:
    """``name``: the source with ``island`` and its place ``at`` in the island by ``order``."""
    return f"""{name}_n AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY {key} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS opens FROM {source}),
{name}_i AS (SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY start, "end") AS island FROM {name}_n),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {key}, island ORDER BY {order}) AS spot FROM {name}_i)"""


def greedy_sql(source: str, name: str, key: str = "record_ix") -> str:
    """Greedy selection, a recursive walk along every island."""
    over = f"""(n.start > w."end" OR n.arm_length > w.arm_length OR (n.arm_length = w.arm_length AND n.spacer_length < w.spacer_length))"""
    pick = lambda c: f"CASE WHEN {over} THEN n.{c} ELSE w.{c} END"
    return f"""{islands_sql(source, name + '_o', 'start, arm_length DESC, spacer_length', key)},
{name}_w AS (SELECT {key}, island, spot, start, "end", arm_length, spacer_length, spot AS keeper, CAST(NULL AS BIGINT) AS closed FROM {name}_o WHERE spot = 1
  UNION ALL SELECT n.{key}, n.island, n.spot, {pick('start')}, {pick('"end"')}, {pick('arm_length')}, {pick('spacer_length')}, CASE WHEN {over} THEN n.spot ELSE w.keeper END, CASE WHEN n.start > w."end" THEN w.keeper END
  FROM {name}_w w JOIN {name}_o n ON n.{key} = w.{key} AND n.island = w.island AND n.spot = w.spot + 1),
{name}_g AS (SELECT {key}, island, closed AS spot FROM {name}_w WHERE closed IS NOT NULL UNION SELECT {key}, island, arg_max(keeper, spot) FROM {name}_w GROUP BY {key}, island),
{name} AS (SELECT * FROM {name}_o JOIN {name}_g USING ({key}, island, spot))"""


def by_score_sql(source: str, name: str, key: str = "record_ix") -> str:
    """Selection by score, a recursive visit of every island by priority."""
    free = """len(list_filter(w.taken, lambda x: x.s <= n."end" AND x.e >= n.start)) = 0"""
    return f"""{islands_sql(source, name + '_o', 'total_score IS NULL, total_score DESC, arm_length DESC, spacer_length, start, "end", full_sequence', key)},
{name}_w AS (SELECT {key}, island, spot, [{{'s': start, 'e': "end"}}] AS taken, true AS ok FROM {name}_o WHERE spot = 1
  UNION ALL SELECT n.{key}, n.island, n.spot, CASE WHEN {free} THEN list_append(w.taken, {{'s': n.start, 'e': n."end"}}) ELSE w.taken END, {free}
  FROM {name}_w w JOIN {name}_o n ON n.{key} = w.{key} AND n.island = w.island AND n.spot = w.spot + 1),
{name} AS (SELECT o.* FROM {name}_o o JOIN {name}_w USING ({key}, island, spot) WHERE ok)"""


def scores_sql(source: str, name: str, stacking: bool = True, search: bool = True) -> str:
    """``name``: the source with the four score columns, by listing every window of every arm."""
    weight = "CASE WHEN ok THEN CASE x WHEN 'G' THEN 7.6::DOUBLE ELSE 3.83::DOUBLE END ELSE -5.715::DOUBLE END"
    fine = "CASE WHEN run <= 2 THEN 5::DOUBLE ELSE round(pow(5::DOUBLE, least(run - 2, 12) + 1) / 2, 2) END"
    fits = "hi - lo >= least(8, arm) AND 2 * (arm - hi) + loop <= hi - lo" if search else "lo = 0 AND hi = arm"
    t = name
    return f"""{t}_d AS (SELECT DISTINCT left_arm, spacer, right_arm FROM {source}),
{t}_u AS (SELECT *, length(left_arm) AS arm, upper(left_arm || CASE WHEN spacer = '.' THEN '' ELSE spacer END || right_arm) AS s, length(left_arm) - length(translate(upper(left_arm), 'CT', '')) > length(left_arm) - length(translate(upper(left_arm), 'GA', '')) AS turn FROM {t}_d),
{t}_t AS (SELECT left_arm, spacer, right_arm, arm, CASE WHEN turn THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS s FROM {t}_u),
{t}_a AS (SELECT *, s[1:arm] AS s1, s[arm + 1:length(s) - arm] AS s3, reverse(s[length(s) - arm + 1:]) AS s2, length(s) - 2 * arm AS loop FROM {t}_t),
{t}_j AS (SELECT left_arm, spacer, right_arm, arm, loop, unnest(range(1, arm + 1)) AS j, unnest(string_split(s1, '')) AS x, unnest(string_split(s2, '')) AS y FROM {t}_a WHERE regexp_full_match(s1 || s2, '[ACGT]*')),
{t}_m AS (SELECT *, x = y AND x IN ('G', 'A') AS ok FROM {t}_j),
{t}_b AS (SELECT *, sum({weight}) OVER w AS upto, ok AND coalesce(lag(ok) OVER w, false) AS paired FROM {t}_m WINDOW w AS (PARTITION BY left_arm, spacer, right_arm ORDER BY j)),
{t}_l AS (SELECT *, max(CASE WHEN paired THEN j END) OVER (PARTITION BY left_arm, spacer, right_arm ORDER BY j) AS last FROM {t}_b),
{t}_s AS (SELECT left_arm, spacer, right_arm, arm, loop, j AS hi, upto, paired, last, unnest(range(0, {'j' if search else '1'})) AS lo FROM {t}_l),
{t}_r AS (SELECT *, hi - greatest(coalesce(last, 0), lo + 1) AS run FROM {t}_s),
{t}_q AS (SELECT *, {'sum(CASE WHEN hi = lo + 1 THEN 0::DOUBLE WHEN paired THEN 5::DOUBLE ELSE -(' + fine + ') END) OVER (PARTITION BY left_arm, spacer, right_arm, lo ORDER BY hi)' if stacking else '0::DOUBLE'} AS stack FROM {t}_r),
{t}_v AS (SELECT q.*, q.upto - coalesce(z.upto, 0) AS pair FROM {t}_q q LEFT JOIN {t}_l z ON z.left_arm = q.left_arm AND z.spacer = q.spacer AND z.right_arm = q.right_arm AND z.j = q.lo),
{t}_w AS (SELECT *, row_number() OVER (PARTITION BY left_arm, spacer, right_arm ORDER BY ({fits}) DESC, CASE WHEN {fits} THEN -round(pair + stack, 3) END, CASE WHEN {fits} THEN lo ELSE 0 END, CASE WHEN {fits} THEN hi ELSE -hi END, lo) AS best FROM {t}_v WHERE ({fits}) OR (lo = 0 AND hi = arm)),
{t}_o AS (SELECT a.left_arm, a.spacer, a.right_arm, stack AS stacking_score, pair AS pairing_score, greatest(round(stack + pair, 3), 0) AS total_score,
  lower(s1[lo + 1:hi] || '[' || s1[hi + 1:] || s3 || reverse(s2[hi + 1:]) || ']' || reverse(s2[lo + 1:hi])) AS putative_triplex FROM {t}_w w JOIN {t}_a a ON a.left_arm = w.left_arm AND a.spacer = w.spacer AND a.right_arm = w.right_arm WHERE best = 1),
{t} AS (SELECT h.*, o.stacking_score, o.pairing_score, o.total_score, coalesce(o.putative_triplex, '') AS putative_triplex FROM {source} h LEFT JOIN {t}_o o ON o.left_arm = h.left_arm AND o.spacer = h.spacer AND o.right_arm = h.right_arm)"""


def linear_scores_sql(source: str, name: str) -> str:
    """``name``: the source with the four score columns of the whole model, from running sums along each arm instead of all windows.

    In units of 1/200.  A window (lo, hi] with a stacked step is worth a part of ``hi`` plus a part ``g`` of ``lo``, whose running
    maximum (least ``lo`` on ties, packed into one number) is looked up at the last ``lo`` allowed; one without a stacked step
    is best from the last ``lo`` allowed.
    """
    single = [0, *[5.0 if r <= 2 else round(5.0 ** (min(r - 2, 12) + 1) / 2, 2) for r in range(1, 16)]]
    fines = [round(200 * x) for x in single]
    sums = [sum(fines[: k + 1]) for k in range(16)]
    fine = lambda r: f"list_extract({fines}::BIGINT[], CAST(least({r}, 15) + 1 AS BIGINT))"
    alone = lambda k: f"(list_extract({sums}::BIGINT[], CAST(least({k}, 15) + 1 AS BIGINT)) + greatest({k} - 15, 0) * {fines[15]})"
    t = name
    return f"""{t}_d AS (SELECT row_number() OVER () AS h, * FROM (SELECT DISTINCT left_arm, spacer, right_arm FROM {source})),
{t}_u AS (SELECT *, length(left_arm) AS arm, upper(left_arm || CASE WHEN spacer = '.' THEN '' ELSE spacer END || right_arm) AS s, length(left_arm) - length(translate(upper(left_arm), 'CT', '')) > length(left_arm) - length(translate(upper(left_arm), 'GA', '')) AS turn FROM {t}_d),
{t}_t AS (SELECT h, left_arm, spacer, right_arm, arm, CASE WHEN turn THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END AS s FROM {t}_u),
{t}_a AS MATERIALIZED (SELECT *, s[1:arm] AS s1, s[arm + 1:length(s) - arm] AS s3, reverse(s[length(s) - arm + 1:]) AS s2, length(s) - 2 * arm AS loop FROM {t}_t),
{t}_j AS (SELECT h, arm, loop, unnest(range(1, arm + 1)) AS j, unnest(string_split(s1, '')) AS x, unnest(string_split(s2, '')) AS y FROM {t}_a WHERE regexp_full_match(s1 || s2, '[ACGT]*')),
{t}_m AS (SELECT *, x = y AND x IN ('G', 'A') AS ok, CASE WHEN x = y AND x = 'G' THEN 1520 WHEN x = y AND x = 'A' THEN 766 ELSE -1143 END AS w FROM {t}_j),
{t}_b AS (SELECT *, sum(w) OVER o AS tops, ok AND coalesce(lag(ok) OVER o, false) AS paired FROM {t}_m WINDOW o AS (PARTITION BY h ORDER BY j)),
{t}_l AS (SELECT *, max(CASE WHEN paired THEN j END) OVER (PARTITION BY h ORDER BY j) AS last, min(CASE WHEN paired THEN j END) OVER (PARTITION BY h ORDER BY j ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM {t}_b),
{t}_s AS (SELECT *, sum(CASE WHEN j = 1 THEN 0 WHEN paired THEN 1000 ELSE -{fine('j - greatest(coalesce(last, 0), 1)')} END) OVER (PARTITION BY h ORDER BY j) AS steps FROM {t}_l),
{t}_f AS MATERIALIZED (SELECT a.*, CASE WHEN a.next IS NOT NULL THEN w - tops - {alone('a.next - 1 - a.j')} - n.steps END AS g FROM {t}_s a LEFT JOIN (SELECT h AS h2, j + 1 AS j2, steps FROM {t}_s) n ON n.h2 = a.h AND n.j2 = a.next),
{t}_p AS MATERIALIZED (SELECT h, j, tops - w AS base, max(CAST(g AS BIGINT) * 2048 + 2048 - j) OVER (PARTITION BY h ORDER BY j) AS top FROM {t}_f),
{t}_r AS (SELECT h, arm, j AS hi, tops, steps, coalesce(last - 1, 0) AS both, least(j - least(8, arm), 3 * j - 2 * arm - loop) AS latest FROM {t}_f),
{t}_c AS (SELECT r.h, r.hi, 2047 - (p.top % 2048 + 2048) % 2048 AS lo, CAST(r.tops + r.steps AS BIGINT) + (p.top - (p.top % 2048 + 2048) % 2048) // 2048 AS value FROM {t}_r r JOIN {t}_p p ON p.h = r.h AND p.j = least(r.latest, r.both - 1) + 1 WHERE least(r.latest, r.both - 1) >= 0 AND p.top IS NOT NULL
  UNION ALL SELECT r.h, r.hi, r.latest, CAST(r.tops - p.base AS BIGINT) - {alone('r.hi - 1 - r.latest')} FROM {t}_r r JOIN {t}_p p ON p.h = r.h AND p.j = r.latest + 1 WHERE r.latest >= r.both),
{t}_w AS (SELECT h, max({{'v': value, 'lo': -lo, 'hi': -hi}}) AS b FROM {t}_c GROUP BY h),
{t}_e AS (SELECT DISTINCT h, arm FROM {t}_j),
{t}_x AS (SELECT e.h, coalesce(-b.lo, 0) AS lo, coalesce(-b.hi, e.arm) AS hi, b.v AS v FROM {t}_e e LEFT JOIN {t}_w w ON w.h = e.h),
{t}_y AS (SELECT x.h, x.lo, x.hi, CAST(z.tops - p.base AS BIGINT) AS pair, coalesce(x.v, CAST(z.tops - p.base + z.steps AS BIGINT)) AS total FROM {t}_x x JOIN {t}_f z ON z.h = x.h AND z.j = x.hi JOIN {t}_p p ON p.h = x.h AND p.j = x.lo + 1),
{t}_o AS (SELECT left_arm, spacer, right_arm, (total - pair) / 200.0 AS stacking_score, pair / 200.0 AS pairing_score, greatest(total / 200.0, 0.0) AS total_score,
  lower(s1[lo + 1:hi] || '[' || s1[hi + 1:] || s3 || reverse(s2[hi + 1:]) || ']' || reverse(s2[lo + 1:hi])) AS putative_triplex FROM {t}_y JOIN {t}_a USING (h)),
{t} AS (SELECT q.*, o.stacking_score::DOUBLE AS stacking_score, o.pairing_score::DOUBLE AS pairing_score, o.total_score::DOUBLE AS total_score, coalesce(o.putative_triplex, '') AS putative_triplex FROM {source} q LEFT JOIN {t}_o o ON o.left_arm = q.left_arm AND o.spacer = q.spacer AND o.right_arm = q.right_arm)"""


#: A span, or a triplex without its brackets, of one base.
MIXED = "NOT (length(full_sequence) > 0 AND replace(full_sequence, full_sequence[1], '') = '')"
MIXED_TRIPLEX = "NOT (length(translate(putative_triplex, '[]', '')) > 0 AND replace(translate(putative_triplex, '[]', ''), translate(putative_triplex, '[]', '')[1], '') = '')"
HITS = 'seq_id, source, start, "end", arm_length, spacer_length, total_length, ga_pct, ct_pct, mirror_identity, is_perfect, left_arm, spacer, right_arm, full_sequence'
SCORED = "round(stacking_score, 3) AS stacking_score, round(pairing_score, 3) AS pairing_score, total_score, putative_triplex"


def x1_sql(p: ScanParams, dna: str = DNA_SQL) -> str:
    return f'WITH {dna}, {raw_sql(p)} SELECT seq_id, r - sp - k AS start, r + k - 1 AS "end", k AS arm_length, sp AS spacer_length, ga, ct, mis AS mismatches FROM raw'


def p5_sql(p: ScanParams, dna: str = DNA_SQL) -> str:
    return f"WITH {dna}, {candidates_sql(p)} SELECT {HITS}, ga, ct, mismatches FROM cand"


def passing_sql(p: ScanParams, dna: str = DNA_SQL) -> str:
    """The head of a scan: candidates in ``cand``, those that the composition filters pass in ``pass``."""
    warm = "length(full_sequence) - length(translate(full_sequence, 'at', ''))"
    cool = f"cool AS (SELECT * FROM cand WHERE {f'({warm}) / length(full_sequence) < {p.at_threshold}' if p.at_threshold is not None else 'true'})"
    return f"WITH RECURSIVE {dna}, {candidates_sql(p)}, {cool}, {g_rate_sql('cool', 'pass', p.min_g_rate)}"


def p1_sql(p: ScanParams, dna: str = DNA_SQL, columns: str = f"{HITS}, {SCORED}", scores_sql=scores_sql) -> str:
    """Greedy: filter, select, score, homopolymers.  By score: filter, score, homopolymers, select."""
    mixed = f"WHERE {MIXED} AND {MIXED_TRIPLEX}" if p.filter_homopolymers else ""
    if not p.remove_overlaps:
        return f"{passing_sql(p, dna)}, {scores_sql('pass', 'scored')} SELECT {columns} FROM scored {mixed}"
    if p.overlap_strategy == "greedy":
        return f"{passing_sql(p, dna)}, {greedy_sql('pass', 'kept')}, {scores_sql('kept', 'scored')} SELECT {columns} FROM scored {mixed}"
    return f"{passing_sql(p, dna)}, {scores_sql('pass', 'scored')}, mixed AS (SELECT * FROM scored {mixed}), {by_score_sql('mixed', 'kept')} SELECT {columns} FROM kept"


def c2_sql(p: ScanParams) -> str:
    purine = "length(left_arm) - length(translate(left_arm, 'ct', '')) <= length(left_arm) - length(translate(left_arm, 'ga', ''))"
    n = lambda b: f"(length(left_arm) - length(replace(left_arm, '{b}', '')))"
    bound = f"round(CASE WHEN {purine} THEN 7.6 * {n('g')} + 3.83 * {n('a')} ELSE 7.6 * {n('c')} + 3.83 * {n('t')} END + 5.0 * greatest(length(left_arm) - 1, 0), 3)::DOUBLE"
    models = {"pairing": (False, False), "pairing_stacking": (True, False), "complete": (True, True)}
    tables = ", ".join(f"{scores_sql('bare', 's_' + m, *how)}" for m, how in models.items())
    joins = " ".join(f'JOIN s_{m} USING (seq_id, start, "end", arm_length)' for m in list(models)[1:])
    return f"""{passing_sql(p)}, {greedy_sql('pass', 'kept')}, bare AS (SELECT * FROM kept WHERE {MIXED}), {tables}
SELECT seq_id, start, "end", arm_length, {bound.replace('left_arm', 's_pairing.left_arm')} AS bound, {', '.join(f's_{m}.total_score AS score_{m}' for m in models)} FROM s_pairing {joins}"""


def stages_sql(p: ScanParams, whole=scores_sql) -> str:
    """Hits, mean and highest score after each stage but the first, overlaps removed."""
    row = lambda i, stage, table, score="total_score": f"SELECT {i} AS step, '{stage}' AS stage, count(*) AS hits, round(avg({score}), 6) AS mean_score, max({score}) AS max_score FROM {table}"
    return f"""{passing_sql(p)}, {greedy_sql('pass', 'kept')}, {scores_sql('kept', 'pairing', False, False)}, {scores_sql('kept', 'stacked', True, False)}, {whole('pass', 'full')},
mixed AS (SELECT * FROM full_ WHERE {MIXED} AND {MIXED_TRIPLEX}), {greedy_sql('mixed', 'complete')}
{row(0, 'composition', 'kept', 'NULL::DOUBLE')} UNION ALL {row(1, 'pairing', 'pairing')} UNION ALL {row(2, 'pairing_stacking', 'stacked')} UNION ALL {row(3, 'complete', 'complete')}""".replace("full AS (SELECT h.*", "full_ AS (SELECT h.*").replace("full AS (SELECT q.*", "full_ AS (SELECT q.*")


def stage_metrics_sql(p: ScanParams, truth: str) -> str:
    """Counts and AUROC of the calls of each stage but the first against ``truth`` (record_ix, y), records without a hit scoring 0."""
    head = stages_sql(p, linear_scores_sql).split("\nSELECT 0 AS step")[0]
    per = lambda i, stage, table, score: f"SELECT {i} AS step, '{stage}' AS stage, record_ix, max({score}) AS s FROM {table} GROUP BY record_ix"
    rows = " UNION ALL ".join(per(i, st, t, sc) for i, (st, t, sc) in enumerate([("composition", "kept", "0.0::DOUBLE"), ("pairing", "pairing", "total_score"), ("pairing_stacking", "stacked", "total_score"), ("complete", "complete", "total_score")]))
    return f"""{head}, truth AS ({truth}), calls AS ({rows}), grid AS (SELECT s.step, s.stage, t.record_ix, t.y, coalesce(c.s, 0) AS s, c.record_ix IS NOT NULL AS p FROM (SELECT DISTINCT step, stage FROM calls) s, truth t LEFT JOIN calls c ON c.step = s.step AND c.record_ix = t.record_ix),
ranked AS (SELECT *, rank() OVER (PARTITION BY step ORDER BY s) + (count(*) OVER (PARTITION BY step, s) - 1) / 2 AS r FROM grid)
SELECT step, stage, count(*) FILTER (y = 1 AND p) AS tp, count(*) FILTER (y <> 1 AND p) AS fp, count(*) FILTER (y <> 1 AND NOT p) AS tn, count(*) FILTER (y = 1 AND NOT p) AS fn,
  round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y <> 1), 0), 6) AS auroc FROM ranked GROUP BY 1, 2"""


def detection_sql(p: ScanParams) -> str:
    return f"WITH RECURSIVE {DNA_SQL}, {candidates_sql(p.but(purity=0.0))}, {greedy_sql('cand', 'kept')} SELECT seq_id, start, \"end\", arm_length, spacer_length FROM kept"
