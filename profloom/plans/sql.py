"""DuckDB forms of the core queries."""

from __future__ import annotations

from profloom.plans.views import CALL_EDGES, EVENTS, NESTED_CALLS, ORDERS, PROFILES, SALES, VERSIONS

#: Added before rounding, so that means of two-digit amounts do not sit on a tie that engines break differently.
NUDGE = 1.3e-7


def off_ties(text: str) -> str:
    """``round(x, n)`` as ``round(x + NUDGE, n)`` throughout, innermost last."""
    out, at = [], 0
    while (k := text.find("round(", at)) >= 0:
        depth, i, comma = 0, k + 5, -1
        while True:
            c = text[i]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = i
            if depth == 0:
                break
            i += 1
        out += [text[at:k], f"round({off_ties(text[k + 6 : comma])} + {NUDGE}{text[comma:i]})"]
        at = i + 1
    return "".join(out) + text[at:]


_FUNCS = {"sum": "sum({})", "mean": "avg({})", "median": "quantile_cont({}, 0.5)", "nunique": "count(DISTINCT {})", "count": "count({})"}


def aggregate(func: str, of: str, per: str, by: str) -> str:
    value = _FUNCS[func].format(of)
    return f"SELECT {per} AS per, {by} AS by, {f'round({value}, 4)' if func not in ('nunique', 'count') else value} AS value FROM {EVENTS} GROUP BY {per}, {by}"


MIN_MAX_COUNT = f"SELECT version, uid, min(amount) AS lo, max(amount) AS hi, count(*) AS n FROM {EVENTS} GROUP BY version, uid"


def _dense(source: str, by: str) -> str:
    return f"""SELECT k."by", x::INT AS x, coalesce(value, 0) AS value FROM (SELECT DISTINCT {by} AS "by" FROM {source})
  k CROSS JOIN (SELECT unnest(range(min(snapshot), max(snapshot) + 1)) AS x FROM {source}) LEFT JOIN (SELECT {by} AS "by", snapshot AS x, sum(amount) AS value FROM {source} GROUP BY ALL) f USING ("by", x)"""


FLOW = f"""SELECT "by", x, round(value, 4) AS value FROM ({_dense(EVENTS, 'tid')})"""
FLOW_ACCUMULATED = f"""SELECT "by", x, round(value, 4) AS value, round(sum(value) OVER (PARTITION BY "by" ORDER BY x), 4) AS accumulated FROM ({_dense(EVENTS, 'uid')})"""
MEAN_AMOUNT = f"SELECT version, uid, round(avg(amount), 4) AS average FROM {EVENTS} GROUP BY version, uid"
TRACE_TOTALS = f"SELECT uid, trace, round(amount, 2) AS amount, round(100 * amount / sum(amount) OVER (), 2) AS percent FROM (SELECT uid, trace, sum(amount) AS amount FROM {ORDERS} GROUP BY ALL)"
FUNCTION_STATS = f"""SELECT version, uid, n + (n - 1) * 2 AS count, n AS sampled_count, round(t, 4) AS total, round(t, 4) AS total_exclusive, lo AS min, hi AS max, round(t / n, 4) AS avg,
  round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr FROM (SELECT version, uid, count(*) AS n, sum(amount) AS t, min(amount) AS lo, max(amount) AS hi,
  quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS q2, quantile_cont(amount, 0.75) AS q3 FROM {EVENTS} GROUP BY ALL)"""
FUNCTION_STATS_LEVELS = f"""SELECT tid, uid, count(*) AS count, round(sum(amount), 4) AS total, round(quantile_cont(amount, 0.25), 4) AS q1, round(quantile_cont(amount, 0.5), 4) AS median,
  round(quantile_cont(amount, 0.75), 4) AS q3 FROM {EVENTS} GROUP BY GROUPING SETS ((tid, uid), (uid))"""
PROFILES_PER_TYPE = f"SELECT version, type, count(*) AS n FROM {PROFILES} GROUP BY GROUPING SETS ((version, type), (version))"

_PARENTS = f"""(SELECT t.profile_id AS target_id, b.profile_id AS baseline_id, t.version, b.version AS parent, t.cmd FROM {PROFILES} t JOIN {VERSIONS} v ON v.checksum = t.version
  JOIN {PROFILES} b ON b.version = v.parent AND b.type = t.type AND b.cmd = t.cmd AND b.workload = t.workload AND b.collector = t.collector WHERE list_has_all(t.postprocessors, b.postprocessors))"""
_CHANGES = f"""(SELECT version, uid, rate, CASE WHEN rate >= 2 THEN 'Degradation' WHEN rate > 0 AND rate <= 0.5 THEN 'Optimization' ELSE 'NoChange' END AS result FROM (
  SELECT p.version, p.cmd AS uid, t.a / (CASE WHEN b.a = 0 THEN 1e-6 ELSE b.a END) AS rate FROM {_PARENTS} p
  JOIN (SELECT version, uid, avg(amount) AS a FROM {EVENTS} GROUP BY ALL) t ON t.version = p.version AND t.uid = p.cmd
  JOIN (SELECT version, uid, avg(amount) AS a FROM {EVENTS} GROUP BY ALL) b ON b.version = p.parent AND b.uid = p.cmd))"""
CHANGES_PER_RESULT = f"SELECT version, result, count(*) AS n FROM {_CHANGES} GROUP BY ALL"
CHECK_HISTORY = f"SELECT version, uid, round(rate, 4) AS rate, result FROM {_CHANGES}"
VERSION_LOG = f"""SELECT v.checksum, coalesce(n, 0) AS n_profiles, coalesce(repeat('+', u::INT), '') || coalesce(repeat('-', d::INT), '') AS changes FROM (SELECT DISTINCT checksum FROM {VERSIONS}) v
  LEFT JOIN (SELECT version, count(*) AS n FROM {PROFILES} GROUP BY version) p ON p.version = v.checksum
  LEFT JOIN (SELECT version, count(*) FILTER (WHERE result = 'Degradation') AS u, count(*) FILTER (WHERE result = 'Optimization') AS d FROM {_CHANGES} GROUP BY version) c ON c.version = v.checksum"""
DEGRADATION_RATIO = f"SELECT uid, round(avg((result = 'Degradation')::INT), 4) AS ratio FROM {_CHANGES} GROUP BY uid"
SNAPSHOTS_DENSE = f"""SELECT s::INT AS snapshot, coalesce(n, 0) AS n, round(amount, 4) AS amount FROM (SELECT unnest(range(0, max(snapshot) + 1)) AS s FROM {EVENTS})
  LEFT JOIN (SELECT snapshot, count(*) AS n, sum(amount) AS amount FROM {EVENTS} GROUP BY snapshot) ON snapshot = s"""
MERGE_PROFILES = f"""SELECT uid, snapshot, subtype, round(sum(amount), 4) AS amount FROM (SELECT uid, amount, snapshot, NULL::VARCHAR AS subtype FROM {EVENTS} UNION ALL
  SELECT uid, amount, NULL, subtype FROM {ORDERS}) GROUP BY ALL"""

FILTER_AND_OR = f"""SELECT "order", uid, snapshot, amount FROM {EVENTS} WHERE uid IN ('click', 'error') AND snapshot = 3"""
FILTER_OR = f"""SELECT "order", uid, snapshot FROM {EVENTS} WHERE uid = 'click' OR snapshot = 3"""
UNIQUE_VALUES = f"""SELECT structure_unit_size AS value, min("order") AS first_seen FROM {EVENTS} GROUP BY 1"""
FIELD_NAMES = "SELECT unnest(['uid', 'amount', 'snapshot']) AS field FROM (SELECT count(*) AS n FROM events) WHERE n > 0"
NUMERIC_FIELDS = f"""SELECT field FROM (SELECT unnest(['uid', 'amount', 'snapshot', 'version', 'structure_unit_size']) AS field,
  unnest([uid, amount::VARCHAR, snapshot::VARCHAR, version, structure_unit_size::VARCHAR]) AS v FROM {EVENTS}) WHERE v IS NOT NULL GROUP BY field HAVING bool_and(try_cast(v AS DOUBLE) IS NOT NULL)"""
KEY_VALUES = f"SELECT value, count(*) AS n FROM (SELECT r_name AS value FROM {ORDERS} UNION ALL SELECT n_name FROM {ORDERS}) GROUP BY value"
FLATTEN = f"""SELECT "order", uid || ':' || version AS key, uid AS "key:uid", version AS "key:version", trace FROM {ORDERS}"""
COMPATIBLE = f"""SELECT b.profile_id AS baseline_id, t.profile_id AS target_id FROM {PROFILES} b JOIN {PROFILES} t USING (type, cmd, workload, collector)
  WHERE b.version < '2024-01-04' AND t.version >= '2024-01-04' AND list_has_all(t.postprocessors, b.postprocessors)"""
SHORT_TRACE = f"""SELECT "order", r_name || ' -> ' || n_name || ' -> ' || subtype AS three, r_name || ' -> ... -> ' || uid AS four FROM {ORDERS}"""
TRACE_STEPS = f"SELECT DISTINCT r_name || '| ' || n_name || '|  ' || uid AS steps FROM {ORDERS}"

_TOTALS = f"(SELECT version, uid, trace, sum(amount) AS amount FROM {ORDERS} GROUP BY ALL)"
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY version ORDER BY amount DESC, uid, trace)::INT AS rank FROM {_TOTALS})"
TOP_N = f"SELECT version, uid, trace, round(amount, 2) AS amount, rank FROM {_RANKED} WHERE rank <= 10"
COMPARE_TOP_N = f"""SELECT rank, b.uid AS base_uid, b.trace AS base_trace, t.uid AS target_uid, t.trace AS target_trace, round(coalesce(t.amount, 0) - coalesce(b.amount, 0), 2) AS delta
  FROM (SELECT * FROM {_RANKED} WHERE rank <= 10 AND version = '1996') b FULL JOIN (SELECT * FROM {_RANKED} WHERE rank <= 10 AND version = '1997') t USING (rank)"""
NTH_PROFILE = f"""SELECT version, profile_id, nth::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY version ORDER BY time, profile_id) - 1 AS nth FROM {PROFILES}) WHERE nth BETWEEN 1 AND 2"""
COMMON_UIDS = f"SELECT tid AS uid FROM {EVENTS} WHERE amount >= 50 INTERSECT SELECT tid FROM {EVENTS} WHERE amount < 50"
_FUNCTIONS = "(SELECT caller AS func, version FROM {0} WHERE {1} UNION SELECT callee, version FROM {0} WHERE {1})"
NEW_FUNCTIONS = f"""SELECT func FROM {_FUNCTIONS.format(CALL_EDGES, "version = '1996'")} EXCEPT SELECT func FROM {_FUNCTIONS.format(CALL_EDGES, "version = '1995'")}"""

PARENT_BASELINES = f"SELECT target_id, baseline_id FROM {_PARENTS}"
ANCESTORS = f"""SELECT t.profile_id AS target_id, count(*) AS n, min(b.profile_id) AS oldest FROM {PROFILES} t JOIN {PROFILES} b ON b.version < t.version AND b.type = t.type AND b.cmd = t.cmd
  WHERE list_has_all(t.postprocessors, b.postprocessors) GROUP BY 1"""
NEAREST_VERSION = f"""SELECT w.uid, epoch_us(w.moment) AS t, v."order"::VARCHAR AS checksum FROM {EVENTS} w ASOF LEFT JOIN (SELECT * FROM {EVENTS}) v ON w.uid = v.uid AND w.moment >= v.moment"""
LATEST_STATS = f"""SELECT name, version, value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY version DESC) AS k FROM (
  SELECT version, 'u' || tid AS name, round(sum(amount), 4) AS value FROM {EVENTS} GROUP BY ALL)) WHERE k = 1"""
UPSERT = f"""SELECT version, uid AS location, 'time' AS type, 'log' AS cmdstr, result, CASE WHEN version >= '2024-01-10' THEN 0 ELSE round(rate, 4) END AS rate FROM {_CHANGES}"""
_EDGES = f"(SELECT DISTINCT caller, callee FROM {CALL_EDGES})"
CALLERS_CALLEES = f"""SELECT func, coalesce(string_agg(DISTINCT up, ',' ORDER BY up), '') AS callers, coalesce(string_agg(DISTINCT down, ',' ORDER BY down), '') AS callees FROM (
  SELECT caller AS func, NULL AS up, callee AS down FROM {_EDGES} UNION ALL SELECT callee, caller, NULL FROM {_EDGES}) GROUP BY func"""
ZIP_TRACES = f"""SELECT "order", i::INT AS i, a[i + 1] AS frame_a, b[i + 1] AS frame_b, coalesce(list_contains(b, a[i + 1]), false) AS a_in_b, coalesce(list_contains(a, b[i + 1]), false) AS b_in_a FROM (
  SELECT "order", [r_name, n_name] AS a, [uid, subtype, n_name] AS b, unnest(range(0, 3)) AS i FROM {ORDERS})"""

SMA = f"""SELECT "order", round(CASE WHEN count(*) OVER w >= 4 THEN avg(amount) OVER w END, 4) AS average FROM {EVENTS}
  WINDOW w AS (PARTITION BY uid ORDER BY "order", amount ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"""
SMM = f"""SELECT "order", round(CASE WHEN count(*) OVER w >= 2 THEN quantile_cont(amount, 0.5) OVER w END, 4) AS average FROM {EVENTS}
  WINDOW w AS (PARTITION BY uid ORDER BY "order", amount ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
EMA = f"""SELECT "order", round(CASE WHEN k >= 3 THEN list_reduce(list_transform(ys, lambda y: [y, 1.0]), lambda a, v: [a[1] * 0.5 + v[1], a[2] * 0.5 + 1])[1]
    / list_reduce(list_transform(ys, lambda y: [y, 1.0]), lambda a, v: [a[1] * 0.5 + v[1], a[2] * 0.5 + 1])[2] END, 4) AS average
  FROM (SELECT "order", list(amount) OVER (PARTITION BY uid ORDER BY "order" ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS ys, row_number() OVER (PARTITION BY uid ORDER BY "order") AS k FROM {EVENTS})"""
SMA_WEIGHTED = f"""SELECT "order", round(CASE WHEN len(ys) = 5 THEN (ys[1] + 2 * ys[2] + 3 * ys[3] + 2 * ys[4] + ys[5]) / 9 END, 4) AS average FROM (
  SELECT "order", list(amount) OVER (PARTITION BY uid ORDER BY "order" ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ys FROM {EVENTS})"""
SORT_AND_SPLIT = f"""SELECT uid, part::INT AS part, count(*) AS n, round(sum(amount), 4) AS amount FROM (SELECT uid, amount, ntile(7) OVER (PARTITION BY uid ORDER BY "order") AS part FROM {EVENTS}) GROUP BY ALL"""
TRACE_SEQUENCE = f"""SELECT "order" AS timestamp, ((row_number() OVER (PARTITION BY tid, uid ORDER BY "order") - 1) * 3)::INT AS sequence FROM {EVENTS}"""
PERCENT = f"""SELECT version, uid, round(amount, 4) AS amount, round(100 * amount / sum(amount) OVER (PARTITION BY version), 4) AS percent FROM (SELECT version, uid, sum(amount) AS amount FROM {EVENTS} GROUP BY ALL)"""
MERGE_INTERVALS = f"""WITH d AS (SELECT uid, dayofyear(version::DATE)::DOUBLE AS x, avg(amount) AS rate FROM {EVENTS} GROUP BY ALL),
  r AS (SELECT *, CASE WHEN rate > 21 THEN 'Degradation' WHEN rate < 19 THEN 'Optimization' ELSE 'NoChange' END AS result FROM d),
  m AS (SELECT *, (coalesce(lag(result) OVER (PARTITION BY uid ORDER BY x) <> result, true))::INT AS fresh FROM r),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY uid ORDER BY x) AS island FROM m)
  SELECT uid, result, min(x) AS x_start, max(x) + 1 AS x_end, round(avg(rate), 4) AS rate FROM g WHERE result <> 'NoChange' GROUP BY uid, island, result"""


def _family(source: str, keys: str) -> str:
    """The linear family of fits of (x, y) per group, one row per model."""
    part = lambda m, x, y, a, b: f"""SELECT {keys}, '{m}' AS model, regr_r2({y}, {x}) AS r_square, min(x) AS x_start, max(x) AS x_end, {a} AS b0, {b} AS b1, NULL::DOUBLE AS b2, count(*) AS n,
    regr_slope({y}, {x}) AS slope, avg({y}) AS mean FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {keys} HAVING count(*) >= 3 AND regr_slope({y}, {x}) IS NOT NULL AND NOT isnan(regr_slope({y}, {x}))"""  # noqa: E731
    ln, lx, ly = "CASE WHEN x > 0 THEN ln(x) END", "CASE WHEN x > 0 THEN log10(x) END", "CASE WHEN y > 0 THEN log10(y) END"
    plain = lambda x, y: (f"regr_intercept({y}, {x})", f"regr_slope({y}, {x})")
    return " UNION ALL ".join(
        [
            part("linear", "x", "y", *plain("x", "y")),
            part("logarithmic", ln, "y", *plain(ln, "y")),
            part("power", lx, ly, f"power(10, regr_intercept({ly}, {lx}))", f"regr_slope({ly}, {lx})"),
            part("exponential", "x", ly, f"power(10, regr_intercept({ly}, x))", f"power(10, regr_slope({ly}, x))"),
        ]
    )


def models(source: str, keys: str) -> str:
    """All models as one subquery; ``source`` has the keys, x and y."""
    on = " AND ".join(f"p.{k} = m.{k}" for k in keys.split(", "))
    return f"""(WITH fam AS ({_family(source, keys)}),
  c AS (SELECT {', '.join(f'p.{k}' for k in keys.split(', '))}, x, y, x - mx AS c, y - my AS v, mx, my FROM {source} p JOIN (SELECT {keys}, avg(x) AS mx, avg(y) AS my FROM {source} GROUP BY {keys}) m ON {on}),
  s AS (SELECT {keys}, count(*) AS n, max(mx) AS mx, max(my) AS my, min(x) AS lo, max(x) AS hi, sum(c*c) AS s2, sum(c*c*c) AS s3, sum(c*c*c*c) AS s4, sum(c*v) AS sxy, sum(c*c*v) AS sx2y, sum(v*v) AS syy FROM c GROUP BY {keys}),
  t AS (SELECT *, s4 - s2 * s2 / n - s3 * s3 / nullif(s2, 0) AS det FROM s), d AS (SELECT *, CASE WHEN det > 1e-10 * s4 THEN (sx2y - s3 * sxy / nullif(s2, 0)) / det END AS d FROM t), e AS (SELECT *, (sxy - s3 * d) / nullif(s2, 0) AS e FROM d)
  SELECT {keys}, model, r_square, x_start, x_end, b0, b1, b2, n FROM fam UNION ALL
  SELECT {keys}, 'constant', greatest(0.0, least(1.0, CASE WHEN turn > 0.01 THEN r_square * (1 - turn) ELSE 1 - r_square END)), x_start, x_end, mean, 0.0, NULL, n
    FROM (SELECT *, atan2(abs(slope * x_end), abs(x_end - x_start)) / 90 AS turn FROM fam WHERE model = 'linear') UNION ALL
  SELECT {keys}, 'quadratic', (e * sxy + d * sx2y) / nullif(syy, 0), lo, hi, -s2 * d / n + my - e * mx + d * mx * mx, e - 2 * d * mx, d, n FROM e WHERE n >= 3 AND e IS NOT NULL)"""


_XY = f"(SELECT profile_id, uid, location, structure_unit_size AS x, amount AS y FROM {SALES})"
_FITS = models(_XY, "profile_id, uid")


def fit(kind: str) -> str:
    digits = 4 if kind == "quadratic" else 6
    r = lambda c: f"round({c}, {digits}) AS {c}"
    return f"SELECT profile_id, uid, {r('r_square')}, {r('x_start')}, {r('x_end')}, {r('b0')}, {r('b1')}, {r('b2')}, n FROM {_FITS} WHERE model = '{kind}'"


_RANK = "CASE model WHEN 'exponential' THEN 0 WHEN 'linear' THEN 1 WHEN 'logarithmic' THEN 2 WHEN 'power' THEN 3 WHEN 'quadratic' THEN 4 ELSE 5 END"


def _best(source: str, keys: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(r_square, 9) DESC, {_RANK}) AS k FROM {source} WHERE r_square > 0) WHERE k = 1)"


BEST_MODEL = f"SELECT profile_id, uid, model, round(r_square, 4) AS r_square FROM {_best(_FITS, 'profile_id, uid')}"
_EVENT_XY = f"(SELECT uid || '-' || version AS uid, structure_unit_size AS x, amount AS y FROM {EVENTS})"
BEST_MODEL_COUNTS = f"SELECT CASE WHEN r_square > 0.5 THEN model ELSE 'undefined' END AS model, count(*) AS n FROM {_best(models(_EVENT_XY, 'uid'), 'uid')} GROUP BY 1"
_SHUFFLED = f"""(SELECT uid, x, y, part, unnest(range(part, 5)) AS step FROM (SELECT uid, structure_unit_size AS x, amount AS y,
  ntile(4) OVER (PARTITION BY uid ORDER BY (("order" % 2147483647) * 16807) % 2147483647, "order") AS part FROM {SALES}))"""
_PREFIXES = models(_SHUFFLED, "uid, step")
_CHOSEN = "SELECT uid, model, round(r_square, 4) AS r_square, round(b0, 4) AS b0, round(b1, 4) AS b1 FROM f JOIN won USING (uid, model) WHERE step = 4"
FIT_INITIAL_GUESS = f"WITH f AS (SELECT * FROM {_PREFIXES}), won AS (SELECT uid, model FROM {_best('(SELECT * FROM f)', 'uid, step')} WHERE step = 1) {_CHOSEN}"
FIT_ITERATIVE = f"""WITH f AS (SELECT * FROM {_PREFIXES}), raced AS (SELECT uid, model, CASE WHEN count(*) = 4 THEN min(r_square) ELSE '-Infinity'::DOUBLE END AS worst FROM f GROUP BY ALL),
  won AS (SELECT uid, first(model ORDER BY worst DESC, model) AS model FROM raced GROUP BY uid) {_CHOSEN}"""


def bisection(levels: int) -> str:
    """Segments halved level by level; ``levels`` as many as the largest group can need."""
    out = [f"o0 AS MATERIALIZED (SELECT uid, '0' AS segment, structure_unit_size AS x, amount AS y FROM {SALES})", f"b0 AS MATERIALIZED (SELECT * FROM {_best(models('o0', 'uid, segment'), 'uid, segment')})"]
    for d in range(levels):
        out += [
            f"h{d} AS MATERIALIZED (SELECT uid, segment, segment || '.' || ntile(2) OVER (PARTITION BY uid, segment ORDER BY x, y) AS half, x, y FROM o{d})",
            f"f{d} AS MATERIALIZED (SELECT regexp_replace(half, '.[12]$', '') AS segment, * FROM {_best(models(f'h{d}', 'uid, half'), 'uid, half')})",
            f"""s{d} AS MATERIALIZED (SELECT uid, segment FROM b{d} JOIN (SELECT uid, segment, list(DISTINCT model) AS kinds FROM f{d} GROUP BY ALL HAVING count(*) = 2) USING (uid, segment)
              WHERE NOT (len(kinds) = 1 AND list_contains(kinds, model)))""",
            f"b{d + 1} AS MATERIALIZED (SELECT uid, half AS segment, model, x_start, x_end FROM f{d} SEMI JOIN s{d} USING (uid, segment))",
            f"o{d + 1} AS MATERIALIZED (SELECT uid, half AS segment, x, y FROM h{d} SEMI JOIN s{d} USING (uid, segment))",
        ]
    leaves = " UNION ALL ".join(f"SELECT uid, segment, model, x_start, x_end FROM b{d} ANTI JOIN s{d} USING (uid, segment)" for d in range(levels))
    return f"WITH {', '.join(out)} SELECT uid, segment, model, round(x_start, 4) AS x_start, round(x_end, 4) AS x_end FROM ({leaves})"


FIT_BISECTION = bisection(18)
AUTO_WINDOW = f"""WITH RECURSIVE pts AS MATERIALIZED (SELECT uid, amount AS y, "order" AS x, row_number() OVER (PARTITION BY uid ORDER BY "order", amount) AS i FROM {EVENTS}),
  g AS MATERIALIZED (SELECT uid, count(*) AS n, avg(y) AS m, var_pop(y) AS v, greatest(1, floor(0.05 * (max(x) - min(x))))::INT AS w0 FROM pts GROUP BY uid),
  p AS MATERIALIZED (SELECT uid, i, sum(y - m) OVER (PARTITION BY uid ORDER BY i) AS s, y - m AS y, n, v, w0 FROM pts JOIN g USING (uid)),
  tries AS (SELECT *, unnest(range(1, w0 + 1)) AS w FROM p),
  ends AS (SELECT uid, w, n, v, y, least(i + (w - 1) // 2, n) AS hi, greatest(i - (w - 1 - (w - 1) // 2) - 1, 0) AS lo FROM tries),
  fits AS MATERIALIZED (SELECT e.uid, e.w, CASE WHEN any_value(e.v) > 0 THEN 1 - sum((e.y - (h.s - coalesce(l.s, 0)) / (e.hi - e.lo)) ** 2) / (any_value(e.n) * any_value(e.v)) ELSE 1 END AS r
    FROM ends e JOIN p h ON h.uid = e.uid AND h.i = e.hi LEFT JOIN p l ON l.uid = e.uid AND l.i = e.lo GROUP BY e.uid, e.w),
  walk AS (SELECT uid, w0 AS w FROM g UNION ALL SELECT uid, greatest(1, w - greatest(1, trunc(least(0.9 * w - 1, 0.15 * (w - 1) * (0.88 - r)))))::INT AS w FROM walk JOIN fits USING (uid, w) WHERE r < 0.88 AND w > 1)
  SELECT uid, w AS width, round(r, 4) AS r_square FROM (SELECT uid, min(w)::INT AS w FROM walk GROUP BY uid) JOIN fits USING (uid, w)"""
FIT_INTERVAL = f"""SELECT uid, part::INT AS part, count(*) AS n, min(x) AS x_start, max(x) AS x_end FROM (SELECT uid, "order"::DOUBLE + 1 AS x,
  ntile(4) OVER (PARTITION BY uid ORDER BY "order", structure_unit_size) AS part FROM {SALES}) GROUP BY ALL"""
_UID_FITS = models(_XY, "uid")
MODEL_POINTS = f"""SELECT uid, i::INT AS i, round(x, 4) AS x, round(b0 + b1 * x, 4) AS y FROM (SELECT *, CASE WHEN px = 0 THEN 1e-6 ELSE px END AS x FROM (
  SELECT *, x_start + i * ((x_end - x_start) / 50) AS px FROM (SELECT *, unnest(range(0, 51)) AS i FROM {_UID_FITS} WHERE model = 'linear')))"""
INTEGRAL = f"""SELECT uid, model, round(CASE model WHEN 'constant' THEN b0 * (x_end - x_start) WHEN 'linear' THEN b0 * (x_end - x_start) + b1 * (x_end * x_end - x_start * x_start) / 2
  ELSE b0 * (x_end - x_start) + b1 * (x_end * ln(x_end) - x_end - x_start * ln(x_start) + x_start) END, 2) AS area FROM {_UID_FITS} WHERE model IN ('constant', 'linear', 'logarithmic')"""


def regressogram(stat: str) -> str:
    value = "avg(y)" if stat == "avg" else "quantile_cont(y, 0.5)"
    return f"""WITH a AS (SELECT uid, min(x) AS lo, max(x) AS hi, min(y) AS y_start, avg(y) AS my FROM {_XY} GROUP BY uid),
  p AS (SELECT p.uid, y, lo, hi, y_start, my, least(floor((x - lo) * 8 / (hi - lo)), 7)::INT AS bin FROM {_XY} p JOIN a USING (uid)),
  b AS (SELECT uid, bin, {value} AS v FROM p GROUP BY ALL),
  r AS (SELECT uid, 1 - sum((y - v) * (y - v)) / sum((y - my) * (y - my)) AS r_square FROM p JOIN b USING (uid, bin) GROUP BY uid)
  SELECT a.uid, lo AS x_start, hi AS x_end, round(y_start, 4) AS y_start, round(r_square, 4) AS r_square, bucket, round(coalesce(v, 0), 4) AS stat
  FROM a JOIN r USING (uid) CROSS JOIN (SELECT unnest(range(0, 8))::INT AS bucket) LEFT JOIN b ON b.uid = a.uid AND bin = bucket"""


REGRESSOGRAM_RULES = f"""WITH a AS (SELECT uid, count(*) AS n, max(x) - min(x) AS span, stddev_pop(x) AS s, 2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / cbrt(count(*)) AS fd FROM {_XY} GROUP BY uid),
  w AS (SELECT uid, span, unnest(['fd', 'rice', 'scott', 'sqrt', 'sturges', 'auto']) AS rule,
    unnest([fd, span / (2 * cbrt(n)), cbrt(24 * sqrt(pi()) / n) * s, span / sqrt(n), span / (log2(n) + 1), CASE WHEN fd > 0 THEN least(fd, span / (log2(n) + 1)) ELSE span / (log2(n) + 1) END]) AS width FROM a)
  SELECT uid, rule, greatest(1, ceil(span / width))::INT AS buckets FROM w"""
_PAIRS = f"(SELECT a.uid, a.x AS xi, b.x - a.x AS d, b.y, 0.75 * (1 - (b.x - a.x) * (b.x - a.x) / 25) AS w FROM (SELECT DISTINCT uid, x FROM {_XY}) a JOIN {_XY} b ON a.uid = b.uid AND abs(a.x - b.x) < 5)"
KERNEL_CONSTANT = f"SELECT uid, xi AS x, round(sum(w * y) / sum(w), 2) AS estimate FROM {_PAIRS} GROUP BY uid, xi"
KERNEL_LINEAR = f"""SELECT uid, xi AS x, round((sum(w * d * d) * sum(w * y) - sum(w * d) * sum(w * d * y)) / (sum(w) * sum(w * d * d) - sum(w * d) * sum(w * d)), 2) AS estimate FROM {_PAIRS} GROUP BY uid, xi"""
KERNEL_RIDGE = f"""WITH z AS (SELECT uid, x, count(*) AS m, sum(y) AS sy, sum(y * y) AS syy FROM {_XY} GROUP BY uid, x),
  s AS (SELECT a.uid, g, a.x, any_value(a.m) AS m, any_value(a.sy) AS sy, any_value(a.syy) AS syy, sum(exp(-g * (a.x - b.x) * (a.x - b.x)) * b.sy) AS p, sum(exp(-g * (a.x - b.x) * (a.x - b.x)) * b.m) - 1 AS r
    FROM z a JOIN z b ON a.uid = b.uid CROSS JOIN (SELECT unnest([0.001, 0.01, 0.1, 1.0]) AS g) GROUP BY ALL),
  e AS (SELECT uid, g AS gamma, sum((1 + 1 / r) * (1 + 1 / r) * syy - 2 * (1 + 1 / r) * (p / r) * sy + m * (p / r) * (p / r)) / sum(m) AS mse FROM s GROUP BY ALL)
  SELECT uid, round(gamma, 4) AS gamma, round(mse / 1e6, 4) AS mse FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY mse, gamma) AS k FROM e) WHERE k = 1"""
KERNEL_RIDGE_MODEL = KERNEL_RIDGE.replace("SELECT uid, round(gamma, 4) AS gamma, round(mse / 1e6, 4) AS mse FROM", """, best AS (SELECT uid, gamma FROM""").replace("WHERE k = 1", """WHERE k = 1),
  p AS (SELECT a.uid, a.x, gamma, any_value(a.m) AS m, any_value(a.sy) AS sy, any_value(a.syy) AS syy, sum(exp(-gamma * (a.x - b.x) ** 2) * b.sy) / sum(exp(-gamma * (a.x - b.x) ** 2) * b.m) AS v
    FROM z a JOIN z b ON a.uid = b.uid JOIN best ON best.uid = a.uid GROUP BY ALL)
  SELECT uid, round(gamma, 4) AS gamma, min(x) AS x_start, max(x) AS x_end, count(*)::INT AS points, round(min(v), 4) AS lowest, round(max(v), 4) AS highest,
    round(1 - sum(syy - 2 * v * sy + m * v * v) / (sum(syy) - sum(sy) ** 2 / sum(m)), 4) AS r_square FROM p GROUP BY uid, gamma""")
BANDWIDTH = f"""SELECT uid, round(1.059 * s * power(n, -0.2), 4) AS scott, round(0.9 * least(s, q / 1.349) * power(n, -0.2), 4) AS silverman FROM (
  SELECT uid, count(*) AS n, stddev_samp(x) AS s, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS q FROM {_XY} GROUP BY uid)"""

CHECK_AAT = f"""SELECT uid, round(b, 4) AS base, round(t, 4) AS target, round(t / b, 4) AS rate, CASE WHEN t / b >= 2 THEN 'Degradation' WHEN t / b > 0 AND t / b <= 0.5 THEN 'Optimization' ELSE 'NoChange' END AS result
  FROM (SELECT uid, avg(y) FILTER (WHERE profile_id = 'baseline') AS b, avg(y) FILTER (WHERE profile_id = 'target') AS t FROM {_XY} GROUP BY uid) WHERE b IS NOT NULL AND t IS NOT NULL"""
_BEST = _best(_FITS, "profile_id, uid")
_BOTH = "(SELECT * FROM {0} WHERE profile_id = 'baseline') b JOIN (SELECT * FROM {0} WHERE profile_id = 'target') t USING (uid)"
_ORDER = "list_position(['constant', 'logarithmic', 'linear', 'quadratic', 'power', 'exponential'], {})"
CHECK_ORDER = f"""SELECT uid, base_model, target_model, round(c, 4) AS confidence, (CASE WHEN changed THEN r ELSE 0 END)::INT AS rate,
  CASE WHEN NOT changed THEN 'NoChange' WHEN r < 0 THEN 'Optimization' ELSE 'Degradation' END AS result FROM (
  SELECT uid, b.model AS base_model, t.model AS target_model, least(b.r_square, t.r_square) AS c, least(b.r_square, t.r_square) >= 0.9 AND b.model <> t.model AS changed,
    {_ORDER.format('t.model')} - {_ORDER.format('b.model')} AS r FROM {_BOTH.format(_BEST)})"""
_Y = "CASE {0}.model WHEN 'constant' THEN {0}.b0 WHEN 'linear' THEN {0}.b0 + {0}.b1 * {1} WHEN 'logarithmic' THEN {0}.b0 + {0}.b1 * ln({1}) WHEN 'quadratic' THEN {0}.b0 + {0}.b1 * {1} + {0}.b2 * {1} * {1} WHEN 'power' THEN {0}.b0 * power({1}, {0}.b1) ELSE {0}.b0 * power({0}.b1, {1}) END"
_AT = "({0}.x_start + i * ({0}.x_end - {0}.x_start) / 999)"
CHECK_GENERAL = f"""WITH q AS (SELECT uid, i, b.model AS base_model, t.model AS target_model, {_Y.format('b', _AT.format('b'))} AS by_, {_Y.format('t', _AT.format('t'))} AS ty,
    abs(t.b0 - b.b0) <= 0.05 * abs(b.b0) AND abs(t.b1 - b.b1) <= 0.05 * abs(b.b1) AS same FROM {_BOTH.format(_BEST)} CROSS JOIN (SELECT unnest(range(0, 1000)) AS i)),
  s AS (SELECT uid, base_model, target_model, same, sum(coalesce((ty - by_) / nullif(by_, 0), 0)) / 1000 * 100 AS rate, sum(ty - by_) AS total FROM q GROUP BY ALL),
  l AS (SELECT uid, least(b.r_square, t.r_square) AS confidence FROM {_BOTH.format(f"(SELECT * FROM {_FITS} WHERE model = 'linear' AND r_square > 0)")})
  SELECT uid, base_model, target_model, round(rate, 4) AS rate, round(confidence, 4) AS confidence, CASE WHEN same THEN 'NoChange' WHEN total > 0 THEN CASE WHEN rate > 25 THEN 'Degradation' ELSE 'MaybeDegradation' END
    ELSE CASE WHEN rate < -25 THEN 'Optimization' ELSE 'MaybeOptimization' END END AS result FROM s JOIN l USING (uid)"""
_LINEAR_FITS = f"(SELECT * FROM {_FITS} WHERE model = 'linear' AND r_square > 0)"
_ERRORS = f"""lin AS (SELECT uid, b.b0 AS bb0, b.b1 AS bb1, b.x_start AS bs, b.x_end AS be, t.b0 AS tb0, t.b1 AS tb1, t.x_start AS ts, t.x_end AS te FROM {_BOTH.format(_LINEAR_FITS)}),
  e AS (SELECT uid, i, b.model AS base_model, t.model AS target_model, {_AT.format('b')} AS x, {_Y.format('t', _AT.format('t'))} - {_Y.format('b', _AT.format('b'))} AS y
    FROM {_BOTH.format(_BEST)} CROSS JOIN (SELECT unnest(range(0, 1000)) AS i)),
  le AS (SELECT e.*, (i - 499.5) / 500 AS u, bb1, tb1, tb0 + tb1 * (ts + i * (te - ts) / 999) - bb0 - bb1 * (bs + i * (be - bs) / 999) AS l FROM e JOIN lin USING (uid)),
  kinds AS (SELECT uid, model FROM {_best(models('e', 'uid'), 'uid')})"""
_POLYNOMIAL = f"""WITH {_ERRORS}, m AS (SELECT avg(u ** 2) AS m2, avg(u ** 4) AS m4 FROM (SELECT DISTINCT i, u FROM le)),
  g AS (SELECT uid, l, u, u * u - m2 AS p2, u ** 3 - m4 / m2 * u AS p3 FROM le CROSS JOIN m),
  r AS (SELECT uid, sum(l * l) AS yy, sum(l) ** 2 / count(*) AS c0, sum(u * l) ** 2 / sum(u * u) AS c1, sum(p2 * l) ** 2 / sum(p2 * p2) AS c2 FROM g GROUP BY uid)
  SELECT uid, CASE WHEN yy - c0 < 1e8 THEN 'CONSTANT' WHEN yy - c0 - c1 < 1e8 THEN 'LINEAR' WHEN yy - c0 - c1 - c2 < 1e8 THEN 'QUADRATIC' ELSE 'CUBIC' END AS change_type FROM r"""
_LINEAR_TYPE = f"""WITH {_ERRORS}, r AS (SELECT uid, any_value(base_model) AS base_model, any_value(target_model) AS target_model, any_value(bb1) AS bb1, any_value(tb1 - bb1) AS d, regr_slope(l, x) AS s, regr_intercept(l, x) AS c, max(y) AS top
    FROM le GROUP BY uid)
  SELECT uid, upper(CASE WHEN abs(d) <= 1e-9 * (1 + abs(bb1)) THEN 'constant' WHEN abs(s - d) <= 1e-6 * (1 + abs(d)) AND abs(c) <= abs(0.05 * top) THEN 'linear'
    WHEN base_model = target_model THEN coalesce(model, 'quadratic') ELSE target_model END) AS change_type FROM r LEFT JOIN kinds USING (uid)"""
_FAST_TYPE = f"WITH {_ERRORS} SELECT uid, upper(model) AS change_type FROM kinds"
CHECK_TYPED = {kind: f"SELECT * FROM ({CHECK_GENERAL}) LEFT JOIN ({types}) USING (uid)" for kind, types in (("polynomial_regression", _POLYNOMIAL), ("linear_regression", _LINEAR_TYPE), ("fast_check", _FAST_TYPE))}
_CLASS = "CASE WHEN abs({0}) <= {1} THEN 'NoChange' WHEN abs({0}) <= {2} THEN CASE WHEN {0} < 0 THEN 'MaybeOptimization' ELSE 'MaybeDegradation' END ELSE CASE WHEN {0} < 0 THEN 'Optimization' ELSE 'Degradation' END END"
_LINE_AREA = "({0}.b0 * ({0}.x_end - {0}.x_start) + {0}.b1 * ({0}.x_end * {0}.x_end - {0}.x_start * {0}.x_start) / 2)"
CHECK_INTEGRAL = f"""SELECT uid, round(ba, 2) AS base_area, round(ta, 2) AS target_area, round((ta - ba) / ba, 2) AS rate, {_CLASS.format('((ta - ba) / ba)', 0.1, 0.25)} AS result FROM (
  SELECT uid, {_LINE_AREA.format('b')} AS ba, {_LINE_AREA.format('t')} AS ta FROM {_BOTH.format(f"(SELECT * FROM {_FITS} WHERE model = 'linear' AND r_square > 0)")})"""

_SERIES = f"(SELECT profile_id, uid, x, avg(y) AS y FROM {_XY} GROUP BY ALL)"
_BLOCKS = f"""(SELECT *, floor((k - 1) / size)::INT AS block FROM (SELECT *, CASE WHEN floor(n * 0.05) >= 2 THEN floor(n * 0.05)::INT ELSE n END AS size FROM (
  SELECT *, count(*) OVER (PARTITION BY profile_id, uid) AS n, row_number() OVER (PARTITION BY profile_id, uid ORDER BY x) AS k FROM {_SERIES})))"""
_TRAPEZOID = "sum(a)"
_STATS = f"""(SELECT profile_id, uid, block, min(x) AS x_start, max(x) AS x_end, avg(y) AS avg, quantile_cont(y, 0.5) AS med, max(y) AS max, min(y) AS min, sum(y) AS sum, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3,
  list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys FROM {_BLOCKS} GROUP BY profile_id, uid, block)"""
LOCAL_WINDOWS = f"""SELECT uid, block, x_start, x_end, round(avg, 3) AS avg, round(med, 3) AS med, round(max, 3) AS max, round(min, 3) AS min, round(sum, 3) AS sum, round(q1, 3) AS q1, round(q3, 3) AS q3
  FROM {_STATS} WHERE profile_id = 'baseline'"""
# blocks of two points: Simpson's rule falls back to the trapezoid
_INT = "(CASE WHEN len(xs) < 2 THEN 0 ELSE (xs[2] - xs[1]) * (ys[1] + ys[2]) / 2 END)"
_REL = "coalesce((t.{0} - b.{0}) / nullif(b.{0}, 0), 0)"
CHECK_LOCAL = f"""SELECT uid, round(round(rate, 2), 4) AS rate, {_CLASS.format('rate', 0.1, 0.25)} AS result FROM (SELECT uid, avg(({' + '.join(_REL.format(s) for s in ('int', 'avg', 'med', 'max', 'min', 'sum', 'q1', 'q3'))}) / 8) AS rate
  FROM (SELECT *, {_INT} AS int FROM {_STATS} WHERE profile_id = 'baseline') b JOIN (SELECT *, {_INT} AS int FROM {_STATS} WHERE profile_id = 'target') t USING (uid, block) GROUP BY uid)"""

_ALL_STATS = ("int", "avg", "med", "max", "min", "sum", "q1", "q3")
_SCORE = "(CASE WHEN abs({0}) <= 0.1 THEN 0 WHEN abs({0}) <= 0.25 THEN sign({0}) * 0.5 ELSE sign({0}) END)"
LOCAL_INTERVALS = f"""WITH e AS (SELECT uid, block, t.x_start, t.x_end, {', '.join(f'{_REL.format(s)} AS e_{s}' for s in _ALL_STATS)}
  FROM (SELECT *, {_INT} AS int FROM {_STATS} WHERE profile_id = 'baseline') b JOIN (SELECT *, {_INT} AS int FROM {_STATS} WHERE profile_id = 'target') t USING (uid, block)),
  c AS (SELECT uid, x_start, x_end, ({' + '.join(f'e_{s}' for s in _ALL_STATS)}) / 8 AS rate, {' + '.join(_SCORE.format(f'e_{s}') for s in _ALL_STATS)} AS total FROM e),
  r AS (SELECT *, {_CLASS.format('total', 1.6, 4.0)} AS result FROM c), m AS (SELECT *, (coalesce(lag(result) OVER (PARTITION BY uid ORDER BY x_start) <> result, true))::INT AS fresh FROM r),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY uid ORDER BY x_start) AS island FROM m)
  SELECT uid, result, round(min(x_start), 4) AS x_start, round(max(x_end), 4) AS x_end, round(avg(rate), 4) AS rate FROM g WHERE result <> 'NoChange' GROUP BY uid, island, result"""
MOVING_MODEL = f"""WITH r AS (SELECT uid, "order"::DOUBLE AS x, amount AS y, CASE WHEN count(*) OVER w = 9 THEN avg(amount) OVER w ELSE 0 END AS fit, avg(amount) OVER (PARTITION BY uid) AS my
  FROM {SALES} WINDOW w AS (PARTITION BY uid ORDER BY "order", amount ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
  SELECT uid, min(x) AS x_start, max(x) AS x_end, 9 AS window_width, round(1 - sum((y - fit) * (y - fit)) / sum((y - my) * (y - my)), 4) AS r_square, count(*)::INT AS points FROM r GROUP BY uid"""

_EXCLUSIVE = f"""(WITH b AS (SELECT uid, location, sum(y * 1000) / 1e6 AS base FROM {_XY} WHERE profile_id = 'baseline' GROUP BY ALL),
  t AS (SELECT CASE WHEN uid LIKE 'E%' AND location = 'A' THEN uid || '_v2' ELSE uid END AS uid, location, sum(y * 1000) / 1e6 AS target FROM {_XY} WHERE profile_id = 'target' GROUP BY ALL)
  SELECT uid, location, base, target, coalesce(target, 0) - coalesce(base, 0) AS delta, 100 * (coalesce(target, 0) - coalesce(base, 0)) / sum(target) OVER () AS share FROM b FULL JOIN t USING (uid, location))"""
EXCLUSIVE_DIFF = f"SELECT uid, location, round(base, 3) AS base, round(target, 3) AS target, round(delta, 3) AS delta, round(share, 3) AS share FROM {_EXCLUSIVE}"
LOCATION_TOTALS = f"""SELECT location, round(base, 3) AS base, round(target, 3) AS target, round(delta, 3) AS delta, round(share, 3) AS share, CASE WHEN share > 0 THEN 'TotalDegradation' ELSE 'TotalOptimization' END AS result FROM (
  SELECT location, sum(coalesce(base, 0)) AS base, sum(coalesce(target, 0)) AS target, sum(delta) AS delta, sum(share) AS share FROM {_EXCLUSIVE} GROUP BY location)"""
CHECK_OUTLIERS = f"""WITH d AS (SELECT * FROM {_EXCLUSIVE}), q AS (SELECT quantile_cont(delta, 0.25) AS q1, quantile_cont(delta, 0.5) AS med, quantile_cont(delta, 0.75) AS q3 FROM d),
  m AS (SELECT quantile_cont(abs(delta - med), 0.5) AS mad FROM d, q),
  f AS (SELECT *, 0.6745 * abs(delta - med) / nullif(mad, 0) > 3.5 AS mz, delta < q1 - 1.5 * (q3 - q1) AS low, delta > q3 + 1.5 * (q3 - q1) AS high FROM d, q, m),
  s AS (SELECT stddev_samp(delta) AS std FROM f WHERE NOT mz AND NOT low AND NOT high),
  g AS (SELECT *, delta / nullif(std, 0) AS sm, CASE WHEN low THEN (q1 - delta) / nullif(q3 - q1, 0) WHEN high THEN (delta - q3) / nullif(q3 - q1, 0) END AS im FROM f, s)
  SELECT uid, location, round(base, 3) AS base, round(target, 3) AS target, round(delta, 3) AS rate, round(share, 3) AS rate_relative,
    CASE WHEN base IS NULL THEN 'NotInBaseline' WHEN target IS NULL THEN 'NotInTarget' WHEN mz THEN 'Severe' || w WHEN low OR high THEN w WHEN coalesce(abs(sm) > 2, false) THEN 'Maybe' || w ELSE 'NoChange' END AS result,
    CASE WHEN mz OR low OR high THEN 'IQR_multiple' ELSE 'StdDev_multiple' END AS confidence_type, round(CASE WHEN mz OR low OR high THEN im ELSE sm END, 2) AS confidence
  FROM (SELECT *, CASE WHEN delta > 0 THEN 'Degradation' ELSE 'Optimization' END AS w FROM g) WHERE abs(share) >= 0.01"""

_CALLS = f"""(WITH r AS (SELECT * FROM {NESTED_CALLS}), d AS (SELECT *, sum(step) OVER (PARTITION BY tid ORDER BY timestamp, step, func ROWS UNBOUNDED PRECEDING) + CASE WHEN step < 0 THEN 1 ELSE 0 END AS depth FROM r),
  p AS (SELECT *, lead(timestamp) OVER (PARTITION BY tid, depth ORDER BY timestamp, step, func) AS fin FROM d),
  c AS (SELECT tid, func AS uid, depth::INT AS depth, timestamp AS begin, fin - timestamp AS amount FROM p WHERE step > 0)
  SELECT c.*, u.uid AS parent, u.begin AS parent_begin FROM c ASOF LEFT JOIN (SELECT tid, depth + 1 AS depth, uid, begin FROM c) u ON u.tid = c.tid AND u.depth = c.depth AND c.begin >= u.begin)"""
PAIR_CALLS = f"SELECT tid, uid, depth, begin, amount, parent FROM {_CALLS}"
_EXCL = f"""(WITH c AS (SELECT * FROM {_CALLS}) SELECT c.*, amount - coalesce(inner_, 0) AS exclusive, inner_ IS NOT NULL AS has_children FROM c LEFT JOIN (
  SELECT tid, depth - 1 AS depth, parent_begin AS begin, sum(amount) AS inner_ FROM c WHERE parent_begin IS NOT NULL GROUP BY ALL) k USING (tid, depth, begin))"""
EXCLUSIVE_TIME = f"SELECT uid, depth, sum(amount)::BIGINT AS amount, sum(exclusive)::BIGINT AS exclusive, count(*) AS n FROM {_EXCL} GROUP BY uid, depth"
HOTSPOTS = f"SELECT tid, sum(amount)::BIGINT AS hotspot_time, count(DISTINCT uid) AS hotspots FROM {_EXCL} WHERE NOT has_children GROUP BY tid"
DYNAMIC_GRAPH = f"SELECT DISTINCT parent AS caller, uid AS callee FROM {_CALLS} WHERE parent IS NOT NULL"
_REACH = f"""WITH RECURSIVE reach(func, level) AS (SELECT 'main', 0 UNION SELECT e.callee, level + 1 FROM reach r JOIN {_EDGES} e ON e.caller = r.func WHERE level < 20)"""
REACHABLE = f"{_REACH} SELECT func, min(level)::INT AS level FROM reach GROUP BY func"
LEVELS = f"{_REACH} SELECT func, max(level)::INT AS level FROM reach GROUP BY func"
LEAVES = f"SELECT callee AS func FROM {_EDGES} EXCEPT SELECT caller FROM {_EDGES}"
TOP_DOWN = f"{_REACH} SELECT func, max(level)::INT AS level FROM reach WHERE func IN (SELECT caller FROM {_EDGES}) GROUP BY func HAVING max(level) < 3"
BOTTOM_UP = f"""SELECT callee AS func FROM {_EDGES} WHERE callee NOT IN (SELECT caller FROM {_EDGES}) UNION SELECT caller FROM {_EDGES} WHERE callee NOT IN (SELECT caller FROM {_EDGES})"""
WRAPPERS = f"""WITH c AS (SELECT uid || '-' || tid AS uid, CASE WHEN parent IS NOT NULL THEN parent || '-' || tid END AS parent, amount FROM {_CALLS}),
  e AS (SELECT DISTINCT parent AS caller, uid AS callee FROM c WHERE parent IS NOT NULL), s AS (SELECT uid, count(*) AS n, quantile_cont(amount::DOUBLE, 0.5) AS m FROM c GROUP BY uid),
  f AS (SELECT caller, count(*) AS fan FROM e GROUP BY caller)
  SELECT callee AS func FROM e JOIN f USING (caller) JOIN s a ON a.uid = caller JOIN s b ON b.uid = callee GROUP BY callee HAVING bool_and(fan = 1 AND a.n = b.n AND b.m >= 0.8 * a.m)"""
SAMPLING = f"""{_REACH}, l AS (SELECT func, max(level) AS level FROM reach GROUP BY func), c AS (SELECT uid, count(*) AS n FROM {ORDERS} GROUP BY uid)
  SELECT func, floor(CASE WHEN n IS NULL OR n BETWEEN 450 AND 550 THEN power(2, level) ELSE greatest(1, floor(power(2, level) * n / 500)) END)::BIGINT AS sample FROM l LEFT JOIN c ON uid = func"""
_SETS = """(SELECT func, list_sort(list_distinct(list(up) FILTER (WHERE up IS NOT NULL))) AS callers, list_sort(list_distinct(list(down) FILTER (WHERE down IS NOT NULL))) AS callees FROM (
  SELECT caller AS func, NULL AS up, callee AS down FROM {0} UNION ALL SELECT callee, caller, NULL FROM {0}) GROUP BY func)"""
DIFF_GRAPHS = f"""WITH e AS (SELECT * FROM {CALL_EDGES}), x AS (SELECT caller, callee FROM e WHERE version = '1996'),
  y AS (SELECT caller, CASE WHEN ends_with(callee, 'Y') THEN 'new_' || callee ELSE callee END AS callee FROM e WHERE version = '1997'),
  b AS (SELECT func, coalesce(callers, []) AS callers, coalesce(callees, []) AS callees FROM {_SETS.format('x')}), t AS (SELECT func, coalesce(callers, []) AS callers, coalesce(callees, []) AS callees FROM {_SETS.format('y')}),
  fresh AS (SELECT *, row_number() OVER (PARTITION BY callers, callees ORDER BY func) AS k FROM t WHERE func NOT IN (SELECT func FROM b)),
  gone AS (SELECT *, row_number() OVER (PARTITION BY callers, callees ORDER BY func) AS k FROM b WHERE func NOT IN (SELECT func FROM t)),
  ren AS (SELECT fresh.func, gone.func AS old FROM fresh JOIN gone USING (callers, callees, k))
  SELECT 'renamed' AS kind, func, old AS renamed_from FROM ren UNION ALL SELECT 'new', func, NULL FROM fresh WHERE func NOT IN (SELECT func FROM ren)
  UNION ALL SELECT 'deleted', func, NULL FROM gone WHERE func NOT IN (SELECT old FROM ren) UNION ALL SELECT 'modified', b.func, NULL FROM b JOIN t USING (func) WHERE b.callees <> t.callees"""
_STACK = "r_name || ';' || n_name || ';' || uid"
FOLD = f"SELECT version, {_STACK} AS stack, round(sum(amount), 2) AS amount FROM {ORDERS} GROUP BY ALL"
DIFF_FOLDED = f"""WITH b AS (SELECT {_STACK} AS stack, sum(amount) AS base FROM {ORDERS} WHERE version = '1996' GROUP BY ALL), t AS (SELECT {_STACK} AS stack, sum(amount) AS target FROM {ORDERS} WHERE version = '1997' GROUP BY ALL),
  j AS (SELECT stack, coalesce(base, 0) AS base, coalesce(target, 0) AS target FROM b FULL JOIN t USING (stack)) SELECT stack, round(base * (SELECT sum(target) / sum(base) FROM j), 2) AS base, round(target, 2) AS target FROM j"""
PROMOTE = f"SELECT snapshot::DOUBLE AS hour, sum(structure_unit_size) AS size, count(*) AS n FROM {EVENTS} GROUP BY snapshot"
UID_ORDER = f"SELECT n_name || ':' || uid || ':' || subtype || ':' || version AS uid, count(*) AS n FROM {ORDERS} GROUP BY 1"
RULES = f"""SELECT profile_id, CASE WHEN type = 'time' THEN 'aat' WHEN list_contains(postprocessors, 'fit') THEN 'bmoe' ELSE 'eto' END AS method FROM {PROFILES} WHERE type = 'time' OR list_contains(postprocessors, 'fit') OR cmd = 'error'"""
LAST_OF_DAY = f"SELECT version, profile_id AS path, type FROM {PROFILES} WHERE (type <> 'mixed' AND cmd <> 'click') OR (cmd <> 'click' AND type = 'mixed')"
RUNNING_BEST = f"""SELECT tid, b AS begin, e AS end, e - b AS amount FROM (SELECT tid, min("order") FILTER (WHERE uid IN ('click', 'purchase', 'signup')) AS b, max("order") FILTER (WHERE uid IN ('view', 'error')) AS e FROM {EVENTS} GROUP BY tid) WHERE b IS NOT NULL AND e IS NOT NULL"""
STATS_UPDATE = f"""WITH m AS (SELECT version, CASE WHEN snapshot >= 12 AND version <= '2024-01-05' THEN uid || '_moved' ELSE uid END AS name, snapshot FROM {EVENTS}),
  a AS (SELECT version, name, count(*) FILTER (WHERE snapshot < 12) AS am, count(*) FILTER (WHERE snapshot >= 12) AS pm FROM m GROUP BY ALL)
  SELECT version, name, CASE WHEN am > 0 THEN am::VARCHAR END AS am, CASE WHEN pm > 0 THEN pm::VARCHAR END AS pm, CASE WHEN pm > 0 THEN 'pm' ELSE 'am' END AS k FROM a"""
