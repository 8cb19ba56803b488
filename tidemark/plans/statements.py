"""SQL statements that Spark and other engines read alike.

A statement is a list of common table expressions and a final SELECT, without the leading WITH. Tables that it takes as input
are written {name}. Ties in every choice are broken, and counts are BIGINT."""

from __future__ import annotations

# --- series from tables ---------------------------------------------------------------------------------------------

EVENTS_HOURLY = """
h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS h, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS v
      FROM {events} WHERE value IS NOT NULL GROUP BY event_type, date_trunc('hour', ts))
SELECT series_id, CAST(ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY h) - 1 AS BIGINT) AS t, v FROM h"""

ORDERS_DAILY = """
d AS (SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS d, CAST(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v
      FROM {orders} GROUP BY o_orderpriority, date_trunc('day', o_orderdate))
SELECT series_id, CAST(ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY d) - 1 AS BIGINT) AS t, v FROM d"""

LINEITEM_WIDE = """
m AS (SELECT date_trunc('month', l_shipdate) AS m,
             CAST(SUM(CASE WHEN l_returnflag = 'A' THEN CAST(ROUND(l_quantity) AS BIGINT) ELSE 0 END) AS BIGINT) AS a,
             CAST(SUM(CASE WHEN l_returnflag = 'N' THEN CAST(ROUND(l_quantity) AS BIGINT) ELSE 0 END) AS BIGINT) AS n,
             CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(ROUND(l_quantity) AS BIGINT) ELSE 0 END) AS BIGINT) AS r
      FROM {lineitem} GROUP BY date_trunc('month', l_shipdate))
SELECT 'lineitem' AS series_id, CAST(ROW_NUMBER() OVER (ORDER BY m) - 1 AS BIGINT) AS t, a, n, r FROM m"""

#: Labels of a series: three states in turn, and predictions that lag, split and err by a rule on the values.
LABELS = """
h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS h, CAST(SUM(CAST(ROUND(value * 100) AS BIGINT)) AS BIGINT) AS v
      FROM {events} WHERE value IS NOT NULL GROUP BY event_type, date_trunc('hour', ts)),
s AS (SELECT series_id, CAST(ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY h) - 1 AS BIGINT) AS t, v FROM h)
SELECT series_id, t, CAST(FLOOR(t / 97.0) AS BIGINT) % 3 AS y_true,
       CASE WHEN v % 11 = 0 THEN 3 ELSE CAST(FLOOR((t + 9) / 97.0) AS BIGINT) % 3 END AS y_pred FROM s"""

CPS = """
h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS h FROM {events} WHERE value IS NOT NULL GROUP BY event_type, date_trunc('hour', ts)),
n AS (SELECT series_id, COUNT(*) AS n FROM h GROUP BY series_id),
s AS (SELECT series_id, CAST(ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY h) - 1 AS BIGINT) AS t FROM h)
SELECT s.series_id, 'true' AS kind, t AS cp FROM s WHERE t > 0 AND t % 97 = 0
UNION ALL SELECT s.series_id, 'pred' AS kind, t AS cp FROM s WHERE t > 0 AND (t + 4 * (t % 5)) % 89 = 7
UNION ALL SELECT series_id, 'true' AS kind, CAST(n AS BIGINT) AS cp FROM n UNION ALL SELECT series_id, 'pred' AS kind, CAST(n AS BIGINT) AS cp FROM n"""

# --- detectors ------------------------------------------------------------------------------------------------------

AMOC = """
p AS (SELECT series_id, t + 1 AS t, CAST(SUM(v) OVER w AS DOUBLE) AS s1, CAST(SUM(v * v) OVER w AS DOUBLE) AS s2, COUNT(*) OVER (PARTITION BY series_id) AS n,
             CAST(SUM(v) OVER (PARTITION BY series_id) AS DOUBLE) AS a1, CAST(SUM(v * v) OVER (PARTITION BY series_id) AS DOUBLE) AS a2
      FROM {series} WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT series_id, t, n, (s2 - s1 * s1 / t) + ((a2 - s2) - (a1 - s1) * (a1 - s1) / (n - t)) AS sse FROM p WHERE t >= 5 AND t <= n - 5),
r AS (SELECT series_id, t AS cp, n, ROUND(sse / 1e4, 2) AS sse, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY sse, t) AS k FROM c)
SELECT series_id, cp, n, sse FROM r WHERE k = 1"""

PREFIX = """
q AS (SELECT series_id, t, CAST(v AS BIGINT) AS v, COUNT(*) OVER (PARTITION BY series_id) AS n FROM {series}),
f AS (SELECT series_id, t + 1 AS t, n, CAST(SUM(v) OVER w AS DOUBLE) AS s1, CAST(SUM(v * v) OVER w AS DOUBLE) AS s2 FROM q
      WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      UNION ALL SELECT DISTINCT series_id, CAST(0 AS BIGINT) AS t, n, CAST(0 AS DOUBLE) AS s1, CAST(0 AS DOUBLE) AS s2 FROM q),
"""

#: All segments between points of a grid, with sums; the grid is a multiple of 60, and the end.
GRID = (
    PREFIX
    + """g AS (SELECT * FROM f WHERE t % 60 = 0 OR t = n),
seg AS (SELECT a.series_id, a.t AS s, b.t AS e, b.t - a.t AS m, b.s1 - a.s1 AS s1, b.s2 - a.s2 AS s2 FROM g a JOIN g b ON a.series_id = b.series_id AND a.t < b.t)"""
)
COST_L2 = GRID + "\nSELECT series_id, s, e, ROUND((s2 - s1 * s1 / m) / 1e6, 2) AS cost FROM seg"
COST_NORMAL = GRID + "\nSELECT series_id, s, e, ROUND(m * LN(GREATEST(s2 / m - (s1 / m) * (s1 / m), 0) + 1e-6), 3) AS cost FROM seg"
COST_L1 = (
    GRID
    + """,
x AS (SELECT seg.series_id, s, e, CAST(v AS DOUBLE) AS v FROM seg JOIN {series} r ON seg.series_id = r.series_id AND r.t >= s AND r.t < e),
mid AS (SELECT series_id, s, e, MEDIAN(v) AS mid FROM x GROUP BY series_id, s, e)
SELECT x.series_id, x.s, x.e, ROUND(SUM(ABS(v - mid)) / 100, 1) AS cost FROM x JOIN mid ON x.series_id = mid.series_id AND x.s = mid.s AND x.e = mid.e GROUP BY x.series_id, x.s, x.e"""
)
#: Channel a on channel n without intercept.
COST_LINEAR = """
q AS (SELECT t, CAST(a AS DOUBLE) AS y, CAST(n AS DOUBLE) AS x, COUNT(*) OVER () AS c FROM {wide}),
e AS (SELECT t AS p FROM q WHERE t % 12 = 0 UNION SELECT c AS p FROM q),
seg AS (SELECT a.p AS s, b.p AS e FROM e a JOIN e b ON a.p < b.p)
SELECT s, e, ROUND(SUM(y * y) - CASE WHEN SUM(x * x) > 0 THEN SUM(x * y) * SUM(x * y) / SUM(x * x) ELSE 0 END, 2) AS cost
FROM seg JOIN q ON q.t >= s AND q.t < e GROUP BY s, e"""
#: m - |sum of unit vectors|**2 / m; rows of norm 0 add nothing to either.
COST_COSINE = """
q AS (SELECT t, CAST(a AS DOUBLE) AS a, CAST(n AS DOUBLE) AS n, CAST(r AS DOUBLE) AS r, SQRT(CAST(a * a + n * n + r * r AS DOUBLE)) AS z, COUNT(*) OVER () AS c FROM {wide}),
u AS (SELECT t, CASE WHEN z > 0 THEN a / z ELSE 0 END AS a, CASE WHEN z > 0 THEN n / z ELSE 0 END AS n, CASE WHEN z > 0 THEN r / z ELSE 0 END AS r, CASE WHEN z > 0 THEN 1 ELSE 0 END AS k FROM q),
e AS (SELECT t AS p FROM q WHERE t % 12 = 0 UNION SELECT c AS p FROM q),
seg AS (SELECT a.p AS s, b.p AS e FROM e a JOIN e b ON a.p < b.p)
SELECT s, e, ROUND(SUM(k) - (SUM(a) * SUM(a) + SUM(n) * SUM(n) + SUM(r) * SUM(r)) / COUNT(*), 5) AS cost FROM seg JOIN u ON u.t >= s AND u.t < e GROUP BY s, e"""

#: The gain of a window of 100 at every fifth point, its strict maxima within 10 grid points, and of these the best three.
WINDOW_NCPS = (
    PREFIX
    + """c AS (SELECT m.series_id, m.t, (h.s2 - l.s2) - (h.s1 - l.s1) * (h.s1 - l.s1) / 100 - ((m.s2 - l.s2) - (m.s1 - l.s1) * (m.s1 - l.s1) / 50) - ((h.s2 - m.s2) - (h.s1 - m.s1) * (h.s1 - m.s1) / 50) AS gain
      FROM f m JOIN f l ON l.series_id = m.series_id AND l.t = m.t - 50 JOIN f h ON h.series_id = m.series_id AND h.t = m.t + 50 WHERE m.t % 5 = 0 AND m.t < m.n - 50),
k AS (SELECT series_id, t, gain, MAX(gain) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS b, MAX(gain) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS a FROM c),
r AS (SELECT series_id, t AS cp, ROUND(gain / 1e6, 2) AS gain, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY gain DESC, t DESC) AS k FROM k WHERE (b IS NULL OR gain > b) AND (a IS NULL OR gain > a))
SELECT series_id, cp, gain FROM r WHERE k <= 3"""
)


def split_round(min_size: int, jump: int) -> str:
    """Of all open segments of a series the split that gains most; of equals the first segment and its last point."""
    return f"""
u AS (SELECT z.series_id, z.s, z.e, l.s1 AS l1, l.s2 AS l2, r.s1 AS r1, r.s2 AS r2
      FROM {{open}} z JOIN {{sums}} l ON l.series_id = z.series_id AND l.t = z.s JOIN {{sums}} r ON r.series_id = z.series_id AND r.t = z.e),
y AS (SELECT u.series_id, u.s, u.e, b.t AS b, (r2 - l2) - (r1 - l1) * (r1 - l1) / (u.e - u.s) - ((b.s2 - l2) - (b.s1 - l1) * (b.s1 - l1) / (b.t - u.s)) - ((r2 - b.s2) - (r1 - b.s1) * (r1 - b.s1) / (u.e - b.t)) AS gain
      FROM u JOIN {{sums}} b ON b.series_id = u.series_id AND b.t >= u.s + {min_size} AND b.t <= u.e - {min_size} AND (b.t - u.s) % {jump} = 0),
w AS (SELECT series_id, s, e, b, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY gain DESC, s, b DESC) AS k FROM y)
SELECT series_id, s, e, b FROM w WHERE k = 1"""


def apply_round(i: int) -> str:
    return f"""
n AS (SELECT z.series_id, z.s, CASE WHEN x.b IS NULL THEN z.e ELSE x.b END AS e, z.k FROM {{open}} z LEFT JOIN {{best}} x ON x.series_id = z.series_id AND x.s = z.s
      UNION ALL SELECT series_id, b AS s, e, CAST({i} AS BIGINT) AS k FROM {{best}})
SELECT series_id, s, e, k FROM n"""


def binseg(k: int, min_size: int = 2, jump: int = 5) -> str:
    """The rounds in one text, for engines that keep the tables of a WITH that say so."""
    text = PREFIX.replace("f AS (", "f AS MATERIALIZED (") + "z0 AS (SELECT DISTINCT series_id, CAST(0 AS BIGINT) AS s, CAST(n AS BIGINT) AS e, CAST(0 AS BIGINT) AS k FROM q),\n"
    for i in range(k):
        names = lambda t: t.replace("{open}", f"z{i}").replace("{sums}", "f").replace("{best}", f"x{i}").replace("u AS (", "u AS MATERIALIZED (")  # noqa: B023, E731
        text += f"x{i} AS MATERIALIZED (WITH {names(split_round(min_size, jump)).strip()}),\nz{i + 1} AS MATERIALIZED (WITH {names(apply_round(i + 1)).strip()}){',' if i < k - 1 else ''}\n"
    return text + f"SELECT series_id, k, s AS cp FROM z{k} WHERE s > 0"


BINSEG_K3 = binseg(3)
#: The best two points of a grid of tens, by two (min, +) products.
DYNP_K2 = (
    PREFIX
    + """g AS (SELECT * FROM f WHERE t % 10 = 0 OR t = n),
seg AS (SELECT a.series_id, a.t AS s, b.t AS e, b.n, (b.s2 - a.s2) - (b.s1 - a.s1) * (b.s1 - a.s1) / (b.t - a.t) AS cost FROM g a JOIN g b ON a.series_id = b.series_id AND b.t - a.t >= 2),
one AS (SELECT x.series_id, y.e, x.e AS b1, x.cost + y.cost AS cost, ROW_NUMBER() OVER (PARTITION BY x.series_id, y.e ORDER BY x.cost + y.cost, x.e) AS k FROM seg x JOIN seg y ON x.series_id = y.series_id AND x.s = 0 AND x.e = y.s),
two AS (SELECT x.series_id, b1, x.e AS b2, x.cost + y.cost AS cost, ROW_NUMBER() OVER (PARTITION BY x.series_id ORDER BY x.cost + y.cost, x.e) AS k FROM one x JOIN seg y ON x.series_id = y.series_id AND x.e = y.s AND y.e = y.n WHERE k = 1)
SELECT series_id, b1 AS cp1, b2 AS cp2, ROUND(cost / 1e6, 2) AS cost FROM two WHERE k = 1"""
)
#: One step of a Gaussian split in one dimension: m * ln(var + 1/m) - 1 / (var + 1/m), in units of 1000.
GGS_STEP = (
    PREFIX
    + """o AS (SELECT f.series_id, f.t, f.n, f.s1 / 1e3 AS l1, f.s2 / 1e6 AS l2, e.s1 / 1e3 - f.s1 / 1e3 AS r1, e.s2 / 1e6 - f.s2 / 1e6 AS r2 FROM f JOIN f e ON e.series_id = f.series_id AND e.t = e.n WHERE f.t > 0 AND f.t < f.n),
v AS (SELECT series_id, t, CAST(t AS DOUBLE) AS a, CAST(n - t AS DOUBLE) AS b, GREATEST(l2 / t - (l1 / t) * (l1 / t), 0) + 1.0 / t AS va, GREATEST(r2 / (n - t) - (r1 / (n - t)) * (r1 / (n - t)), 0) + 1.0 / (n - t) AS vb FROM o),
c AS (SELECT series_id, t, ROUND(a * LN(va) - 1 / va + b * LN(vb) - 1 / vb, 6) AS cost FROM v),
r AS (SELECT series_id, t AS cp, cost, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY cost, t) AS k FROM c)
SELECT series_id, cp, ROUND(cost, 3) AS cost FROM r WHERE k = 1"""
)
PROPHET_GRID = """
n AS (SELECT series_id, COUNT(*) AS n FROM {series} GROUP BY series_id)
SELECT DISTINCT n.series_id, CAST(FLOOR((n - 1) * s.t / 5.0 + 0.5) AS BIGINT) AS cp FROM n JOIN {series} s ON s.series_id = n.series_id WHERE s.t BETWEEN 1 AND 5"""

# --- neighbours -----------------------------------------------------------------------------------------------------

#: z-normalised distances of all pairs of windows of 24 whose starts are over 12 apart; dot products run along the diagonals. The bound
#: a.t >= 0 says nothing, but without it one engine loses the pairs of the first window.
PAIRS = """
q AS (SELECT series_id, t, CAST(v AS DOUBLE) / 100 AS x FROM {series}),
st AS (SELECT series_id, t, AVG(x) OVER w AS mu, CASE WHEN SQRT(GREATEST(AVG(x * x) OVER w - (AVG(x) OVER w) * (AVG(x) OVER w), 0)) < 1e-3 THEN 1 ELSE SQRT(GREATEST(AVG(x * x) OVER w - (AVG(x) OVER w) * (AVG(x) OVER w), 0)) END AS sd, COUNT(*) OVER w AS c FROM q
       WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)),
d AS (SELECT a.series_id, a.t AS i, b.t AS j, SUM(a.x * b.x) OVER (PARTITION BY a.series_id, b.t - a.t ORDER BY a.t ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS dot FROM q a JOIN q b ON a.series_id = b.series_id AND b.t > a.t + 12 AND a.t >= 0),
r0 AS (SELECT d.series_id, i, j, GREATEST(2 * 24 * (1 - (dot - 24 * x.mu * y.mu) / (24 * x.sd * y.sd)), 0) AS raw FROM d JOIN st x ON x.series_id = d.series_id AND x.t = i AND x.c = 24 JOIN st y ON y.series_id = d.series_id AND y.t = j AND y.c = 24),
p AS (SELECT series_id, i, j, raw, ROUND(raw, 6) AS dist FROM r0),
both_ways AS (SELECT series_id, i, j, raw, dist FROM p UNION ALL SELECT series_id, j AS i, i AS j, raw, dist FROM p)"""
KNN = PAIRS + "\nSELECT series_id, i, rank, j, ROUND(raw, 4) AS dist FROM (SELECT series_id, i, j, raw, CAST(ROW_NUMBER() OVER (PARTITION BY series_id, i ORDER BY dist, j) AS BIGINT) AS rank FROM both_ways) x WHERE rank <= 3"
PROFILE = PAIRS + "\nSELECT series_id, i AS t, j, ROUND(SQRT(dist), 4) AS score FROM (SELECT series_id, i, j, dist, ROW_NUMBER() OVER (PARTITION BY series_id, i ORDER BY dist, j) AS rank FROM both_ways) x WHERE rank = 1"
FLUSS = (
    PAIRS
    + """,
nn AS (SELECT series_id, i, j FROM (SELECT series_id, i, j, ROW_NUMBER() OVER (PARTITION BY series_id, i ORDER BY dist, j) AS rank FROM both_ways) x WHERE rank = 1),
ev AS (SELECT series_id, LEAST(i, j) AS t, 1 AS d FROM nn UNION ALL SELECT series_id, GREATEST(i, j) AS t, -1 AS d FROM nn UNION ALL SELECT series_id, i AS t, 0 AS d FROM nn),
su AS (SELECT series_id, t, SUM(d) AS d FROM ev GROUP BY series_id, t),
ac AS (SELECT series_id, t, SUM(d) OVER (PARTITION BY series_id ORDER BY t) AS ac, COUNT(*) OVER (PARTITION BY series_id) AS n FROM su)
SELECT series_id, t, ROUND(CASE WHEN t < 24 OR t >= n - 24 THEN CAST(1 AS DOUBLE) ELSE LEAST(CAST(ac AS DOUBLE) * n / (2 * t * (n - t)), CAST(1 AS DOUBLE)) END, 5) AS score FROM ac"""
)
#: Scores of all splits from the neighbours: m is the second largest of three, so a window votes right of s if m >= s.
CLASP_PROFILE = (
    PAIRS
    + """,
kn AS (SELECT series_id, i, j FROM (SELECT series_id, i, j, ROW_NUMBER() OVER (PARTITION BY series_id, i ORDER BY dist, j) AS rank FROM both_ways) x WHERE rank <= 3),
mj AS (SELECT series_id, i, j AS m FROM (SELECT series_id, i, j, ROW_NUMBER() OVER (PARTITION BY series_id, i ORDER BY j DESC) AS k FROM kn) x WHERE k = 2),
n AS (SELECT series_id, COUNT(*) AS n FROM mj GROUP BY series_id),
s AS (SELECT mj.series_id, i AS s, n.n FROM mj JOIN n ON n.series_id = mj.series_id WHERE i >= 48 AND i < n.n - 24),
c AS (SELECT s.series_id, s.s, s.n, SUM(CASE WHEN i >= s.s AND m >= s.s THEN 1 ELSE 0 END) AS right_ones,
             SUM(CASE WHEN m >= s.s OR (i < s.s AND i >= s.s - 24) THEN 1 ELSE 0 END) AS all_ones FROM s JOIN mj ON mj.series_id = s.series_id GROUP BY s.series_id, s.s, s.n)
SELECT series_id, s AS t, ROUND((1 + CAST(right_ones AS DOUBLE) / all_ones - CAST(n - s - right_ones AS DOUBLE) / (n - all_ones)) / 2, 6) AS score FROM c WHERE all_ones > 0 AND all_ones < n"""
)
ACF = """
q AS (SELECT series_id, t, CAST(v AS DOUBLE) - AVG(CAST(v AS DOUBLE)) OVER (PARTITION BY series_id) AS y FROM {series}),
z AS (SELECT series_id, SUM(y * y) AS z FROM q GROUP BY series_id),
c AS (SELECT a.series_id, b.t - a.t AS lag, SUM(a.y * b.y) AS c FROM q a JOIN q b ON a.series_id = b.series_id AND b.t - a.t BETWEEN 9 AND 999 GROUP BY a.series_id, b.t - a.t),
p AS (SELECT c.series_id, lag, c / z AS acf, LAG(c / z) OVER (PARTITION BY c.series_id ORDER BY lag) AS a, LEAD(c / z) OVER (PARTITION BY c.series_id ORDER BY lag) AS b FROM c JOIN z ON z.series_id = c.series_id),
r AS (SELECT series_id, lag, acf, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY acf DESC, lag) AS k FROM p WHERE acf > a AND acf > b)
SELECT series_id, lag AS width, ROUND(acf, 5) AS acf FROM r WHERE k = 1"""
DFT = """
q AS (SELECT series_id, t, CAST(v AS DOUBLE) / 100 - AVG(CAST(v AS DOUBLE) / 100) OVER (PARTITION BY series_id) AS y, COUNT(*) OVER (PARTITION BY series_id) AS n FROM {series}),
k AS (SELECT series_id, t AS k, n FROM q WHERE t > 0 AND t <= n / 2.0 AND n * 1.0 / t >= 10 AND n * 1.0 / t < 1000),
c AS (SELECT k.series_id, k, k.n, SUM(y * COS(2 * PI() * k * q.t / k.n)) AS a, SUM(y * SIN(2 * PI() * k * q.t / k.n)) AS b FROM k JOIN q ON q.series_id = k.series_id GROUP BY k.series_id, k, k.n),
r AS (SELECT series_id, k, n, SQRT(a * a + b * b) AS power, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY SQRT(a * a + b * b) DESC, k) AS o FROM c)
SELECT series_id, k, CAST(FLOOR(n * 1.0 / k) AS BIGINT) AS width, ROUND(power, 2) AS power FROM r WHERE o = 1"""
#: Mean distance of windows of 32 from the whole in mean, deviation and range, on values scaled to [0, 1].
SUSS = """
q AS (SELECT series_id, t, CAST(v - MIN(v) OVER (PARTITION BY series_id) AS DOUBLE) / (MAX(v) OVER (PARTITION BY series_id) - MIN(v) OVER (PARTITION BY series_id)) AS x FROM {series}),
a AS (SELECT series_id, AVG(x) AS m, STDDEV_POP(x) AS s, MAX(x) - MIN(x) AS r FROM q GROUP BY series_id),
w AS (SELECT series_id, t, AVG(x) OVER w AS m, STDDEV_POP(x) OVER w AS s, MAX(x) OVER w - MIN(x) OVER w AS r, COUNT(*) OVER w AS c FROM q WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 31 PRECEDING AND CURRENT ROW))
SELECT w.series_id, ROUND(AVG(SQRT((w.m - a.m) * (w.m - a.m) + (w.s - a.s) * (w.s - a.s) + (w.r - a.r) * (w.r - a.r)) / SQRT(32)), 6) AS score FROM w JOIN a ON a.series_id = w.series_id WHERE t >= 32 GROUP BY w.series_id"""

# --- converters -----------------------------------------------------------------------------------------------------

EXTRACT_CPS = """
l AS (SELECT series_id, t, y_true, LAG(y_true) OVER (PARTITION BY series_id ORDER BY t) AS p FROM {labels})
SELECT series_id, t AS cp FROM l WHERE p IS NOT NULL AND p <> y_true"""
LABELS_TO_CPS = """
l AS (SELECT series_id, t, y_true, LAG(y_true) OVER (PARTITION BY series_id ORDER BY t) AS p FROM {labels})
SELECT series_id, t AS cp FROM l WHERE p IS NULL OR p <> y_true UNION ALL SELECT series_id, MAX(t) + 1 AS cp FROM {labels} GROUP BY series_id"""
CPS_TO_LABELS = """
c AS (SELECT DISTINCT series_id, cp FROM {cps} WHERE kind = 'pred')
SELECT l.series_id, l.t, CAST(SUM(CASE WHEN c.cp IS NOT NULL AND l.t > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l.series_id ORDER BY l.t) AS BIGINT) AS state
FROM {labels} l LEFT JOIN c ON c.series_id = l.series_id AND c.cp = l.t"""
COLLAPSE = """
l AS (SELECT series_id, t, y_pred, CASE WHEN LAG(y_pred) OVER (PARTITION BY series_id ORDER BY t) = y_pred THEN 0 ELSE 1 END AS f FROM {labels}),
r AS (SELECT series_id, t, y_pred, SUM(f) OVER (PARTITION BY series_id ORDER BY t) AS r FROM l)
SELECT series_id, MIN(t) AS start_t, MAX(t) + 1 AS end_t, MIN(y_pred) AS state FROM r GROUP BY series_id, r"""
REORDER = """
f AS (SELECT series_id, y_pred, MIN(t) AS f FROM {labels} GROUP BY series_id, y_pred),
k AS (SELECT series_id, y_pred, CAST(DENSE_RANK() OVER (PARTITION BY series_id ORDER BY f) - 1 AS BIGINT) AS state FROM f)
SELECT l.series_id, l.t, k.state FROM {labels} l JOIN k ON k.series_id = l.series_id AND k.y_pred = l.y_pred"""
#: Chains of points at most 10 apart, the five largest, at their medians.
AGGREGATE = """
c AS (SELECT series_id, cp, CASE WHEN cp - LAG(cp) OVER (PARTITION BY series_id ORDER BY cp, kind) <= 10 THEN 0 ELSE 1 END AS f, kind FROM {cps}),
g AS (SELECT series_id, cp, SUM(f) OVER (PARTITION BY series_id ORDER BY cp, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM c),
m AS (SELECT series_id, g, COUNT(*) AS size, CAST(FLOOR(MEDIAN(CAST(cp AS DOUBLE))) AS BIGINT) AS cp FROM g GROUP BY series_id, g),
r AS (SELECT series_id, cp, size, ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY size DESC, g) AS k FROM m)
SELECT series_id, cp, size FROM r WHERE k <= 5"""
L2_NORM = "one AS (SELECT t, a, n, r FROM {wide})\nSELECT t, ROUND(SQRT(CAST(a * a + n * n + r * r AS DOUBLE)), 4) AS norm FROM one"
#: The label most windows of 24, each 12 after the last, give a point; the smallest of equals.
VOTE = """
w AS (SELECT series_id, t AS s, y_pred AS label FROM {labels} WHERE t % 12 = 0),
v AS (SELECT l.series_id, l.t, w.label, COUNT(*) AS c FROM {labels} l JOIN w ON w.series_id = l.series_id AND l.t >= w.s AND l.t < w.s + 24 GROUP BY l.series_id, l.t, w.label),
r AS (SELECT series_id, t, label, ROW_NUMBER() OVER (PARTITION BY series_id, t ORDER BY c DESC, label) AS k FROM v)
SELECT series_id, t, label AS state FROM r WHERE k = 1"""

# --- metrics --------------------------------------------------------------------------------------------------------

SEGMENTS = """
k AS (SELECT series_id, MAX(cp) AS n FROM {cps} GROUP BY series_id),
x AS (SELECT k.series_id, v.kind, CASE WHEN v.w = 0 THEN 0 ELSE k.n END AS cp FROM k CROSS JOIN (VALUES ('true', 0), ('pred', 0), ('true', 1), ('pred', 1)) AS v(kind, w)),
b AS (SELECT series_id, kind, cp FROM {cps} UNION SELECT series_id, kind, cp FROM x),
s AS (SELECT series_id, kind, cp AS s, LEAD(cp) OVER (PARTITION BY series_id, kind ORDER BY cp) AS e FROM b),
o AS (SELECT g.series_id, g.s AS gs, g.e AS ge, p.s AS ps, p.e AS pe, CAST(LEAST(g.e, p.e) - GREATEST(g.s, p.s) AS DOUBLE) / (GREATEST(g.e, p.e) - LEAST(g.s, p.s)) AS iou
      FROM s g JOIN s p ON g.series_id = p.series_id AND g.kind = 'true' AND p.kind = 'pred' AND g.s < p.e AND p.s < g.e WHERE g.e IS NOT NULL AND p.e IS NOT NULL),
gt AS (SELECT series_id, SUM((ge - gs) * m) / SUM(ge - gs) AS c FROM (SELECT series_id, gs, ge, MAX(iou) AS m FROM o GROUP BY series_id, gs, ge) x GROUP BY series_id),
pr AS (SELECT series_id, SUM((pe - ps) * m) / SUM(pe - ps) AS c FROM (SELECT series_id, ps, pe, MAX(iou) AS m FROM o GROUP BY series_id, ps, pe) x GROUP BY series_id)"""
COVERING = SEGMENTS + "\nSELECT series_id, ROUND(c, 8) AS score FROM gt"
BICOVERING = SEGMENTS + "\nSELECT gt.series_id, ROUND(gt.c, 8) AS gt_covering, ROUND(pr.c, 8) AS pred_covering, ROUND(CASE WHEN gt.c + pr.c > 0 THEN 2 * gt.c * pr.c / (gt.c + pr.c) ELSE 0 END, 8) AS score FROM gt JOIN pr ON gt.series_id = pr.series_id"
HAUSDORFF = """
d AS (SELECT a.series_id, a.cp AS x, b.cp AS y, ABS(a.cp - b.cp) AS d FROM {cps} a JOIN {cps} b ON a.series_id = b.series_id AND a.kind = 'true' AND b.kind = 'pred'),
m AS (SELECT series_id, MAX(d) AS d FROM (SELECT series_id, x, MIN(d) AS d FROM d GROUP BY series_id, x) u GROUP BY series_id),
o AS (SELECT series_id, MAX(d) AS d FROM (SELECT series_id, y, MIN(d) AS d FROM d GROUP BY series_id, y) u GROUP BY series_id),
i AS (SELECT DISTINCT series_id FROM {cps})
SELECT i.series_id, CASE WHEN m.d IS NULL OR o.d IS NULL THEN CAST('Infinity' AS DOUBLE) ELSE CAST(GREATEST(m.d, o.d) AS DOUBLE) END AS score FROM i LEFT JOIN m ON m.series_id = i.series_id LEFT JOIN o ON o.series_id = i.series_id"""

WEIGHTS = """
c AS (SELECT series_id, t, y_true, CASE WHEN y_true <> LAG(y_true) OVER (PARTITION BY series_id ORDER BY t) THEN t END AS b, COUNT(*) OVER (PARTITION BY series_id) AS n, y_pred FROM {labels}),
d AS (SELECT series_id, t, y_true, y_pred, n, COUNT(b) OVER (PARTITION BY series_id) AS changes, t - COALESCE(MAX(b) OVER (PARTITION BY series_id ORDER BY t), 0) AS before,
             COALESCE(MIN(b) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) - t AS after FROM c),
l AS (SELECT series_id, y_true, y_pred, 1 + 0.1 * CAST(CASE WHEN changes = 0 THEN n ELSE LEAST(before, after) END AS DOUBLE) AS w FROM d)"""
ONES = "\nl AS (SELECT series_id, y_true, y_pred, CAST(1 AS DOUBLE) AS w FROM {labels})"
TABLE = """,
x AS (SELECT series_id, y_true, y_pred, SUM(w) AS w FROM l GROUP BY series_id, y_true, y_pred),
a AS (SELECT series_id, y_true, SUM(w) AS w FROM x GROUP BY series_id, y_true),
p AS (SELECT series_id, y_pred, SUM(w) AS w FROM x GROUP BY series_id, y_pred),
n AS (SELECT series_id, SUM(w) AS w FROM a GROUP BY series_id)"""


def _rand(cut: str) -> str:
    return (
        TABLE
        + f""",
q AS (SELECT x.series_id, SUM(x.w * x.w) AS sq, SUM(x.w * p.w) AS xp, SUM(x.w * a.w) AS xa FROM x JOIN a ON a.series_id = x.series_id AND a.y_true = x.y_true JOIN p ON p.series_id = x.series_id AND p.y_pred = x.y_pred GROUP BY x.series_id),
c2 AS (SELECT q.series_id, {cut.format("sq - n.w")} AS tp, {cut.format("xp - sq")} AS fp, {cut.format("xa - sq")} AS fn, {cut.format("n.w * n.w - (xp - sq) - (xa - sq) - sq")} AS tn FROM q JOIN n ON n.series_id = q.series_id)
SELECT series_id, ROUND(CASE WHEN fp = 0 AND fn = 0 THEN 1 WHEN (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn) = 0 THEN 1 ELSE 2 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END, 8) AS score FROM c2"""
    )


INFORMATION = """,
mi AS (SELECT x.series_id, SUM(x.w / n.w * LN(x.w * n.w / (a.w * p.w))) AS mi FROM x JOIN a ON a.series_id = x.series_id AND a.y_true = x.y_true JOIN p ON p.series_id = x.series_id AND p.y_pred = x.y_pred JOIN n ON n.series_id = x.series_id GROUP BY x.series_id),
ha AS (SELECT a.series_id, -SUM(a.w / n.w * LN(a.w / n.w)) AS h, COUNT(*) AS k FROM a JOIN n ON n.series_id = a.series_id GROUP BY a.series_id),
hp AS (SELECT p.series_id, -SUM(p.w / n.w * LN(p.w / n.w)) AS h, COUNT(*) AS k FROM p JOIN n ON n.series_id = p.series_id GROUP BY p.series_id)"""
_NORMALIZED = "\nSELECT mi.series_id, ROUND(CASE WHEN ha.k = 1 AND hp.k = 1 THEN 1 WHEN ABS(mi) < 1e-15 OR ha.h + hp.h = 0 THEN 0 ELSE mi / ((ha.h + hp.h) / 2) END, 8) AS score FROM mi JOIN ha ON ha.series_id = mi.series_id JOIN hp ON hp.series_id = mi.series_id"
ARI = ONES + _rand("{0}")
WARI = WEIGHTS + _rand("CAST(CASE WHEN {0} < 0 THEN CEIL({0}) ELSE FLOOR({0}) END AS DOUBLE)")
NMI = ONES + TABLE + INFORMATION + _NORMALIZED
WNMI = WEIGHTS + TABLE + INFORMATION + _NORMALIZED
#: The expected information of random tables with the same margins is summed over all counts a cell can have; lf is ln(k!).
AMI = (
    ONES
    + TABLE
    + INFORMATION
    + """,
z AS (SELECT series_id, CAST(ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY y_true, y_pred) AS BIGINT) AS k FROM l),
lf AS (SELECT series_id, k, SUM(LN(CAST(k AS DOUBLE))) OVER (PARTITION BY series_id ORDER BY k) AS v FROM z UNION ALL SELECT DISTINCT series_id, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS v FROM z),
mg AS (SELECT a.series_id, CAST(a.w AS BIGINT) AS a, CAST(p.w AS BIGINT) AS b, CAST(n.w AS BIGINT) AS n FROM a JOIN p ON p.series_id = a.series_id JOIN n ON n.series_id = a.series_id),
em AS (SELECT mg.series_id, SUM(c.k * 1.0 / n * LN(n * 1.0 * c.k / (CAST(a AS DOUBLE) * b)) * EXP(fa.v + fb.v + fna.v + fnb.v - fn.v - c.v - fac.v - fbc.v - fr.v)) AS emi
       FROM mg JOIN lf c ON c.series_id = mg.series_id AND c.k >= 1 AND c.k >= a + b - n AND c.k <= a AND c.k <= b
       JOIN lf fa ON fa.series_id = mg.series_id AND fa.k = a JOIN lf fb ON fb.series_id = mg.series_id AND fb.k = b JOIN lf fna ON fna.series_id = mg.series_id AND fna.k = n - a JOIN lf fnb ON fnb.series_id = mg.series_id AND fnb.k = n - b
       JOIN lf fn ON fn.series_id = mg.series_id AND fn.k = n JOIN lf fac ON fac.series_id = mg.series_id AND fac.k = a - c.k JOIN lf fbc ON fbc.series_id = mg.series_id AND fbc.k = b - c.k JOIN lf fr ON fr.series_id = mg.series_id AND fr.k = n - a - b + c.k GROUP BY mg.series_id)
SELECT mi.series_id, ROUND(CASE WHEN ha.k = 1 AND hp.k = 1 THEN 1 WHEN ABS((ha.h + hp.h) / 2 - emi) < 1e-15 THEN 0 ELSE (mi - emi) / ((ha.h + hp.h) / 2 - emi) END, 7) AS score FROM mi JOIN ha ON ha.series_id = mi.series_id JOIN hp ON hp.series_id = mi.series_id JOIN em ON em.series_id = mi.series_id"""
)
#: Exact only where true points lie over two margins apart, as in the labels here; the operator matches greedily in any case.
F1_WIDE = """
n AS (SELECT series_id, MAX(cp) AS n FROM {cps} WHERE kind = 'true' GROUP BY series_id),
g AS (SELECT c.series_id, cp, CAST(FLOOR(0.01 * n) AS BIGINT) AS m FROM {cps} c JOIN n ON n.series_id = c.series_id WHERE kind = 'true' AND cp > 0 AND cp < n),
p AS (SELECT c.series_id, cp FROM {cps} c JOIN n ON n.series_id = c.series_id WHERE kind = 'pred' AND cp > 0 AND cp <> n),
h AS (SELECT g.series_id, COUNT(DISTINCT g.cp) AS tp FROM g JOIN p ON p.series_id = g.series_id AND ABS(p.cp - g.cp) <= m GROUP BY g.series_id),
k AS (SELECT n.series_id, COALESCE(MAX(tp), 0) AS tp, (SELECT COUNT(*) FROM g WHERE g.series_id = n.series_id) AS ng, (SELECT COUNT(*) FROM p WHERE p.series_id = n.series_id) AS np FROM n LEFT JOIN h ON h.series_id = n.series_id GROUP BY n.series_id)
SELECT series_id, ROUND(CASE WHEN np > 0 THEN tp * 1.0 / np ELSE 0 END, 8) AS precision, ROUND(CASE WHEN ng > 0 THEN tp * 1.0 / ng ELSE 0 END, 8) AS recall,
       ROUND(CASE WHEN ng = 0 AND np = 0 THEN 1 WHEN ng = 0 OR np = 0 OR tp = 0 THEN 0 ELSE 2.0 * tp / (ng + np) END, 8) AS score FROM k"""
