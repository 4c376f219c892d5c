"""DuckDB SQL for the queries of the catalogue, written independently of the DataFrame code: lists and self-joins
where that uses arrays and windows, recursion where that folds."""

from __future__ import annotations

from ..functions.columns import AS241_A, AS241_B, AS241_C, AS241_D, AS241_E, AS241_F
from ..operators.taxonomy import MODES
from .rules import LAUNCHES

SQL: dict[str, str] = {}
N = 30


def panel(step: str = "month", key: str = "l_suppkey", assets: str = "SELECT s_suppkey AS asset, s_nationkey AS grp, s_acctbal AS size FROM supplier") -> str:
    return f"""
a0 AS ({assets}),
c0 AS (SELECT {key} AS asset, CAST(date_trunc('{step}', l_shipdate) AS DATE) AS date, sum(l_extendedprice * (1 - l_discount)) AS dollar_volume, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2),
d0 AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT date FROM c0)),
g0 AS (SELECT d0.t, d0.date, a0.*, c0.dollar_volume, c0.dollar_volume / c0.quantity AS px FROM d0 CROSS JOIN a0 LEFT JOIN c0 ON c0.date = d0.date AND c0.asset = a0.asset),
r0 AS (SELECT *, 0.1 * (px - lag(px) OVER w) / (px + lag(px) OVER w) AS ret FROM g0 WINDOW w AS (PARTITION BY asset ORDER BY t)),
p AS (SELECT *, -ret AS signal, abs(ret) AS vol, dollar_volume IS NOT NULL AS mask FROM r0)"""


def fwd(h: int, delay: int = 0) -> str:
    w = f"(PARTITION BY asset ORDER BY t ROWS BETWEEN {1 + delay} FOLLOWING AND {delay + h} FOLLOWING)"
    return f"CASE WHEN count(ret) OVER {w} = {h} THEN exp(sum(ln(1 + ret)) OVER {w}) - 1 END"


def labelled(h: int = 1, step: str = "month") -> str:
    return f"{panel(step)},\nf AS (SELECT *, {fwd(h)} AS fwd FROM p)"


def ic(name: str, source: str, signal: str = "signal", label: str = "fwd", mask: str = "mask", min_n: int = N, by: str = "0") -> str:
    """CTEs that end in name(k, t, n, ic)."""
    return f"""
{name}_a AS (SELECT {by} AS k, t, {signal} AS s, {label} AS f, count(*) OVER (PARTITION BY {by}, t) AS n FROM {source} WHERE {signal} IS NOT NULL AND {label} IS NOT NULL AND {mask}),
{name}_b AS (SELECT k, t, n, rank() OVER (PARTITION BY k, t ORDER BY s) + (count(*) OVER (PARTITION BY k, t, s) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY k, t ORDER BY f) + (count(*) OVER (PARTITION BY k, t, f) - 1) / 2.0 AS rf FROM {name}_a WHERE n >= {min_n}),
{name} AS (SELECT k, t, any_value(n) AS n, covar_pop(rs, rf) / nullif(stddev_pop(rs) * stddev_pop(rf), 0) AS ic FROM {name}_b GROUP BY k, t)"""


def summary(name: str, source: str, h: int = 1, value: str = "ic") -> str:
    """CTEs that end in name: n, mean, std, spacing, overlap, lags, var of source(t, value)."""
    return f"""
{name}_x AS (SELECT t, {value} AS v, row_number() OVER (ORDER BY t) AS i, {value} - avg({value}) OVER () AS e, t - lag(t) OVER (ORDER BY t) AS gap FROM {source} WHERE {value} IS NOT NULL),
{name}_g AS (SELECT count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std, greatest(coalesce(median(gap), 1), 1) AS spacing, sum(e * e) / count(*) AS c0 FROM {name}_x),
{name}_h AS (SELECT *, greatest(1, {h} / spacing) AS overlap FROM {name}_g),
{name}_l AS (SELECT *, CAST(greatest(0, least(CASE WHEN ceil(overlap) - 1 > 0 THEN ceil(overlap) - 1 ELSE floor(4 * pow(n / 100.0, 2.0 / 9)) END, n - 2)) AS INTEGER) AS lags FROM {name}_h),
{name}_c AS (SELECT b.i - a.i AS l, sum(a.e * b.e) AS c FROM {name}_x a JOIN {name}_x b ON b.i > a.i AND b.i - a.i <= (SELECT lags FROM {name}_l) GROUP BY 1),
{name} AS (SELECT *, c0 + coalesce((SELECT sum(2 * (1 - l / (lags + 1.0)) * c / n) FROM {name}_c), 0) AS var FROM {name}_l)"""


T_NW = "CASE WHEN n >= 10 AND var > 0 THEN mean / sqrt(var / n) END"


def r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def add(name: str, ctes: str, select: str, recursive: bool = False) -> None:
    SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}" if ctes else select


add("forward_returns_h1", labelled(1), f"SELECT t, asset, {r('fwd', 'fwd')} FROM f")
add("forward_returns_h5_delay1", panel(), f"SELECT t, asset, {r(fwd(5, 1), 'fwd')} FROM p")
add("default_control", panel(), f"SELECT t, asset, {r('CASE WHEN t >= 4 THEN -sum(coalesce(ret, 0)) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END', 'control')} FROM p")
add("rank_ic_daily", labelled() + "," + ic("i", "f"), f"SELECT t, n, {r('ic', 'ic')} FROM i")
add("rank_ic_wide", panel("quarter", "l_partkey", "SELECT p_partkey AS asset, p_size AS grp, p_retailprice AS size FROM part") + f", f AS (SELECT *, {fwd(1)} AS fwd FROM p)," + ic("i", "f"), f"SELECT t, n, {r('ic', 'ic')} FROM i")
add("rank_ic_summary", labelled() + "," + ic("i", "f") + "," + summary("s", "i"), f"SELECT n, {r('mean', 'mean')}, {r('std', 'std')}, {r('mean / nullif(std, 0) * sqrt(12 / greatest(spacing, 1))', 'icir')}, {r(T_NW, 't_nw')}, {r('n / overlap', 'n_eff')}, {r('spacing', 'spacing')} FROM s")
add("newey_west_t", labelled(3) + "," + ic("i", "f") + "," + summary("s", "i", 3), f"SELECT n, {r('mean', 'mean')}, {r(T_NW, 't_nw')} FROM s")
add("ic_sampling", labelled(5) + "," + ic("i", "f") + "," + summary("s", "i", 5), f"SELECT n, {r('spacing', 'spacing')}, {r('overlap', 'overlap')}, {r('n / overlap', 'n_eff')}, CAST(ceil(overlap) - 1 AS BIGINT) AS lags, {r('greatest(spacing, 5)', 'period')} FROM s")
add(
    "label_persistence",
    labelled(5, "week") + ", q AS (SELECT a.t, a.asset, a.fwd AS x, b.fwd AS y, a.mask AND b.mask AS ok FROM f a JOIN f b ON b.asset = a.asset AND b.t = a.t + 1)," + ic("i", "q", "x", "y", "ok", 10),
    f"SELECT count(ic) AS n, {r('median(ic)', 'persistence')} FROM i",
)
add("common_variance_share", labelled(1, "week") + ", q AS (SELECT t, avg(fwd) AS m, avg(fwd * fwd) AS m2, count(*) AS n FROM f WHERE mask AND fwd IS NOT NULL GROUP BY t)", f"SELECT count(*) AS n, {r('median(m * m / m2)', 'common')} FROM q WHERE n >= 20 AND m2 > 0")
for parts, name in ((2, "stationarity_halves"), (4, "stationarity_quarters")):
    add(name, labelled() + "," + ic("i", "f") + f", h AS (SELECT ic, CAST(ntile({parts}) OVER (ORDER BY t) AS INTEGER) AS part FROM i WHERE ic IS NOT NULL)", f"SELECT part, count(*) AS n, {r('avg(ic)', 'mean')}, {r('stddev_samp(ic) / sqrt(count(*))', 'se')} FROM h GROUP BY part")
add(
    "frequency_transfer",
    panel("week") + ", q AS (" + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS stride, * FROM (SELECT *, {fwd(k)} AS fwd FROM p) WHERE t % {k} = 0" for k in (1, 2, 4)) + ")," + ic("i", "q", min_n=10, by="stride") + ", g AS (SELECT k AS stride, count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) / sqrt(count(ic)) AS se FROM i WHERE ic IS NOT NULL GROUP BY k)",
    f"SELECT stride, n, {r('CASE WHEN n >= 8 THEN mean END', 'mean')}, {r('CASE WHEN n >= 8 THEN mean / se END', 't')} FROM g",
)
add("label_delay_decay", panel() + ", q AS (" + " UNION ALL ".join(f"SELECT CAST({d} AS INTEGER) AS delay, *, {fwd(3, d)} AS fwd FROM p" for d in range(4)) + ")," + ic("i", "q", by="delay"), f"SELECT k AS delay, count(ic) AS n, {r('avg(ic)', 'mean_ic')} FROM i GROUP BY k")


def shifts(signal: str) -> str:
    one = lambda k: f"SELECT CAST({k} AS INTEGER) AS shift, a.t, a.asset, a.mask, a.fwd, b.{signal} AS x FROM f a JOIN f b ON b.asset = a.asset AND b.t = a.t + {k}"
    return labelled() + ", q AS (" + " UNION ALL ".join(one(k) for k in range(-4, 2)) + ")," + ic("i", "q", "x", by="shift") + ", g AS (SELECT k AS shift, count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) / sqrt(count(ic)) AS se FROM i GROUP BY k)"


for signal, name in (("signal", "feature_shift_profile"), ("vol", "control_integrity_profile")):
    add(name, shifts(signal), f"SELECT shift, n, {r('mean', 'mean')}, {r('se', 'se')} FROM g")
add("shift_power_profile", shifts("signal") + ", s AS (SELECT max(abs(b.mean) - abs(a.mean)) AS step, 5 * sqrt(2) * (SELECT se FROM g WHERE shift = 0) AS floor FROM g a JOIN g b ON b.shift = a.shift + 1)", f"SELECT {r('step', 'largest_step')}, {r('floor', 'floor')}, {r('step / floor', 'ratio')} FROM s")
add("naive_paired_diff", labelled() + "," + ic("i", "f") + "," + ic("j", "f", "vol") + ", q AS (SELECT i.t, i.ic - j.ic AS ic FROM i JOIN j ON i.t = j.t)," + summary("s", "q"), f"SELECT n, {r('mean', 'mean')}, {r(T_NW, 't_nw')} FROM s")


def long(columns: list[str], source: str = "p") -> str:
    return "u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS input, t, asset, CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns) + ")"


add(
    "input_staleness_runs",
    panel() + "," + long(["signal", "ret", "vol", "size"]) + """,
l AS (SELECT b.input, b.t, count(*) FILTER (a.value IS NOT NULL OR b.value IS NOT NULL) AS live, count(*) FILTER (a.value = b.value) AS same FROM u a JOIN u b ON a.input = b.input AND a.asset = b.asset AND b.t = a.t + 1 GROUP BY 1, 2),
s AS (SELECT input, t, live > 0 AND same >= 0.98 * live AS flat FROM l),
h AS (SELECT input, avg(CAST(flat AS INTEGER)) AS flat_share FROM s GROUP BY input),
g AS (SELECT input, t, t - row_number() OVER (PARTITION BY input ORDER BY t) AS island FROM s WHERE flat),
n AS (SELECT input, count(*) AS len, min(t) AS first, max(t) AS last FROM g GROUP BY input, island),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY input ORDER BY len DESC, first) = 1)""",
    f"SELECT h.input, {r('flat_share', 'flat_share')}, flat_share >= 0.95 AS is_static, CAST(CASE WHEN flat_share >= 0.95 THEN 0 ELSE coalesce(len, 0) END AS BIGINT) AS run, CAST(CASE WHEN flat_share < 0.95 THEN first - 1 END AS BIGINT) AS start, CAST(CASE WHEN flat_share < 0.95 THEN last END AS BIGINT) AS \"end\" FROM h LEFT JOIN b USING (input)",
)


def fresh(columns: list[str], source: str, h: int) -> tuple[str, str]:
    ctes = long(columns, source) + ", l AS (SELECT DISTINCT input, t FROM u WHERE value IS NOT NULL), g AS (SELECT input, t, t - lag(t) OVER (PARTITION BY input ORDER BY t) AS gap FROM l), m AS (SELECT input, max(t) AS last_t, CAST(coalesce(floor(median(gap)), 1) AS BIGINT) AS cadence, (SELECT max(t) FROM " + source + ") AS fin FROM g GROUP BY input)"
    return ctes, f"SELECT input, CAST(last_t AS BIGINT) AS last_t, CAST(fin - last_t AS BIGINT) AS lag, cadence, CAST(greatest(2, cadence + {h} - 1) AS BIGINT) AS allowed, fin - last_t > greatest(2, cadence + {h} - 1) AS stale FROM m"


c, s = fresh(["signal", "ret", "size"], "p", 2)
add("input_freshness", panel("week") + "," + c, s)
USERS = """
c0 AS (SELECT user_id AS asset, CAST(ts AS DATE) AS date, count(*) AS n, sum(value) AS value, count(*) FILTER (event_type = 'purchase') AS buys FROM events GROUP BY 1, 2),
d0 AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT date FROM c0)),
p AS (SELECT d0.t, d0.date, a.asset, c0.n, c0.value, c0.buys FROM d0 CROSS JOIN (SELECT DISTINCT user_id AS asset FROM events) a LEFT JOIN c0 ON c0.date = d0.date AND c0.asset = a.asset)"""
c, s = fresh(["n", "value", "buys"], "p", 1)
add("user_activity_freshness", USERS + "," + c, s)
add(
    "print_quality",
    panel("week") + """,
m AS (SELECT asset, median(ret) AS med FROM p GROUP BY asset),
v AS (SELECT asset, 1.4826 * median(abs(ret - med)) AS scale FROM p JOIN m USING (asset) GROUP BY asset),
q AS (SELECT x.ret AS a, y.ret AS b, scale FROM p x JOIN p y ON y.asset = x.asset AND y.t = x.t + 1 JOIN v ON v.asset = x.asset WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL),
g AS (SELECT count(*) AS n_obs, count(*) FILTER (scale > 0 AND abs(a) > 2 * scale AND sign(a) <> sign(b) AND abs(b) > 0.6 * abs(a)) AS n_bad FROM q)""",
    f"SELECT n_obs, n_bad, {r('n_bad / nullif(n_obs, 0)', 'share')} FROM g",
)
add("sealed_row_counts", panel() + ", q AS (SELECT * FROM p WHERE date > DATE '1999-12-31')", " UNION ALL ".join(f"SELECT '{c}' AS input, count(DISTINCT t) AS n FROM q WHERE {c if c == 'mask' else c + ' IS NOT NULL'}" for c in ("signal", "ret", "vol", "size", "mask")))
add("redacted_panel", panel(), f"SELECT t, asset, {r("CASE WHEN date <= DATE '1999-12-31' THEN signal END", 'signal')}, mask AND date <= DATE '1999-12-31' AS mask FROM p")
BUCKET = "CAST(least(floor((row_number() OVER (PARTITION BY t ORDER BY signal, asset) - 1) * 10 / (count(*) OVER (PARTITION BY t))), 9) AS INTEGER)"
add("rank_buckets", panel(), f"SELECT t, asset, {BUCKET} AS bucket FROM p WHERE signal IS NOT NULL")
add("threshold_or_slope", labelled() + f", q AS (SELECT fwd, count(*) OVER (PARTITION BY t) AS m, {BUCKET} AS bucket FROM f WHERE signal IS NOT NULL AND fwd IS NOT NULL AND mask)", f"SELECT bucket, count(*) AS n, {r('avg(fwd)', 'mean')} FROM q WHERE m >= 30 GROUP BY bucket")
add("xs_zscore", panel() + ", q AS (SELECT t, asset, (signal - avg(signal) OVER w) / nullif(stddev_pop(signal) OVER w, 0) AS z FROM p WINDOW w AS (PARTITION BY t))", f"SELECT t, asset, {r('CASE WHEN z IS NULL THEN NULL ELSE greatest(-2, least(2, z)) END', 'z')} FROM q")


def horner(cs: tuple, x: str) -> str:
    out = repr(cs[-1]) + "::DOUBLE"
    for k in reversed(cs[:-1]):
        out = f"({out} * {x} + {k!r}::DOUBLE)"
    return out


def ratio(up: tuple, down: tuple, x: str) -> str:
    return f"{horner(up, x)} / {horner(down, x)}"


def phi_inv(p: str) -> str:
    q, tail = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(AS241_A, AS241_B, f'(0.180625 - {q} * {q})')} WHEN {tail} <= 5 THEN sign({q}) * {ratio(AS241_C, AS241_D, f'({tail} - 1.6)')} ELSE sign({q}) * {ratio(AS241_E, AS241_F, f'({tail} - 5)')} END"


add("normal_score", panel() + ", q AS (SELECT t, asset, (rank() OVER (PARTITION BY t ORDER BY signal) + (count(*) OVER (PARTITION BY t, signal) - 1) / 2.0) / (count(*) OVER (PARTITION BY t) + 1) AS u FROM p WHERE signal IS NOT NULL)", f"SELECT t, asset, {r(phi_inv('u'), 'score')} FROM q")
add(
    "orthogonal_residual_ic",
    labelled() + """, o AS (SELECT t, count(*) AS m, regr_slope(signal, vol) AS b, regr_intercept(signal, vol) AS a FROM f WHERE signal IS NOT NULL AND vol IS NOT NULL AND mask GROUP BY t),
q AS (SELECT f.*, signal - a - b * vol AS residual FROM f JOIN o USING (t) WHERE m >= 6),""" + ic("i", "q", "residual"),
    f"SELECT t, n, {r('ic', 'ic')} FROM i",
)


def schedule(hold: int, by: str = "", source: str = "p") -> str:
    """CTEs that end in reb(k, j, t, n, nxt)."""
    k = by or "0"
    return f"""
cnt AS (SELECT {k} AS k, t, count(*) FILTER (signal IS NOT NULL AND mask) AS n FROM {source} GROUP BY 1, 2),
fin AS (SELECT k, max(t) AS fin FROM cnt GROUP BY k),
can AS (SELECT cnt.* FROM cnt JOIN fin USING (k) WHERE n >= 30 AND t < fin),
sch AS (SELECT k, min(t) AS t FROM can GROUP BY k UNION ALL SELECT sch.k, (SELECT min(can.t) FROM can WHERE can.k = sch.k AND can.t >= sch.t + {hold}) FROM sch WHERE sch.t IS NOT NULL),
reb AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS INTEGER) AS j, t, n, coalesce(lead(t) OVER (PARTITION BY k ORDER BY t), fin) AS nxt FROM sch JOIN can USING (k, t) JOIN fin USING (k) WHERE t IS NOT NULL)"""


def booked(by: str = "", source: str = "p", weights: str = "") -> str:
    """CTEs from reb and weights to book(k, t, gross, turnover)."""
    k = by or "0"
    w = weights or f"""
leg AS (SELECT reb.*, s.asset, greatest(1, floor(n * 0.1)) AS q, row_number() OVER (PARTITION BY reb.k, reb.t ORDER BY s.signal, s.asset) AS rk FROM reb JOIN {source} s ON s.t = reb.t AND reb.k = {('s.' + by) if by else '0'} WHERE s.signal IS NOT NULL AND s.mask),
wts AS (SELECT k, j, t, nxt, asset, CASE WHEN rk <= q THEN -1 / q ELSE 1 / q END AS w FROM leg WHERE rk <= q OR rk > n - q)"""
    return f"""{w},
dts AS (SELECT DISTINCT {k} AS k, t FROM {source}),
gro AS (SELECT wts.k, d.t, sum(w * coalesce(x.ret, 0)) AS g FROM wts JOIN dts d ON d.k = wts.k AND d.t >= wts.t AND d.t < nxt JOIN {source} x ON x.asset = wts.asset AND x.t = d.t + 1 AND {('x.' + by + ' = wts.k') if by else 'TRUE'} GROUP BY 1, 2),
old AS (SELECT k, j + 1 AS j, asset, w FROM wts),
trn AS (SELECT reb.k, reb.t, (SELECT sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 FROM (SELECT * FROM wts WHERE wts.k = reb.k AND wts.j = reb.j) a FULL JOIN (SELECT * FROM old WHERE old.k = reb.k AND old.j = reb.j) b ON a.asset = b.asset) AS turnover FROM reb),
book AS (SELECT d.k, d.t, CASE WHEN d.t < fin THEN coalesce(g, 0) END AS gross, coalesce(turnover, 0) AS turnover FROM dts d JOIN fin ON fin.k = d.k LEFT JOIN gro ON gro.k = d.k AND gro.t = d.t LEFT JOIN trn ON trn.k = d.k AND trn.t = d.t)"""


BOOK = panel() + "," + schedule(3) + "," + booked()
NET = "(gross - turnover * 10 / 1e4)"
ANN = "exp(sum(ln(1 + {x})) / (count(*) / 12.0)) - 1"
add("rebalance_schedule", panel() + "," + schedule(3), "SELECT j, t, n, nxt AS next FROM reb", True)
add("quantile_book_gross_turnover", BOOK, f"SELECT t, {r('gross', 'gross')}, {r('turnover', 'turnover')} FROM book", True)
add("cost_gate", BOOK, f"SELECT count(*) AS n, {r(ANN.format(x='gross'), 'ann_gross')}, {r(ANN.format(x=NET), 'ann_net')}, {r('avg(turnover) * 12', 'ann_turnover')}, {r('avg(gross) / nullif(avg(turnover), 0) * 1e4 / 2', 'breakeven_bp')}, {r(f'avg({NET}) / nullif(stddev_samp({NET}), 0) * sqrt(12)', 'ir_net')} FROM book WHERE gross IS NOT NULL", True)
METRICS = f"count(bp) AS n_trades, {r('avg(CAST(bp > 0 AS DOUBLE))', 'win_rate')}, {r('avg(bp)', 'avg_bp')}, {r('avg(bp) FILTER (bp > 0) / abs(avg(bp) FILTER (bp < 0))', 'payoff_ratio')}, {r('sum(bp) FILTER (bp > 0) / abs(sum(bp) FILTER (bp < 0))', 'profit_factor')}, {r('min(bp)', 'worst_bp')}, {r('CASE WHEN count(bp) > 5 AND sum(bp) > 1 THEN sum(bp) FILTER (rk <= 5) / sum(bp) END', 'top5_share')}"
add("trade_block", BOOK + f", e AS (SELECT reb.j, 1e4 * sum(coalesce(gross, 0) - turnover * 10 / 1e4) AS bp FROM reb JOIN fin ON fin.k = reb.k JOIN book ON book.t >= reb.t AND (book.t < reb.nxt OR (reb.nxt = fin AND book.t = fin)) GROUP BY reb.j), m AS (SELECT bp, row_number() OVER (ORDER BY bp DESC) AS rk FROM e)", f"SELECT {METRICS} FROM m", True)
add("execution_delay_profile", panel() + ", z AS (" + " UNION ALL ".join(f"SELECT CAST({d} AS INTEGER) AS delay, t, asset, ret, mask, lag(signal, {d}) OVER (PARTITION BY asset ORDER BY t) AS signal FROM p" for d in range(4)) + ")," + schedule(2, "delay", "z") + "," + booked("delay", "z"), f"SELECT k AS delay, count(*) AS n, {r(ANN.format(x=NET), 'ann_net')} FROM book WHERE gross IS NOT NULL GROUP BY k", True)
add(
    "capacity",
    panel() + """, q AS (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM p WHERE t < (SELECT max(t) FROM p) AND t % 3 = 0 AND mask AND signal IS NOT NULL AND dollar_volume > 0),
l AS (SELECT *, greatest(1, floor(n * 0.1)) AS k, row_number() OVER (PARTITION BY t ORDER BY signal, asset) AS rk FROM q WHERE n >= 30),
c AS (SELECT t, min(dollar_volume) * 0.1 * any_value(k) AS cap FROM l WHERE rk <= k OR rk > n - k GROUP BY t)""",
    f"SELECT count(*) AS n_rebalances, {r('median(cap)', 'capacity_median')}, {r('quantile_cont(cap, 0.1)', 'capacity_p10')} FROM c",
)
SCEN = panel() + """,
z AS (SELECT s.scenario, t, asset, signal, ret, CASE WHEN s.scenario = 'floor' THEN mask AND coalesce(dollar_volume, 0) >= 100000 ELSE mask END AS mask, s.scenario = 'free' OR coalesce(ret, 0) < 0.05 AS buyable, s.scenario = 'free' OR coalesce(ret, 0) > -0.05 AS shortable
  FROM p, (VALUES ('free'), ('locked'), ('floor')) s(scenario)),""" + schedule(3, "scenario", "z") + """,
leg AS (SELECT reb.*, s.asset, s.buyable, s.shortable, greatest(1, floor(n * 0.1)) AS q,
  count(*) FILTER (s.buyable) OVER (PARTITION BY reb.k, reb.t ORDER BY s.signal DESC, s.asset DESC ROWS UNBOUNDED PRECEDING) AS lr,
  count(*) FILTER (s.shortable) OVER (PARTITION BY reb.k, reb.t ORDER BY s.signal, s.asset ROWS UNBOUNDED PRECEDING) AS sr
  FROM reb JOIN z s ON s.t = reb.t AND s.scenario = reb.k WHERE s.signal IS NOT NULL AND s.mask),
tally AS (SELECT k, sum(2 * q) AS wanted, sum(miss) AS blocked FROM (SELECT k, t, any_value(q) AS q, count(*) FILTER (NOT buyable AND lr < q) + count(*) FILTER (NOT shortable AND sr < q) AS miss FROM leg GROUP BY k, t) GROUP BY k),""" + booked("scenario", "z", "wts AS (SELECT k, j, t, nxt, asset, CASE WHEN shortable AND sr <= q THEN -1 / q ELSE 1 / q END AS w FROM leg WHERE (shortable AND sr <= q) OR (buyable AND lr <= q))")
add("leg_aware_book", SCEN, f"SELECT k AS scenario, t, {r('gross', 'gross')}, {r('turnover', 'turnover')} FROM book", True)
add("entry_constraints", SCEN, f"SELECT k AS scenario, {r('avg(gross - turnover * 5 / 1e4) * 1e4', 'net_bp')}, CAST(any_value(wanted) AS BIGINT) AS wanted, CAST(any_value(blocked) AS BIGINT) AS blocked FROM book JOIN tally USING (k) WHERE gross IS NOT NULL GROUP BY k", True)


def drift(by: str = "0", tail: str = "") -> str:
    """CTEs from held(k, t, asset), p(t, asset, ret) and dts(k, t) to book(k, t, gross, turnover, net)."""
    return f"""
fin AS (SELECT max(t) AS fin FROM p),
sets AS (SELECT d.k, d.t, coalesce(list(h.asset ORDER BY h.asset) FILTER (h.asset IS NOT NULL), []) AS xs FROM dts d LEFT JOIN held h ON h.k = d.k AND h.t = d.t GROUP BY 1, 2),
chg AS (SELECT k, t, xs, lag(xs) OVER (PARTITION BY k ORDER BY t) AS was FROM sets),
seg AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t) AS s, t AS t0, coalesce(lead(t) OVER (PARTITION BY k ORDER BY t), (SELECT fin FROM fin)) AS t1, xs FROM chg WHERE len(xs) > 0 AND (was IS NULL OR xs <> was) AND t < (SELECT fin FROM fin)),
nam AS (SELECT k, s, t0, t1, 1.0 / len(xs) AS w0, unnest(xs) AS asset FROM seg),
gro AS (SELECT n.k, n.s, n.t0, n.t1, n.asset, p.t, w0 * exp(sum(ln(1 + coalesce(p.ret, 0))) OVER (PARTITION BY n.k, n.s, n.asset ORDER BY p.t)) AS v FROM nam n JOIN p ON p.asset = n.asset AND p.t > n.t0 AND p.t <= n.t1),
tot AS (SELECT k, s, t, sum(v) AS v FROM gro GROUP BY 1, 2, 3),
ret0 AS (SELECT k, t - 1 AS t, v / coalesce(lag(v) OVER (PARTITION BY k, s ORDER BY t), 1) - 1 AS g FROM tot),
lst AS (SELECT g.k, g.s + 1 AS s, g.asset, g.v / tot.v AS w FROM gro g JOIN tot ON tot.k = g.k AND tot.s = g.s AND tot.t = g.t WHERE g.t = g.t1),
tur AS (SELECT x.k, x.s, sum(abs(x.w)) / 2 AS turnover FROM (SELECT k, s, asset, sum(w) AS w FROM (SELECT k, s, asset, w0 AS w FROM nam UNION ALL SELECT k, s, asset, -w FROM lst) GROUP BY 1, 2, 3) x GROUP BY 1, 2),
bk AS (SELECT d.k, d.t, coalesce(g, 0) AS gross, coalesce(turnover, 0) AS turnover FROM dts d LEFT JOIN ret0 ON ret0.k = d.k AND ret0.t = d.t LEFT JOIN seg ON seg.k = d.k AND seg.t0 = d.t LEFT JOIN tur ON tur.k = seg.k AND tur.s = seg.s),
book AS (SELECT *, gross - turnover * 10 / 1e4 AS net FROM bk),
nav AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY k ORDER BY t)) AS nav FROM book),
top AS (SELECT *, nav / max(nav) OVER (PARTITION BY k ORDER BY t) - 1 AS dd FROM nav)"""


SEL = panel() + """,
pick AS (SELECT t, asset, row_number() OVER (PARTITION BY t ORDER BY dollar_volume DESC, asset) AS rk FROM p WHERE mask AND t % 4 = 0),
sel AS (SELECT p.t, p.asset FROM p JOIN pick ON pick.asset = p.asset AND p.t >= pick.t AND p.t < pick.t + 4 WHERE rk <= 10),"""
HELD = SEL + "held AS (SELECT 0 AS k, * FROM sel), dts AS (SELECT DISTINCT 0 AS k, t FROM p)," + drift()
add("backtest_drift", HELD, f"SELECT t, {r('gross', 'gross')}, {r('turnover', 'turnover')}, {r('net', 'net')} FROM book")
SHARPE = "CASE WHEN count(*) >= 20 THEN avg(net) / nullif(stddev_samp(net), 0) * sqrt(12) END"
add("perf_stats", HELD, f"SELECT count(*) AS n, {r(ANN.format(x='net'), 'ann')}, {r(SHARPE, 'sharpe')} FROM book")
add("max_drawdown", HELD, f"SELECT {r('min(dd)', 'mdd')} FROM top")
BOOKS = """
o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS a, avg(o_totalprice) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS b, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS c FROM orders GROUP BY 1),
x AS (SELECT date, CAST(row_number() OVER w - 1 AS INTEGER) AS t, 0.1 * (a - lag(a) OVER w) / (a + lag(a) OVER w) AS bm, 0.1 * (b - lag(b) OVER w) / (b + lag(b) OVER w) AS bl, 0.1 * (c - lag(c) OVER w) / (c + lag(c) OVER w) AS cc FROM o WINDOW w AS (ORDER BY date)),
y AS (SELECT t, date, bm, bl, coalesce((bl + cc) / 2, bl) AS cb FROM x WHERE t > 0),
e AS (SELECT t, date, (1 + coalesce(bl, 0)) / (1 + coalesce(bm, 0)) - 1 AS base, (1 + coalesce(cb, 0)) / (1 + coalesce(bm, 0)) - 1 AS comb FROM y)"""
YEAR = BOOKS + ", v AS (SELECT CAST(year(date) AS INTEGER) AS year, product(1 + base) - 1 AS b, product(1 + comb) - 1 AS c FROM e GROUP BY 1)"
add("yearly_increment", YEAR, f"SELECT year, {r('b', 'baseline')}, {r('c', 'combined')}, {r('c - b', 'delta')} FROM v")
add("increment_curves", BOOKS, f"SELECT t, date, {r('exp(sum(ln(1 + base)) OVER (ORDER BY t))', 'baseline_nav')}, {r('exp(sum(ln(1 + comb)) OVER (ORDER BY t))', 'combined_nav')} FROM e")
ANNUAL = "pow(product(1 + {x}), 12.0 / count(*)) - 1"
add(
    "increment_summary",
    YEAR + f", a AS (SELECT {ANNUAL.format(x='base')} AS b, {ANNUAL.format(x='comb')} AS c FROM e)",
    f"SELECT {r('a.b', 'baseline_ann')}, {r('a.c', 'combined_ann')}, {r('a.c - a.b', 'delta_ann')}, s.years, s.years_improved, s.negative_baseline, s.negative_combined, s.top_year_share FROM a, (SELECT count(*) AS years, count(*) FILTER (c > b) AS years_improved, count(*) FILTER (b < 0) AS negative_baseline, count(*) FILTER (c < 0) AS negative_combined, {r('max(c - b) / nullif(sum(greatest(c - b, 0)), 0)', 'top_year_share')} FROM v) s",
)
add("increment_per_trade", BOOKS + ", g AS (SELECT floor(t / 3) AS b, 1e4 * (product(1 + comb) - product(1 + base)) AS bp FROM e GROUP BY 1), m AS (SELECT bp, row_number() OVER (ORDER BY bp DESC) AS rk FROM g)", f"SELECT {METRICS} FROM m")
DRAW = "(SELECT CAST(range AS INTEGER) AS draw FROM range(20))"
add(
    "increment_null",
    BOOKS + f""", n AS (SELECT draw, t, bm, coalesce(bl, 0) AS bl, coalesce(cb, 0) - coalesce(bl, 0) AS ad, row_number() OVER (PARTITION BY draw ORDER BY t) AS i, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', draw, t))) AS j FROM y, {DRAW}),
m AS (SELECT a.draw, (1 + a.bl) / (1 + coalesce(a.bm, 0)) - 1 AS base, (1 + a.bl + b.ad) / (1 + coalesce(a.bm, 0)) - 1 AS comb FROM n a JOIN n b ON a.draw = b.draw AND a.i = b.j)""",
    f"SELECT draw, {r(f'({ANNUAL.format(x='comb')}) - ({ANNUAL.format(x='base')})', 'stat')} FROM m GROUP BY draw",
)
add("implausible_magnitude", BOOK + "," + f"f AS (SELECT *, {fwd(1)} AS fwd FROM p)," + ic("i", "f") + ", m AS (SELECT (SELECT avg(ic) FROM i) AS c, avg(gross) * 1e4 AS bp, exp(sum(ln(1 + gross))) AS x FROM book WHERE gross IS NOT NULL)", f"SELECT {r('c', 'mean_ic')}, {r('bp', 'bp')}, {r('x', 'multiple')}, abs(c) > 0.30 AS ic_high, abs(bp) > 60 AS bp_high, x > 1000 AS multiple_high FROM m", True)
add("universe_provenance", panel() + ", l(universe, launched) AS (VALUES " + ", ".join(f"('{u}', DATE '{d}')" for u, d in LAUNCHES) + ")", "SELECT universe, launched, first_date, first_date < launched AS predates FROM l, (SELECT min(date) AS first_date FROM p)")
EVENTS = labelled() + ", v AS (SELECT *, coalesce(signal > 0.03, false) AS trigger FROM f WHERE mask AND fwd IS NOT NULL), w AS (SELECT avg(fwd) AS real, count(*) AS n FROM v WHERE trigger)"
add("event_hit_rate", EVENTS, f"SELECT any_value(n) AS n_events, {r('any_value(real)', 'real')}, {r('avg(CAST(sign(fwd) = sign(real) AS DOUBLE))', 'hit_rate')} FROM v, w WHERE trigger")
MEAN = f"SELECT CAST(k AS INTEGER) AS draw, {r('avg(ic)', 'stat')} FROM i GROUP BY k"
FULL = labelled() + f""",
u AS (SELECT draw, t, asset, signal, fwd, row_number() OVER (PARTITION BY draw, t ORDER BY asset) AS i, row_number() OVER (PARTITION BY draw, t ORDER BY md5(concat_ws('|', draw, t, asset))) AS j FROM f, {DRAW} WHERE signal IS NOT NULL AND mask),
z AS (SELECT a.draw, a.t, a.fwd, b.signal FROM u a JOIN u b ON a.draw = b.draw AND a.t = b.t AND a.i = b.j),""" + ic("i", "z", mask="TRUE", by="draw")
add("null_full_shuffle", FULL, MEAN)
add("null_percentile", FULL + ", d AS (SELECT k, avg(ic) AS stat FROM i GROUP BY k)," + ic("o", "f") + ", q AS (SELECT avg(ic) AS real FROM o)", f"SELECT {r('any_value(real)', 'real')}, count(stat) AS n_draws, {r('100 * avg(CAST(stat < real AS DOUBLE))', 'percentile')} FROM d, q")
CELL = "least(floor((row_number() OVER (PARTITION BY t ORDER BY {c}, asset) - 1) * 3 / (count(*) OVER (PARTITION BY t))), 2)"
add(
    "null_matched_buckets",
    labelled() + f""",
e AS (SELECT t, asset, signal, fwd, size, vol, size IS NOT NULL AND vol IS NOT NULL AS ok FROM f WHERE signal IS NOT NULL AND mask),
e2 AS (SELECT *, ok AND count(*) FILTER (ok) OVER (PARTITION BY t) >= 6 AS live FROM e),
b AS (SELECT *, {CELL.format(c='size')} * 3 + {CELL.format(c='vol')} AS cell FROM e2 WHERE live),
u AS (SELECT draw, b.*, row_number() OVER (PARTITION BY draw, t, cell ORDER BY asset) AS i, row_number() OVER (PARTITION BY draw, t, cell ORDER BY md5(concat_ws('|', draw, t, asset))) AS j FROM b, {DRAW}),
z AS (SELECT a.draw, a.t, a.fwd, b.signal FROM u a JOIN u b ON a.draw = b.draw AND a.t = b.t AND a.cell = b.cell AND a.i = b.j UNION ALL SELECT draw, t, fwd, signal FROM e2, {DRAW} WHERE NOT live),""" + ic("i", "z", mask="TRUE", by="draw"),
    MEAN,
)


def relabel(group: str) -> str:
    part = f"draw, {group}" if group else "draw"
    same = f"AND a.{group} = b.{group}" if group else ""
    return labelled() + f""",
u AS (SELECT draw, a0.*, row_number() OVER (PARTITION BY {part} ORDER BY asset) AS i, row_number() OVER (PARTITION BY {part} ORDER BY md5(concat_ws('|', draw, asset)), asset) AS j FROM a0, {DRAW}),
m AS (SELECT a.draw, a.asset, b.asset AS source FROM u a JOIN u b ON a.draw = b.draw AND a.i = b.j {same}),
z AS (SELECT m.draw, x.t, x.fwd, x.mask, y.signal FROM m JOIN f x ON x.asset = m.asset JOIN f y ON y.asset = m.source AND y.t = x.t),""" + ic("i", "z", by="draw")


add("null_identity", relabel(""), MEAN)
add("null_identity_grouped", relabel("grp"), MEAN)
NULL_EVENTS = EVENTS + f", e AS (SELECT *, count(*) FILTER (trigger) OVER (PARTITION BY t) AS k FROM v), x AS (SELECT draw, t, fwd, k, row_number() OVER (PARTITION BY draw, t ORDER BY md5(concat_ws('|', draw, t, asset))) AS rk FROM e, {DRAW} WHERE k > 0), d AS (SELECT draw, avg(fwd) AS stat FROM x WHERE rk <= k GROUP BY draw)"
add("null_events", NULL_EVENTS, f"SELECT draw, {r('stat', 'stat')} FROM d")
add("empirical_p", NULL_EVENTS, f"SELECT {r('any_value(real)', 'real')}, {r('(count(*) FILTER (stat >= real) + 1.0) / (count(stat) + 1.0)', 'p')}, {r('(count(*) FILTER (abs(stat) >= abs(real)) + 1.0) / (count(stat) + 1.0)', 'p_two_sided')} FROM d, w")
add(
    "null_free_selection",
    SEL + f"""
s0 AS (SELECT t, list(asset ORDER BY asset) AS xs FROM sel GROUP BY t),
s1 AS (SELECT t, len(xs) AS n, lag(xs) OVER (ORDER BY t) AS was, xs FROM s0),
s2 AS (SELECT t, n FROM s1 WHERE was IS NULL OR xs <> was),
s3 AS (SELECT t, n, coalesce(lead(t) OVER (ORDER BY t), 1000000) AS nxt FROM s2),
x AS (SELECT draw, s3.t, nxt, n, asset, row_number() OVER (PARTITION BY draw, s3.t ORDER BY md5(concat_ws('|', draw, s3.t, asset))) AS rk FROM s3 JOIN p ON p.t = s3.t AND p.mask, {DRAW}),
dts AS (SELECT DISTINCT draw AS k, t FROM p, {DRAW}),
held AS (SELECT x.draw AS k, d.t, x.asset FROM x JOIN dts d ON d.k = x.draw AND d.t >= x.t AND d.t < x.nxt WHERE rk <= n),""" + drift(),
    f"SELECT k AS draw, {r(SHARPE, 'stat')} FROM book GROUP BY k",
)
TERMS = "list_concat(regexp_extract_all({x}, '[a-z0-9][a-z0-9_+\\-.]*'), flatten(list_transform(regexp_extract_all({x}, '[一-鿿]+'), lambda w: CASE WHEN length(w) = 1 THEN [w] ELSE list_transform(range(1, length(w)), lambda i: substring(w, i, 2)) END)))"
add("tokenize_terms", "d AS (SELECT doc_id, " + TERMS.format(x="lower(coalesce(text, ''))") + " AS terms FROM documents)", "SELECT doc_id, CAST(len(terms) AS BIGINT) AS n_terms, CAST(len(list_distinct(terms)) AS BIGINT) AS n_distinct FROM d")
add(
    "bm25_search",
    "d AS (SELECT doc_id AS id, " + TERMS.format(x="lower(coalesce(text, ''))") + " AS terms FROM documents), q AS (SELECT DISTINCT unnest(" + TERMS.format(x="'thinhely thnd eauouon heitag the ciónra'") + ") AS term), " + """
n AS (SELECT count(*) AS n, avg(len(terms)) AS al FROM d),
o AS (SELECT id, len(terms) AS len, unnest(terms) AS term FROM d),
tf AS (SELECT id, term, count(*) AS tf, any_value(len) AS len FROM o JOIN q USING (term) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.3 + 0.7 * len / al))) AS score FROM tf JOIN df USING (term), n GROUP BY id)""",
    f"SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id, {r('score', 'score')} FROM s WHERE score >= 1 ORDER BY score DESC, id LIMIT 8",
)
add("prior_validation", "", "SELECT * FROM (VALUES ('unknown_mode', 'p4', 'not-a-mode'), ('no_cause', 'p3', 'REJECTED'), ('thin', 'p5', ''), ('duplicate_id', 'p2', ''), ('withdrawn_without_reason', 'p6', 'misread'), ('withdrawn_without_reason', 'p7', ''), ('superseded_by_missing', 'p6', 'p9')) v(problem, id, what)")
add("prior_checklist", "", "SELECT CAST(rank AS INTEGER) AS rank, mode, CAST(n AS BIGINT) AS n, name FROM (VALUES (1, 'cost-eats-it', 2, 'cost eats it'), (2, 'leak-alignment-offset', 1, 'leak alignment offset'), (3, 'null-turnover-unmatched', 1, 'null turnover unmatched')) v(rank, mode, n, name)")
add(
    "verdict_fold",
    labelled() + ", x AS (SELECT 0 AS claim, t, fwd, mask, signal FROM f UNION ALL SELECT 1, t, fwd, mask, -signal FROM f UNION ALL SELECT 2, t, fwd, mask, lag(signal) OVER (PARTITION BY asset ORDER BY t) FROM f UNION ALL SELECT 3, t, fwd, mask, NULL FROM f)," + ic("i", "x", by="claim") + """,
s AS (SELECT CAST(range AS INTEGER) AS claim, avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0) AS tt FROM range(4) LEFT JOIN i ON i.k = range GROUP BY range),
c AS (SELECT claim, 'S6' AS id, true AS blocking, CASE WHEN abs(tt) >= 3 THEN 'PASS' ELSE 'INCONCLUSIVE' END AS outcome FROM s UNION ALL SELECT claim, 'S4', claim <> 2, CASE WHEN tt IS NULL THEN 'NA' WHEN tt >= 2 THEN 'PASS' ELSE 'FAIL' END FROM s)""",
    "SELECT claim, CASE WHEN bool_or(blocking AND outcome = 'FAIL') THEN 'REJECTED' WHEN bool_or(blocking AND outcome = 'INCONCLUSIVE') OR NOT bool_or(blocking AND outcome = 'PASS') THEN 'INCONCLUSIVE' ELSE 'SURVIVES' END AS outcome, coalesce(string_agg(id, ',' ORDER BY id) FILTER (blocking AND outcome = 'FAIL'), '') AS killers FROM c GROUP BY claim",
)
MODE_ROWS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in MODES)
add("taxonomy_coverage", "", f"SELECT family, count(*) AS n_modes, count(*) FILTER (caught <> '') AS n_covered FROM (VALUES {MODE_ROWS}) v(id, family, caught) GROUP BY family")
add("taxonomy_uncovered", "", f"SELECT id, family FROM (VALUES {MODE_ROWS}) v(id, family, caught) WHERE caught = ''")
KNOB = "CASE WHEN count(ret) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN {k} - 1 PRECEDING AND CURRENT ROW) = {k} THEN -avg(ret) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN {k} - 1 PRECEDING AND CURRENT ROW) END"
add(
    "knob_monotonicity",
    labelled() + ", x AS (" + " UNION ALL ".join(f"SELECT {k} AS knob, t, fwd, mask, {KNOB.format(k=k)} AS sg FROM f" for k in (1, 2, 3, 4, 6)) + ")," + ic("i", "x", "sg", by="knob") + """,
m AS (SELECT CASE WHEN t < 42 THEN 'train' ELSE 'valid' END AS segment, k, avg(ic) AS metric FROM i WHERE ic IS NOT NULL GROUP BY 1, 2),
z AS (SELECT segment, rank() OVER (PARTITION BY segment ORDER BY k) AS a, rank() OVER (PARTITION BY segment ORDER BY metric) AS b FROM m)""",
    f"SELECT segment, count(*) AS n, {r('covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)', 'rho')} FROM z GROUP BY segment",
)
