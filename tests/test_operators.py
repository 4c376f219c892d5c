"""Operators against small inputs with known answers, and numpy loops."""

import hashlib
from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions.columns import inverse_normal
from gristmill.operators import books, cross_section, inputs, labels, nulls, retrieval, series
from gristmill.operators.fit import RollingFit
from gristmill.sources.panel import clean


def frame(spark, ret, **more):
    t, n = ret.shape
    rows = [(i, date(2020, 1, 1) + timedelta(i), j, float(ret[i, j]), True, *[None if np.isnan(v[i, j]) else float(v[i, j]) for v in more.values()]) for i in range(t) for j in range(n)]
    kinds = ", ".join(f"{k} double" for k in more)
    return clean(spark.createDataFrame(rows, "t int, date date, asset long, ret double, mask boolean" + (f", {kinds}" if kinds else "")), "ret")


@pytest.fixture(scope="module")
def panel(spark):
    g = np.random.default_rng(0)
    state, ret = g.normal(size=40), np.zeros((60, 40))
    signal = np.zeros((60, 40))
    for t in range(60):
        signal[t] = state
        state = 0.8 * state + 0.6 * g.normal(size=40)
        ret[t] = 0.01 * g.normal(size=40) + (0.01 * signal[t - 1] if t else 0)
    ret[5, 3] = np.nan
    return ret, signal, frame(spark, ret, signal=signal).persist()


def test_forward_returns(panel):
    ret, _, df = panel
    got = {(r.t, r.asset): r.fwd for r in labels.forward_returns(df, 3, 1).select("t", "asset", "fwd").collect()}
    for (t, a), v in got.items():
        part = ret[t + 2 : t + 5, a]
        if len(part) < 3 or np.isnan(part).any():
            assert v is None
        else:
            assert v == pytest.approx(np.prod(1 + part) - 1)


def test_total_loss_is_minus_one(spark):
    df = frame(spark, np.array([[0.1], [-1.0], [0.5], [-1.5]]))
    assert [r.fwd for r in labels.forward_returns(df, 1).orderBy("t").collect()] == pytest.approx([-1.0, 0.5, None, None], nan_ok=True)


def test_rank_ic_and_newey_west(panel):
    ret, signal, df = panel
    ic = cross_section.rank_ic(labels.forward_returns(df, 1), min_n=30)
    v = np.array([r.ic for r in ic.orderBy("t").collect()])
    ranks = lambda x: np.argsort(np.argsort(x))
    assert v[0] == pytest.approx(np.corrcoef(ranks(signal[0]), ranks(ret[1]))[0, 1])
    e, n, lags = v - v.mean(), len(v), 2
    var = e @ e / n + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    assert series.summarise(ic, lags=2).first()["t_nw"] == pytest.approx(v.mean() / np.sqrt(var / n))


def test_no_variance_gives_null(spark):
    df = frame(spark, np.full((3, 40), 0.01), signal=np.ones((3, 40)))
    assert {r.ic for r in cross_section.rank_ic(labels.forward_returns(df, 1)).collect()} == {None}


def test_inverse_normal(spark):
    ps = [1e-12, 0.001, 0.3, 0.5, 0.9, 0.9999999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(inverse_normal(F.col("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps])
    assert series.deflated_threshold(5000) == pytest.approx(4.41717, abs=1e-4)


def loop_book(signal, ret, q, hold):
    t_n, n = signal.shape
    w, gross, turn, last = np.zeros(n), [None] * t_n, np.zeros(t_n), -99
    for t in range(t_n - 1):
        if t - last >= hold:
            k = max(1, int(n * q))
            order, new = np.argsort(signal[t], kind="stable"), np.zeros(n)
            new[order[-k:]], new[order[:k]] = 1 / k, -1 / k
            turn[t], w, last = np.abs(new - w).sum() / 2, new, t
        gross[t] = float(w @ np.nan_to_num(ret[t + 1]))
    return gross, turn


def test_quantile_book_matches_a_loop(panel):
    ret, signal, df = panel
    gross, turn = loop_book(signal, ret, 0.1, 3)
    rows = books.quantile_book(df, hold=3).orderBy("t").collect()
    assert [r.turnover for r in rows] == pytest.approx(turn)
    assert [r.gross for r in rows[:-1]] == pytest.approx(gross[:-1]) and rows[-1].gross is None


def test_drift_book_matches_a_loop(panel):
    ret, signal, df = panel
    held = signal > 1
    sel = df.withColumn("sel", F.col("signal") > 1)
    w, prev, want = np.zeros(40), np.zeros(40, bool), []
    for t in range(60):
        if t == 59:
            want.append((0.0, 0.0))
            break
        turn = 0.0
        if held[t].any() and (held[t] != prev).any():
            new = held[t] / held[t].sum()
            turn, w = np.abs(new - w).sum() / 2, new
        prev, step = held[t], np.nan_to_num(ret[t + 1])
        want.append((float(w @ step), turn))
        if (w * (1 + step)).sum() > 0:
            w = w * (1 + step) / (w * (1 + step)).sum()
    got = [(r.gross, r.turnover) for r in books.drift_book(sel, 0.0).orderBy("t").collect()]
    assert np.allclose(got, want)


def test_full_shuffle_permutes_within_dates(panel):
    _, signal, df = panel
    rows = nulls.full_shuffle(df.withColumn("fwd", F.col("ret")), 2).where("t = 7").collect()
    for d in (0, 1):
        assert sorted(r.signal for r in rows if r.draw == d) == pytest.approx(sorted(signal[7]))
    assert [r.signal for r in rows if r.draw == 0] != [r.signal for r in rows if r.draw == 1]


def test_matched_selection_keeps_turnover(panel):
    df = panel[2].withColumn("sel", F.col("signal") > 1)
    real = {r.t: set(r.s) for r in df.where("sel").groupBy("t").agg(F.collect_set("asset").alias("s")).collect()}
    drawn = {r.t: set(r.s) for r in nulls.matched_selection(df, 1).groupBy("t").agg(F.collect_set("asset").alias("s")).collect()}
    assert all(len(drawn[t]) == len(real[t]) for t in real)
    assert all(len(drawn[t] & drawn[t - 1]) >= len(real[t] & real[t - 1]) for t in real if t - 1 in real and real[t] != real[t - 1])


def md5_order(names, draw, t):
    return sorted(names, key=lambda a: hashlib.md5(f"{draw}|{t}|{a}".encode()).hexdigest())


def test_random_selection_matches_a_loop(panel):
    """Breadth that grows, shrinks and stops, picks held for three dates, unusable names left out."""
    df = panel[2].withColumn("mask", (F.col("asset") + F.col("t")) % 7 != 0)
    want = {t: [4, 9, 2, 0, 6][t // 5 % 5] for t in range(60) if t % 11}
    counts = df.sparkSession.createDataFrame(list(want.items()), "t int, want int")
    got = {}
    for r in nulls.random_selection(df, counts, 2, hold=3).collect():
        got.setdefault((r.draw, r.t), set()).add(r.asset)
    for draw in (0, 1):
        bought = []  # (date, asset)
        for t in range(60):
            held = {a for s, a in bought if t < s + 3}
            free = [a for a in range(40) if (a + t) % 7 and a not in held]
            new = md5_order(free, draw, t)[: max(0, want.get(t, 0) - len(held))]
            bought += [(t, a) for a in new]
            assert got.get((draw, t), set()) == held | set(new)
    assert any(got.get((0, t)) != got.get((1, t)) for t in range(60))


def test_residual_on_several_controls_is_least_squares(spark):
    """Collinear controls, rows without a control or outside the mask, dates with too few rows."""
    g = np.random.default_rng(23)
    x, y = g.normal(size=(6, 12, 2)), g.normal(size=(6, 12))
    x[1, :, 1] = 2 * x[1, :, 0]
    x[2, 3:, 0] = np.nan
    x[3, 4, 1] = np.nan
    mask = g.random((6, 12)) < 0.9
    cell = lambda v: None if np.isnan(v) else float(v)
    rows = [(t, a, bool(mask[t, a]), float(y[t, a]), cell(x[t, a, 0]), cell(x[t, a, 1])) for t in range(6) for a in range(12)]
    df = spark.createDataFrame(rows, "t int, asset long, mask boolean, signal double, c1 double, c2 double")
    got = {(r.t, r.asset): r.residual for r in cross_section.residual_many(df, "signal", ["c1", "c2"]).collect()}
    want = {}
    for t in range(6):
        m = np.flatnonzero(mask[t] & np.isfinite(x[t]).all(1))
        if len(m) >= 7:
            q, _ = np.linalg.qr(np.column_stack([np.ones(len(m)), x[t, m] if t != 1 else x[t, m, :1]]))
            want |= {(t, a): v for a, v in zip(m.tolist(), y[t, m] - q @ (q.T @ y[t, m]), strict=True)}
    assert {t for t, _ in want} == {0, 1, 3, 4, 5} and set(got) == set(want)
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_refit_on_shuffled_labels_is_that_of_a_loop(panel):
    """Each draw's labels permuted by hand, fitted alone and scored against themselves."""
    df = labels.forward_returns(panel[2], 1).withColumn("f1", F.col("signal"))
    fit = RollingFit(features=("f1",), window=15, stride=4, min_n=20)
    got = {r.draw: r.stat for r in fit.shuffled_ic(df, 2).collect()}
    fwd = {}
    for r in df.where("mask and fwd is not null").select("t", "asset", "fwd").collect():
        fwd.setdefault(r.t, {})[r.asset] = r.fwd
    for draw in (0, 1):
        own = {(t, a): v[b] for t, v in fwd.items() for a, b in zip(sorted(v), md5_order(v, draw, t), strict=True)}
        drawn = df.sparkSession.createDataFrame([(t, a, v) for (t, a), v in own.items()], "t int, asset long, fwd double")
        dates = {}
        for r in fit.refit(df, drawn).collect():
            dates.setdefault(r.t, []).append((r.signal, own[r.t, r.asset]))
        rank = lambda v: np.argsort(np.argsort(v))
        ics = [np.corrcoef(rank([s for s, _ in v]), rank([w for _, w in v]))[0, 1] for v in dates.values()]
        assert len(ics) > 5 and got[draw] == pytest.approx(np.mean(ics), abs=1e-9)


def test_ema(spark):
    df = frame(spark, np.array([[1.0], [2.0], [4.0]]))
    assert [r.ema for r in labels.ema(df, "ret", 3).orderBy("t").collect()] == pytest.approx([1.0, 1.5, 2.75])


def test_frozen_tail_is_found(spark):
    x = np.random.default_rng(1).normal(size=(60, 30))
    x[30:] = x[30]
    got = {r.input: r for r in inputs.flat_runs(frame(spark, x, moving=np.random.default_rng(2).normal(size=(60, 30)), size=np.ones((60, 30))), ["ret", "moving", "size"]).collect()}
    assert (got["ret"].run, got["ret"].start, got["ret"].end) == (29, 30, 59)
    assert got["moving"].run == 0 and got["size"].is_static


def test_spikes_and_freshness(spark):
    x = 0.01 * np.random.default_rng(3).normal(size=(80, 30))
    clean_share = inputs.spikes(frame(spark, x)).first().share
    x[10:70:10] = 0.5
    x[11:71:10] = -0.45
    assert clean_share == 0 and inputs.spikes(frame(spark, x)).first().share > 0.05
    y = x.copy()
    y[40:] = np.nan
    got = {r.input: r for r in inputs.freshness(frame(spark, x, old=y), ["ret", "old"]).collect()}
    assert got["old"].stale and not got["ret"].stale


def test_rolling_fit_is_causal_and_full_sample_is_not(panel):
    df = labels.forward_returns(panel[2], 1).withColumn("f1", F.col("signal")).withColumn("f2", F.col("signal") * F.col("signal"))
    args = {"features": ("f1", "f2"), "window": 15, "stride": 4, "min_n": 20}
    assert all(r.max_diff < 1e-10 for r in RollingFit(**args).rebuild_difference(df, (22, 30)).collect())
    assert any(r.max_diff > 1e-6 for r in RollingFit(**args, mode="full_sample").rebuild_difference(df, (20, 28)).collect())  # its dates start at 0


@pytest.mark.parametrize(("mode", "standardize"), [("causal", "cross-section"), ("contaminated", "cross-section"), ("full_sample", "cross-section"), ("causal", "full-sample")])
def test_rolling_fit_is_that_of_a_loop(spark, mode, standardize):
    """Every forecast against least squares written out date by date."""
    from statistics import NormalDist

    g = np.random.default_rng(17)
    dates, assets, window, stride, ridge, min_n = 30, 26, 8, 3, 0.05, 20
    x = g.normal(size=(dates, assets, 2))
    x[5, :, 1] = 1.0  # no spread: that date has no rows
    fwd = g.normal(size=(dates, assets)) + x[:, :, 0]
    mask = g.random((dates, assets)) < 0.95
    rows = [(t, f"a{a:02d}", bool(mask[t, a]), float(fwd[t, a]) if t < dates - 1 else None, float(x[t, a, 0]), float(x[t, a, 1])) for t in range(dates) for a in range(assets)]
    df = spark.createDataFrame(rows, "t int, asset string, mask boolean, fwd double, f1 double, f2 double")
    axis = 0 if standardize == "full-sample" else 1
    sd = x.std(axis, keepdims=True)
    z = np.clip((x - x.mean(axis, keepdims=True)) / np.where(sd > 1e-12, sd, np.nan), -5, 5)
    parts = {}
    for t in range(dates - 1):
        m = np.flatnonzero(mask[t] & np.isfinite(z[t]).all(1))
        if len(m) >= min_n:
            rank = np.argsort(np.argsort(fwd[t, m])) + 1
            parts[t] = (m, np.column_stack([np.ones(len(m)), z[t, m]]), np.array([NormalDist().inv_cdf(r / (len(m) + 1)) for r in rank]))
    want = {}
    for t in range(0 if mode == "full_sample" else window + 3, dates, stride):
        train = {"causal": range(t - 1 - window, t - 1), "contaminated": range(t - window + 1, t + 1), "full_sample": range(1, dates)}[mode]
        got = [parts[d] for d in train if d in parts]
        if t in parts and sum(len(p[0]) for p in got) >= 5 * min_n:
            a, b = sum(p[1].T @ p[1] for p in got), sum(p[1].T @ p[2] for p in got)
            a[1:, 1:] += ridge * np.trace(a[1:, 1:]) / 2 * np.eye(2)
            want |= {(t, f"a{i:02d}"): v for i, v in zip(parts[t][0], parts[t][1] @ np.linalg.solve(a, b), strict=True)}
    out = {(r.t, r.asset): r.signal for r in RollingFit(features=("f1", "f2"), window=window, stride=stride, min_n=min_n, ridge=ridge, mode=mode, standardize=standardize).predict(df).collect()}
    assert len(want) > 100 and set(out) == set(want)
    assert all(out[k] == pytest.approx(v, abs=1e-7) for k, v in want.items())


def test_tokens_and_search(spark):
    one = spark.createDataFrame([("Net-of-cost IC_5 动量反转 好 x.",)], "s string").select(retrieval.tokenize(F.col("s"))).first()[0]
    assert one == ["net-of-cost", "ic_5", "x.", "动量", "量反", "反转", "好"]
    docs = spark.createDataFrame([("a", "momentum rotation lost to turnover"), ("b", "sentiment text"), ("c", "动量 轮动 换手")], "id string, text string")
    assert [r.id for r in retrieval.bm25(docs, "rotation turnover", min_score=0.5).collect()] == ["a"]
    assert [r.id for r in retrieval.bm25(docs, "换手", min_score=0.5).collect()] == ["c"]
