"""The runners: which checks judge a claim, in which order, and where a run stops.

Checks are small queries; each collects a handful of numbers. A run stops by returning, so later jobs are
never submitted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import books, cross_section, increment, inputs, labels, nulls, series
from . import catalog, process
from .process import Prereg, SealedSplit
from .rules import LAUNCHES, knob_rho
from .verdict import FAIL, INCONCLUSIVE, NA, PASS, Check, Report


@dataclass
class Study:
    """A claim that a signal forecasts. panel: dense t, asset, signal, ret, mask, and the named columns."""

    claim: str
    panel: DataFrame
    horizon: int = 1
    covariates: list[str] = field(default_factory=list)
    controls: list[str] = field(default_factory=list)
    naive: str | None = None
    tradable_ret: str | None = None
    dollar_volume: str | None = None
    trigger: str | None = None
    group: str | None = None
    positive_control: str | None = None
    window_based: bool = True
    recompute_at: Callable[[int], DataFrame] | None = None
    probe_dates: Sequence[int] = ()
    refit: Callable[[DataFrame, int], DataFrame] | None = None
    n_shuffle: int = 20
    cost_bp: float = 0.0
    price_basis: str | None = None
    cost_components: Sequence[str] | None = None
    price_source: str = "tradable"
    capital: float | None = None
    max_participation: float = 0.1
    min_dollar_volume: float | None = None
    price_limit: float | None = 0.0995
    quantile: float = 0.1
    long_short: bool = True
    periods_per_year: int = 252
    universe: str = ""
    n_candidates_searched: int = 1
    seed_metric: Callable[[int], float] | None = None
    reported_metric: float | None = None
    n_seeds: int = 20
    knob_metric: Callable[[float, str], float] | None = None
    knob_params: Sequence[float] = ()
    fit_from_start: Callable[[dict], dict] | None = None
    starts: Sequence[dict] = ()
    frozen_config: dict | None = None
    frozen_config_path: str = ""
    fill_convention: str | None = None
    bar_includes_signal: bool | None = None
    implication_results: dict = field(default_factory=dict)
    ask: Callable[[str], str] | None = None
    hindsight_probes: Sequence[dict] = ()
    hindsight_controls: Sequence[dict] = ()
    validator: Callable[[DataFrame], bool] | None = None
    corruptions: dict = field(default_factory=dict)
    validator_data: DataFrame | None = None
    external_facts: Sequence[dict] = ()
    retrained: bool | None = None
    claimed_strides: tuple[int, ...] = ()
    min_n: int = 30

    def __post_init__(self):
        need = {"t", "asset", "signal", "ret", "mask", *self.covariates, *self.controls, *[c for c in (self.naive, self.tradable_ret, self.dollar_volume, self.trigger, self.group, self.positive_control) if c]}
        if missing := need - set(self.panel.columns):
            raise ValueError(f"the panel lacks {sorted(missing)}")


def stat(id_: str, name: str, ok: bool | None, value: float | None, bar: float | None, detail: str = "", axis: str = "statistical", blocking: bool = True, **evidence: Any) -> Check:
    return Check(id_, axis, name, INCONCLUSIVE if ok is None else PASS if ok else FAIL, blocking, value, bar, detail or f"{value if value is None else round(value, 4)} against {bar}", evidence)


def absent(id_: str, axis: str, name: str, why: str = "not supplied") -> Check:
    return Check(id_, axis, name, NA, False, detail=why)


def mean_ic(p: DataFrame, signal: str = "signal", min_n: int = 30) -> float | None:
    return cross_section.rank_ic(p, signal, min_n=min_n).agg(F.avg("ic")).first()[0]


def boundary(profile: list[tuple[int, float | None]], se: float | None) -> Check:
    """A2: where the score first rises as the signal slides towards the label; honest signals rise between shift 0 and 1."""
    name = "feature shift"
    size = [(k, abs(v)) for k, v in sorted(profile) if v is not None]
    steps = [(k, b - a) for (k, a), (k2, b) in zip(size, size[1:], strict=False) if k2 == k + 1]
    if len(steps) < 4:
        return stat("A2", name, None, None, None, "too few usable shifts")
    rises = sorted(max(d, 0.0) for _, d in steps)
    gaps = [b - a for a, b in zip(rises, rises[1:], strict=False)]
    g = max(range(len(gaps)), key=lambda i: gaps[i])
    others = sorted(gaps[:g] + gaps[g + 1 :])
    mid = (others[(len(others) - 1) // 2] + others[len(others) // 2]) / 2 if others else 0.0
    ratio = gaps[g] / mid if mid > 0 else float("inf") if gaps[g] > 0 else 0.0
    if ratio < 5.0:
        return stat("A2", name, None, ratio, 5.0, "no step stands out", gap_ratio=ratio)
    at, jump = next((k, d) for k, d in steps if d > rises[g] + gaps[g] / 2)
    floor = 5.0 * 2**0.5 * se if se is not None else 0.0
    if jump <= floor:
        return stat("A2", name, None, jump, floor, "the largest rise is within sampling error")
    return stat("A2", name, at == 0, float(at), 0.0, f"the label starts between shift {at:+d} and {at + 1:+d}", boundary=at)


def power(profile: list[tuple[int, float | None]], se: float | None) -> Check:
    """A4: the largest rise of the profile against the floor that A2 needs."""
    size = [abs(v) for _, v in sorted(profile) if v is not None]
    if len(size) < 6 or not se:
        return stat("A4", "shift-detector power", None, None, None, "too few dates", blocking=False)
    step, floor = max(b - a for a, b in zip(size, size[1:], strict=False)), 5.0 * 2**0.5 * se
    r = step / floor
    return stat("A4", "shift-detector power", True if r >= 3 else False if r >= 1 else None, r, 3.0, blocking=not 1 <= r < 3)


def shift_rows(p: DataFrame, min_n: int, signal: str = "signal") -> tuple[list[tuple[int, float | None]], float | None]:
    rows = {r["shift"]: r for r in catalog.shift_profile(p, min_n, signal).collect()}
    return [(k, rows[k]["mean"] if k in rows else None) for k in range(-4, 2)], rows[0]["se"] if 0 in rows else None


def audit(s: Study, p: DataFrame) -> list[Check]:
    a0 = absent("A0", "statistical", "truncation rebuild")
    if s.recompute_at:
        n_dates = (p.agg(F.max("t")).first()[0] or 0) + 1
        first, last = int(0.2 * n_dates), n_dates - s.horizon - 2
        probes = list(s.probe_dates) or sorted({int(first + (last - first) * k / 11) for k in range(12) if last >= first})
        again = None
        for t in probes:
            d = s.recompute_at(t).select(F.lit(t).alias("t"), "asset", F.col("signal").alias("b"))
            again = d if again is None else again.unionAll(d)
        sd = p.agg(F.stddev_pop("signal")).first()[0] or 1.0
        both = p.where(F.col("t").isin(probes)).select("t", "asset", F.col("signal").alias("a")).join(again, ["t", "asset"], "left")
        n, diff, gone, new = both.agg(F.count_if(F.expr("a is not null and b is not null")), F.max(F.abs(F.col("a") - F.col("b"))), F.count_if(F.expr("a is not null and b is null")), F.count_if(F.expr("a is null and b is not null"))).first()
        a0 = stat("A0", "truncation rebuild", None if not n else (diff or 0.0) / sd <= 1e-8, (diff or 0.0) / sd, 1e-8, n_vanished=gone, n_appeared=new)
    a1 = absent("A1", "statistical", "label-shuffle refit")
    if s.refit:
        base = p.where(F.col("fwd").isNotNull() & F.col("mask")).select("t", "asset", "fwd")
        vals = []
        drawn = nulls.permuted(base, s.n_shuffle, ["t"], "fwd", []).persist()
        for d in range(s.n_shuffle):
            lab = drawn.where(F.col("draw") == d).select("t", "asset", "fwd")
            vals.append(cross_section.rank_ic(s.refit(lab, d).join(lab, ["t", "asset"]), mask=None, min_n=s.min_n).agg(F.avg("ic")).first()[0])
        drawn.unpersist()
        v = [x for x in vals if x is not None]
        m = sum(v) / len(v) if v else 0.0
        sd = (sum((x - m) ** 2 for x in v) / (len(v) - 1)) ** 0.5 if len(v) > 2 else 0.0
        t = m / (sd / len(v) ** 0.5) if sd else None
        a1 = stat("A1", "label-shuffle refit", None if t is None else abs(t) < 3, t, 3.0)
    prof, se = shift_rows(p, s.min_n)
    a4, a2 = power(prof, se), boundary(prof, se) if s.window_based else absent("A2", "statistical", "feature shift", "not a trailing window")
    if a4.outcome == INCONCLUSIVE and a4.blocking:
        a2 = replace(a2, outcome=INCONCLUSIVE, blocking=False, detail="the detector has no power here (A4)")
    if a0.outcome in (PASS, FAIL):
        a2 = replace(a2, blocking=False)
    return [a0, a1, a4, a2, delay_decay(s)]


def delay_decay(s: Study) -> Check:
    if s.horizon < 3:
        return absent("A3", "statistical", "label delay", "horizon under 3")
    ics = {r["delay"]: r["mean_ic"] for r in catalog.delay_profile(s.panel, s.horizon, (0, 1, 2, 3), s.min_n).collect()}
    if not ics.get(0) or abs(ics[0]) < 1e-6 or ics.get(1) is None:
        return stat("A3", "label delay", None, None, None)
    floor = 0.4 * (s.horizon - 1) / s.horizon
    return stat("A3", "label delay", ics[1] / ics[0] >= floor, ics[1] / ics[0], floor, blocking=False)


def judged(draws: DataFrame, real: float | None) -> tuple[float | None, float | None]:
    """Percentile of the real value and mean of the draws."""
    if real is None:
        return None, None
    return tuple(draws.agg(nulls.percentile_of(F.lit(real)), F.avg("stat")).first())


def statistical(s: Study, p: DataFrame, ic: DataFrame) -> list[Check]:
    g = series.summarise(ic, horizon=s.horizon, periods_per_year=s.periods_per_year).first()
    t, bar = (g["t_nw"] if g else None), series.deflated_threshold(s.n_candidates_searched)
    out = [stat("S4", "significance after search", None if t is None else abs(t) >= bar, t, bar), seeds(s)]
    n, rho = cross_section.label_persistence(p, min_n=s.min_n).agg(F.count("rho"), F.median("rho")).first()
    floor = (s.horizon - 1) / s.horizon
    out.append(stat("S9", "label persistence", None if n < 20 else rho <= floor + 0.5 * (1 - floor), rho, floor + 0.5 * (1 - floor)))
    return [*out, identification(s), knob(s, p)]


def seeds(s: Study) -> Check:
    if s.seed_metric is None:
        return absent("S5", "statistical", "seed stability")
    v = sorted(x for x in (s.seed_metric(i) for i in range(s.n_seeds)) if x is not None and x == x)
    if len(v) < 5:
        return stat("S5", "seed stability", None, None, None)
    positive, pos = sum(x > 0 for x in v) / len(v), 0.9 * (len(v) - 1)
    top = v[int(pos)] + (pos - int(pos)) * (v[min(int(pos) + 1, len(v) - 1)] - v[int(pos)])
    lucky = s.reported_metric is not None and s.reported_metric >= top
    return stat("S5", "seed stability", positive >= 0.8 and not lucky, positive, 0.8, reported_is_top=lucky)


def identification(s: Study, follow: float = 0.5) -> Check:
    if s.fit_from_start is None or len(s.starts) < 3:
        return absent("S10", "statistical", "identification")
    got = [s.fit_from_start(dict(x)) for x in s.starts]
    spread = lambda rows, k: max(r[k] for r in rows) - min(r[k] for r in rows)
    ratio = {k: spread(got, k) / spread(s.starts, k) for k in set(got[0]) & set(s.starts[0]) if spread(s.starts, k) > 0}
    if not ratio:
        return stat("S10", "identification", None, None, None)
    return stat("S10", "identification", max(ratio.values()) <= follow, max(ratio.values()), follow, ratios=ratio)


def knob(s: Study, p: DataFrame) -> Check:
    if s.knob_metric is None:
        return absent("S8", "statistical", "knob monotonicity")
    rows = [(seg, float(k), s.knob_metric(float(k), seg)) for seg in ("train", "valid") for k in s.knob_params]
    if len(s.knob_params) < 4:
        return stat("S8", "knob monotonicity", None, None, None, "fewer than four settings")
    rho = {r["segment"]: r["rho"] for r in knob_rho(p.sparkSession.createDataFrame(rows, "segment string, knob double, metric double")).collect()}
    a, b = rho.get("train"), rho.get("valid")
    bad = a is not None and b is not None and a >= 0.7 and b <= -0.4
    return stat("S8", "knob monotonicity", not bad, None if a is None or b is None else a - b, 1.1, rho=rho)


def mech(id_: str, name: str, ok: bool | None, value: float | None, bar: float | None, blocking: bool = True, **evidence: Any) -> Check:
    return stat(id_, name, ok, value, bar, "", "mechanistic", blocking, **evidence)


def mechanistic(s: Study, p: DataFrame, ic: DataFrame, n_draws: int) -> list[Check]:
    real = ic.agg(F.avg("ic")).first()[0]
    out = []
    pct, _ = judged(nulls.mean_ic_by_draw(nulls.relabelled(p, n_draws, group=s.group), "mask", s.min_n), real)
    out.append(mech("M2", "identity null", None if pct is None else pct >= 95, pct, 95.0, False))
    out.append(control_integrity(s, p, real))
    out.append(universe(s))
    if s.covariates:
        drawn = nulls.matched_shuffle(p, s.covariates, n_draws)
        still = 1 - (drawn.agg(F.avg(F.col("moved").cast("double"))).first()[0] or 0.0)
        pct, mean = judged(nulls.mean_ic_by_draw(drawn, min_n=s.min_n), real)
        share = mean / real if real and mean is not None else None
        out.append(mech("M1", "matched null", None if pct is None else pct >= 95 and (share is None or share <= 0.8), pct, 95.0, null_share=share, share_unpermuted=still))
    else:
        out.append(absent("M1", "mechanistic", "matched null"))
    if s.controls:
        r = cross_section.residual(p, "signal", s.controls[0]) if len(s.controls) == 1 else p.drop("residual").join(cross_section.residual_many(p, "signal", s.controls), ["t", "asset"])
        g = series.summarise(cross_section.rank_ic(r, "residual", min_n=s.min_n), horizon=s.horizon).first()
        t = g["t_nw"] if g else None
        out.append(mech("M3", "residual", None if t is None else abs(t) >= 2, t, 2.0))
    else:
        out.append(absent("M3", "mechanistic", "residual"))
    if s.naive:
        b = cross_section.rank_ic(p, s.naive, min_n=s.min_n).select("t", F.col("ic").alias("b"))
        g = series.summarise(ic.join(b, "t").select("t", (F.col("ic") - F.col("b")).alias("ic")), horizon=s.horizon).first()
        t = g["t_nw"] if g else None
        out.append(mech("M4", "beats naive", None if t is None else t >= 2, t, 2.0, False))
    else:
        out.append(absent("M4", "mechanistic", "beats naive"))
    return [*out, events(s, p, max(50, n_draws // 2)), shape(s, p), independence(s, p), stationarity(s, ic), transfer(s)]


def control_integrity(s: Study, p: DataFrame, real: float | None) -> Check:
    if not s.controls:
        return absent("M12", "mechanistic", "control integrity")
    worst = None
    for c in s.controls:
        prof, se = shift_rows(p, s.min_n, c)
        a2 = boundary(prof, se)
        if a2.outcome == FAIL:
            return mech("M12", "control integrity", False, a2.statistic, 0.0, control=c)
        v = dict(prof)[0]
        if real and v is not None and abs(v) > 2 * abs(real):
            worst = c
    return mech("M12", "control integrity", None if worst else True, None, None, blocking=worst is None, control=worst)


def universe(s: Study) -> Check:
    if not s.universe or "date" not in s.panel.columns:
        return absent("M14", "mechanistic", "universe provenance")
    launched, first = dict(LAUNCHES).get(s.universe), s.panel.agg(F.min("date")).first()[0]
    return mech("M14", "universe provenance", None if launched is None else first >= launched, None, None, launched is not None, launched=str(launched), first=str(first))


def events(s: Study, p: DataFrame, n_draws: int) -> Check:
    if not s.trigger:
        return absent("M7", "mechanistic", "event integrity")
    d = p.where(F.col(s.trigger) & F.col("mask") & F.col("fwd").isNotNull())
    n, real = d.agg(F.count(F.lit(1)), F.avg("fwd")).first()
    if n < 10:
        return mech("M7", "event integrity", None, float(n), 10.0)
    hit = d.agg(F.avg((F.signum("fwd") == F.signum(F.lit(real))).cast("double"))).first()[0]
    if n >= 30 and hit >= 0.98:
        return mech("M7", "event integrity", False, 100 * hit, 98.0, n=n)
    pct, mean = judged(nulls.random_events(p, n_draws, s.trigger), real)
    return mech("M7", "event integrity", pct >= 95, pct, 95.0, hit_rate=hit, null_mean=mean)


def shape(s: Study, p: DataFrame) -> Check:
    m = [r["mean"] for r in cross_section.bucket_means(p, 10, s.min_n).orderBy("bucket").collect()]
    if len(m) < 10 or abs(m[-1] - m[0]) < 1e-12:
        return mech("M8", "threshold or slope", None, None, None, False)
    edge = 1 - abs((max(m[1:-1]) - min(m[1:-1])) / (m[-1] - m[0]))
    return mech("M8", "threshold or slope", edge < 0.6, edge, 0.6, False)


def independence(s: Study, p: DataFrame) -> Check:
    n, share = cross_section.common_share(p, min_n=max(20, s.min_n // 4)).agg(F.count(F.lit(1)), F.median("share")).first()
    return mech("M9", "cross-section independence", None if n < 20 else share <= 0.5, share, 0.5, False)


def stationarity(s: Study, ic: DataFrame) -> Check:
    h = {r["part"]: r for r in series.halves(ic, 2).collect()}
    name = "stationarity"
    if sum(r["n"] for r in h.values()) < 40:
        return mech("M10", name, None, None, None, False)
    m1, m2, s1, s2 = h[1]["mean"], h[2]["mean"], h[1]["se"], h[2]["se"]
    t = (m1 - m2) / (s1**2 + s2**2) ** 0.5 if s1 or s2 else None
    moved = (m1 > 0 > m2 and s2 and m2 / s2 <= -2.0) or (t is not None and t >= 3.0 and m1 > 0 and m2 < 0.5 * m1)
    if not moved:
        return mech("M10", name, True, t, 3.0)
    retrained = True if s.retrained is None and s.refit else s.retrained
    return mech("M10", name, None if retrained is None else False, t, 3.0, retrained is not True)


def transfer(s: Study) -> Check:
    strides = tuple(sorted({1, 2, 4, *s.claimed_strides}))
    rows = {r["stride"]: r for r in catalog.stride_profile(s.panel, s.horizon, strides, s.min_n).collect()}
    base = rows[1]["mean"] if 1 in rows else None
    if base is None:
        return mech("M11", "frequency transfer", None, None, None, False)
    bad = [k for k, r in rows.items() if k > 1 and r["mean"] is not None and ((r["mean"] * base < 0 and abs(r["t"] or 0) >= 2) or (r["mean"] * base > 0 and abs(r["mean"]) < 0.33 * abs(base)))]
    return mech("M11", "frequency transfer", not bad, base, None, bool(set(bad) & set(s.claimed_strides)), broken=bad)


def econ(id_: str, name: str, ok: bool | None, value: float | None, bar: float | None, blocking: bool = True, **evidence: Any) -> Check:
    return stat(id_, name, ok, value, bar, "", "economic", blocking, **evidence)


def economic(s: Study, p: DataFrame, ic: DataFrame) -> list[Check]:
    h = max(1, s.horizon)
    out = [process.e4_cost_convention(s.price_basis, s.cost_components)]
    if s.dollar_volume:
        c = books.capacity(p, s.quantile, h, s.max_participation, s.min_n, volume=s.dollar_volume).first()
        few = c["n_rebalances"] < 5
        out.append(econ("E5", "capacity", None if few else s.capital is None or s.capital <= c["capacity_median"], c["capacity_median"], s.capital, not few and s.capital is not None, p10=c["capacity_p10"]))
    else:
        out.append(absent("E5", "economic", "capacity"))
    book = books.quantile_book(p, s.quantile, h, s.long_short, s.min_n).persist()
    g = books.cost_gate(book, s.cost_bp, s.periods_per_year).first()
    mean, multiple = book.where("gross is not null").agg(F.avg("gross") * 1e4, F.exp(F.sum(F.log1p("gross")))).first()
    m = ic.agg(F.avg("ic")).first()[0]
    odd = (m is not None and abs(m) > 0.30) or abs(mean or 0) > 60 or (multiple or 0) > 1000
    out.append(mech("M13", "implausible magnitude", not odd, m, 0.30, False, bp=mean, multiple=multiple))
    out.append(econ("E1", "net of cost", None if g is None or g["n"] < 30 else g["ann_net"] > 0, g["ann_net"] if g else None, 0.0, breakeven_bp=g["breakeven_bp"] if g else None))
    b = books.trade_metrics(books.blocks(book, s.cost_bp)).first()
    out.append(econ("E2", "per-trade block", b["top5_share"] is None or b["top5_share"] <= 0.8, b["avg_bp"], None, False))
    book.unpersist()
    return [*out, entry(s, p, h), execution(s, p, h)]


def entry(s: Study, p: DataFrame, h: int) -> Check:
    limit = s.price_limit
    locked = bool(limit) and not p.where(F.abs("ret") >= limit).isEmpty()
    if not locked and not (s.dollar_volume and s.min_dollar_volume):
        return absent("E6", "economic", "entry constraints", "nothing constrains entry here")
    d = books.entry_scenarios(p, limit if locked else float("inf"), s.min_dollar_volume if s.dollar_volume else None, volume=s.dollar_volume or "ret")
    book, tally = books.leg_aware_book(d, s.quantile, h, s.min_n, s.long_short, ["scenario"])
    net = {r[0]: r[1] for r in book.where("gross is not null").groupBy("scenario").agg(F.avg(books.net_of_cost(s.cost_bp, 1.0)) * 1e4).collect()}
    base, final = net.get("free"), net.get("floor", net.get("locked"))
    if base is None or final is None:
        return econ("E6", "entry constraints", None, None, None, False)
    lost = (base - final) / abs(base) if base else None
    if base > 0 and final <= 0:
        return econ("E6", "entry constraints", False, final, 0.0, lost=lost)
    if base > 0 and lost is not None and lost > 0.5:
        return econ("E6", "entry constraints", None, final, 0.0, lost=lost)
    return econ("E6", "entry constraints", True, final, 0.0, False, lost=lost)


def execution(s: Study, p: DataFrame, h: int) -> Check:
    name, keep = "execution delay", ["t", "asset", "ret", "mask"]
    lags = labels.variants(p, "delay", "signal", {d: labels.shifted("signal", -d) for d in (0, 1, 2, 3)}, keep)
    ann = {r["delay"]: r["ann_net"] for r in books.cost_gate(books.quantile_book(lags, s.quantile, h, True, s.min_n, by=["delay"]), s.cost_bp, s.periods_per_year, ["delay"]).collect() if r["n"] >= 20}
    base = ann.get(0)
    if base is None or abs(base) < 1e-9:
        return econ("E3", name, None, None, None, False)
    if s.tradable_ret:
        g = books.cost_gate(books.quantile_book(p, s.quantile, h, True, s.min_n, ret=s.tradable_ret), s.cost_bp, s.periods_per_year).first()
        return econ("E3", name, g["ann_net"] / base >= 0.5, g["ann_net"] / base, 0.5)
    kept = ann[1] / base if ann.get(1) is not None else None
    if h < 2 or kept is None:
        return econ("E3", name, None, kept, None, False)
    return econ("E3", name, kept >= 0.4 * (h - 1) / h, kept, 0.4 * (h - 1) / h, s.price_source != "tradable")


def screened(s: Study) -> list[str]:
    return list(dict.fromkeys(["signal", "ret", *s.covariates, *s.controls]))


def input_checks(s: Study, p: DataFrame) -> list[Check]:
    runs = [r for r in inputs.flat_runs(p, screened(s)).collect() if not r["is_static"]]
    worst = max(runs, key=lambda r: r["run"], default=None)
    s7 = absent("S7", "mechanistic", "input staleness", "every input is constant over time") if worst is None else mech("S7", "input staleness", worst["run"] < 20, float(worst["run"]), 20.0, input=worst["input"])
    late = [r for r in inputs.freshness(p, screened(s), s.horizon).collect() if r["stale"]]
    m6 = mech("M6", "input freshness", not late, float(max((r["lag"] for r in late), default=0)), 2.0, stale=[r["input"] for r in late])
    q = inputs.spikes(p).first()
    m5 = mech("M5", "print quality", None if q["n_obs"] < 100 else q["share"] <= 0.002, q["share"], 0.002)
    return [s7, m6, m5]


def run(s: Study, prereg: Prereg | None = None, seal: SealedSplit | None = None, n_draws: int = 200) -> Report:
    """Judges a signal. Five stops: a broken seal, bad inputs or process, an undetectable control, a failed harness, a failed audit or statistic."""
    rep = Report(s.claim, prereg_id=prereg.id if prereg else "")
    p = labels.forward_returns(s.panel, s.horizon).persist()
    try:
        return _run(s, p, rep, prereg, seal, n_draws)
    finally:
        p.unpersist()


def _run(s: Study, p: DataFrame, rep: Report, prereg: Prereg | None, seal: SealedSplit | None, n_draws: int) -> Report:
    first = mean_ic(p, min_n=s.min_n)
    if first is not None and first < 0:
        p = p.withColumn("signal", -F.col("signal"))
        s = replace(s, panel=s.panel.withColumn("signal", -F.col("signal")))
        rep.notes.append("the signal's sign was flipped: its mean rank correlation is negative")
    rep.add(process.p0_preregistered(prereg))
    if prereg:
        rep.add(process.p1_mechanism(prereg))
    if s.frozen_config is not None:
        rep.add(process.p3_frozen_config(s.frozen_config, s.frozen_config_path))
    rep.add(process.p6_implications(prereg.implications if prereg else [], s.implication_results), process.p4_fill_convention(s.fill_convention, s.bar_includes_signal), process.p5_external_facts(s.external_facts))
    rep.add(process.p7_validator_control(s.validator, s.corruptions, s.validator_data), process.p8_hindsight(s.ask, s.hindsight_probes, s.hindsight_controls))
    if seal:
        rep.add(process.p2_seal_intact(seal))
    named = [c for c in (s.naive, s.tradable_ret, s.dollar_volume, s.trigger, s.positive_control) if c]
    p9 = process.p9_seal_respected(s.panel, list(dict.fromkeys([*screened(s), "mask", *named])), seal, s.horizon, bool(seal and seal.status()))
    rep.add(p9)
    if p9.outcome == FAIL:
        rep.notes.append("stopped: the panel holds sealed rows")
        return rep
    rep.add(*input_checks(s, p))
    if rep.killers:
        rep.notes.append("stopped before measuring: " + ", ".join(c.id for c in rep.killers))
        return rep
    ic = cross_section.rank_ic(p, min_n=s.min_n).persist()
    try:
        real = ic.agg(F.avg("ic")).first()[0]
        pct, _ = judged(nulls.mean_ic_by_draw(nulls.full_shuffle(p, max(40, n_draws // 4)), min_n=s.min_n), real)
        m0 = mech("M0", "harness", None if pct is None else pct >= 90, pct, 90.0)
        control = p.withColumn("control_", F.col(s.positive_control) if s.positive_control else labels.trailing_control())
        g = series.summarise(cross_section.rank_ic(control, "control_", min_n=s.min_n), horizon=s.horizon).first()
        t = g["t_nw"] if g else None
        s6 = stat("S6", "positive control", None if t is None else abs(t) >= 3, t, 3.0, blocking=False)
        if s6.outcome == FAIL:
            rep.add(replace(m0, outcome=INCONCLUSIVE), s6)
            rep.notes.append("stopped: the panel does not show an effect that it is known to hold")
            return rep
        rep.add(m0, s6)
        if rep.killers:
            rep.notes.append("stopped: no better than shuffled")
            return rep
        rep.add(*audit(s, p), *statistical(s, p, ic))
        if rep.killers:
            rep.notes.append("stopped after the audit and the statistics")
            return rep
        return rep.add(*mechanistic(s, p, ic, n_draws), *economic(s, p, ic))
    finally:
        ic.unpersist()


@dataclass
class StrategyStudy:
    """A claim that a book beats chance. panel: dense t, asset, ret, mask, sel; benchmark: (t, benchmark)."""

    claim: str
    panel: DataFrame
    benchmark: DataFrame | None = None
    cost_bp: float = 0.0
    periods_per_year: int = 252

    def __post_init__(self):
        if missing := {"t", "asset", "ret", "mask", "sel"} - set(self.panel.columns):
            raise ValueError(f"the panel lacks {sorted(missing)}")


def run_strategy(s: StrategyStudy, prereg: Prereg | None = None, n_draws: int = 500) -> Report:
    rep = Report(s.claim, prereg_id=prereg.id if prereg else "").add(process.p0_preregistered(prereg))
    book = books.drift_book(s.panel, s.cost_bp)
    own = books.perf(book, s.periods_per_year).first()
    if s.benchmark is not None:
        b = books.perf(book.select("t").join(s.benchmark, "t"), s.periods_per_year, net="benchmark").first()
        rep.add(econ("SE1", "beats the benchmark", None if own["ann"] is None or b["ann"] is None else own["ann"] > b["ann"], own["ann"], b["ann"]))
    dates = nulls.draws(s.panel.select("t").distinct(), n_draws)
    for id_, name, drawn, blocking in (("SM0", "free null", nulls.free_selection(s.panel, n_draws), False), ("SM1", "turnover-matched null", nulls.matched_selection(s.panel, n_draws).withColumn("sel", F.lit(True)), True)):
        stats = books.perf(books.drift_book(drawn, s.cost_bp, ["draw"], dates=dates, returns=s.panel), s.periods_per_year, ["draw"]).select("draw", F.col("sharpe").alias("stat"))
        pct, _ = judged(stats, own["sharpe"])
        rep.add(mech(id_, name, None if pct is None else pct >= 95, pct, 95.0, blocking))
    m = books.trade_metrics(books.blocks(book, s.cost_bp)).first()
    return rep.add(econ("SE2", "per-trade block", True, m["avg_bp"], None, False))


def run_increment(claim: str, series_: DataFrame, candidates: DataFrame | None = None, prereg: Prereg | None = None, periods_per_year: int = 252) -> Report:
    """Judges an addition to a book. series_: t, date, baseline, combined, benchmark; candidates: null draws (draw, stat) of the annual delta."""
    rep = Report(claim, prereg_id=prereg.id if prereg else "").add(process.p0_preregistered(prereg))
    g = increment.summary(series_, periods_per_year).first()
    ok = g["delta_ann"] > 0 and g["negative_combined"] <= g["negative_baseline"] and (g["top_year_share"] or 0) <= 0.8
    rep.add(econ("I1", "incremental contribution", None if g["years"] < 3 else ok, g["delta_ann"], 0.0, years_improved=g["years_improved"], top_year_share=g["top_year_share"]))
    if candidates is None:
        return rep.add(absent("I2", "mechanistic", "null candidate"))
    pct, _ = judged(candidates, g["delta_ann"])
    return rep.add(mech("I2", "null candidate", None if pct is None else pct >= 95, pct, 95.0))
