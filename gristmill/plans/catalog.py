"""Queries over the panel operators, by name: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import tidy
from ..operators import books, cross_section, increment, inputs, labels, nulls, retrieval, series, taxonomy
from ..sources.panel import monthly_books, part_panel, supplier_panel, table, user_panel
from . import rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MIN_N = 30
DRAWS = 20
SEAL_END = date(1999, 12, 31)
INPUTS = ["signal", "ret", "vol", "size"]
KEEP = ["t", "asset", "mask", "fwd"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
    return f


def labelled(spark: SparkSession, sf_dir: str, h: int = 1, step: str = "month") -> DataFrame:
    return labels.forward_returns(supplier_panel(spark, sf_dir, step), h)


def daily_ic(spark: SparkSession, sf_dir: str, h: int = 1, signal: str = "signal") -> DataFrame:
    return cross_section.rank_ic(labelled(spark, sf_dir, h), signal, min_n=MIN_N)


@query
def forward_returns_h1(spark, sf_dir):
    return labelled(spark, sf_dir).select("t", "asset", "fwd")


@query
def forward_returns_h5_delay1(spark, sf_dir):
    return labels.forward_returns(supplier_panel(spark, sf_dir), 5, 1).select("t", "asset", "fwd")


@query
def default_control(spark, sf_dir):
    return supplier_panel(spark, sf_dir).select("t", "asset", labels.trailing_control().alias("control"))


@query
def rank_ic_daily(spark, sf_dir):
    return daily_ic(spark, sf_dir)


@query
def rank_ic_wide(spark, sf_dir):
    """The part by quarter panel: many assets, few dates."""
    return cross_section.rank_ic(labels.forward_returns(part_panel(spark, sf_dir), 1), min_n=MIN_N)


@query
def rank_ic_summary(spark, sf_dir):
    return series.summarise(daily_ic(spark, sf_dir), periods_per_year=12)


@query
def newey_west_t(spark, sf_dir):
    return series.summarise(daily_ic(spark, sf_dir, 3), horizon=3, periods_per_year=12).select("n", "mean", "t_nw")


@query
def ic_sampling(spark, sf_dir):
    return series.sampling(daily_ic(spark, sf_dir, 5), 5)


@query
def label_persistence(spark, sf_dir):
    r = cross_section.label_persistence(labelled(spark, sf_dir, 5, "week"), min_n=10)
    return r.agg(F.count("rho").alias("n"), F.median("rho").alias("persistence"))


@query
def common_variance_share(spark, sf_dir):
    return cross_section.common_share(labelled(spark, sf_dir, 1, "week")).agg(F.count(F.lit(1)).alias("n"), F.median("share").alias("common"))


@query
def stationarity_halves(spark, sf_dir):
    return series.halves(daily_ic(spark, sf_dir), 2)


@query
def stationarity_quarters(spark, sf_dir):
    return series.halves(daily_ic(spark, sf_dir), 4)


def stride_profile(panel: DataFrame, h: int, strides: tuple[int, ...], min_n: int) -> DataFrame:
    fwd = {k: labels.forward_return(h * k) for k in strides}
    d = labels.variants(panel, "stride", "fwd", fwd, ["t", "asset", "signal", "mask"]).where("t % stride = 0")
    ic = cross_section.rank_ic(d, min_n=min_n, by=["stride"])
    g = ic.where("ic is not null").groupBy("stride").agg(F.count(F.lit(1)).alias("n"), F.avg("ic").alias("mean"), (F.stddev_samp("ic") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return g.select("stride", "n", F.when(F.col("n") >= 8, F.col("mean")).alias("mean"), F.when(F.col("n") >= 8, F.try_divide("mean", "se")).alias("t"))


@query
def frequency_transfer(spark, sf_dir):
    return stride_profile(supplier_panel(spark, sf_dir, "week"), 1, (1, 2, 4), 10)


def delay_profile(panel: DataFrame, h: int, delays: tuple[int, ...], min_n: int) -> DataFrame:
    d = labels.variants(panel, "delay", "fwd", {k: labels.forward_return(h, k) for k in delays}, ["t", "asset", "signal", "mask"])
    return cross_section.rank_ic(d, min_n=min_n, by=["delay"]).groupBy("delay").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean_ic"))


@query
def label_delay_decay(spark, sf_dir):
    return delay_profile(supplier_panel(spark, sf_dir), 3, (0, 1, 2, 3), MIN_N)


def shift_profile(panel: DataFrame, min_n: int, signal: str = "signal", span: int = 4) -> DataFrame:
    """(shift, n, mean, se) of the rank IC with the signal moved along time."""
    shifts = {k: labels.shifted(signal, k) for k in range(-span, 2)}
    d = labels.variants(panel, "shift", "signal", shifts, KEEP)
    ic = cross_section.rank_ic(d, min_n=min_n, by=["shift"])
    return ic.groupBy("shift").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), (F.stddev_samp("ic") / F.sqrt(F.count("ic"))).alias("se"))


@query
def feature_shift_profile(spark, sf_dir):
    return shift_profile(labelled(spark, sf_dir), MIN_N)


@query
def shift_power_profile(spark, sf_dir):
    p = shift_profile(labelled(spark, sf_dir), MIN_N).withColumn("size", F.abs("mean"))
    p = p.withColumn("rise", F.lead("size").over(W.orderBy("shift")) - F.col("size"))
    g = p.agg(F.max("rise").alias("largest_step"), (5.0 * F.sqrt(F.lit(2.0)) * F.max(F.when(F.col("shift") == 0, F.col("se")))).alias("floor"))
    return g.select("largest_step", "floor", (F.col("largest_step") / F.col("floor")).alias("ratio"))


@query
def control_integrity_profile(spark, sf_dir):
    return shift_profile(labelled(spark, sf_dir), MIN_N, "vol")


@query
def naive_paired_diff(spark, sf_dir):
    p = labelled(spark, sf_dir)
    both = cross_section.rank_ic(p, min_n=MIN_N).select("t", F.col("ic").alias("a")).join(cross_section.rank_ic(p, "vol", min_n=MIN_N).select("t", F.col("ic").alias("b")), "t")
    return series.summarise(both.select("t", (F.col("a") - F.col("b")).alias("ic")), periods_per_year=12).select("n", "mean", "t_nw")


@query
def input_staleness_runs(spark, sf_dir):
    return inputs.flat_runs(supplier_panel(spark, sf_dir), INPUTS)


@query
def input_freshness(spark, sf_dir):
    return inputs.freshness(supplier_panel(spark, sf_dir, "week"), ["signal", "ret", "size"], horizon=2)


@query
def print_quality(spark, sf_dir):
    return inputs.spikes(supplier_panel(spark, sf_dir, "week"), k=2.0)


@query
def sealed_row_counts(spark, sf_dir):
    return inputs.sealed_rows(supplier_panel(spark, sf_dir), [*INPUTS, "mask"], SEAL_END)


@query
def redacted_panel(spark, sf_dir):
    return inputs.redact(supplier_panel(spark, sf_dir), ["signal", "mask"], SEAL_END).select("t", "asset", "signal", "mask")


@query
def rank_buckets(spark, sf_dir):
    return cross_section.buckets(supplier_panel(spark, sf_dir).where("signal is not null"), "signal", 10).select("t", "asset", "bucket")


@query
def threshold_or_slope(spark, sf_dir):
    return cross_section.bucket_means(labelled(spark, sf_dir), 10, MIN_N)


@query
def xs_zscore(spark, sf_dir):
    return cross_section.zscore(supplier_panel(spark, sf_dir), "signal", clip=2.0).select("t", "asset", "z")


@query
def normal_score(spark, sf_dir):
    return cross_section.normal_score(supplier_panel(spark, sf_dir), "signal").select("t", "asset", "score")


@query
def orthogonal_residual_ic(spark, sf_dir):
    return cross_section.rank_ic(cross_section.residual(labelled(spark, sf_dir), "signal", "vol"), "residual", min_n=MIN_N)


@query
def orthogonalize_multi(spark, sf_dir):
    return cross_section.residual_many(labelled(spark, sf_dir), "signal", ["vol", "size"])


@query
def rebalance_schedule(spark, sf_dir):
    p = supplier_panel(spark, sf_dir)
    return books.schedule(books.usable_counts(p, [], "signal", "mask"), [], 3, MIN_N).select("j", "t", "n", "next")


def base_book(spark, sf_dir, hold: int = 3) -> DataFrame:
    return books.quantile_book(supplier_panel(spark, sf_dir), hold=hold, min_n=MIN_N)


@query
def quantile_book_gross_turnover(spark, sf_dir):
    return base_book(spark, sf_dir)


@query
def cost_gate(spark, sf_dir):
    return books.cost_gate(base_book(spark, sf_dir), 5.0, 12)


@query
def trade_block(spark, sf_dir):
    return books.trade_metrics(books.blocks(base_book(spark, sf_dir), 5.0))


@query
def execution_delay_profile(spark, sf_dir):
    lags = {d: labels.shifted("signal", -d) for d in (0, 1, 2, 3)}
    d = labels.variants(supplier_panel(spark, sf_dir), "delay", "signal", lags, ["t", "asset", "ret", "mask"])
    b = books.quantile_book(d, hold=2, min_n=MIN_N, by=["delay"])
    return books.cost_gate(b, 5.0, 12, ["delay"]).select("delay", "n", "ann_net")


@query
def capacity(spark, sf_dir):
    return books.capacity(supplier_panel(spark, sf_dir), hold=3, min_n=MIN_N)


def scenarios(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = supplier_panel(spark, sf_dir).select("t", "asset", "signal", "ret", "mask", "dollar_volume")
    return books.leg_aware_book(books.entry_scenarios(p, 0.05, 100_000.0), 0.1, 3, MIN_N, by=["scenario"])


@query
def leg_aware_book(spark, sf_dir):
    return scenarios(spark, sf_dir)[0]


@query
def entry_constraints(spark, sf_dir):
    book, tally = scenarios(spark, sf_dir)
    net = book.where("gross is not null").groupBy("scenario").agg((F.avg(books.net_of_cost(5.0, 1.0)) * 1e4).alias("net_bp"))
    return net.join(tally, "scenario")


def selection(panel: DataFrame, per_date: int = 10, every: int = 4) -> DataFrame:
    """A held set: the largest volumes at every fourth date, kept until the next one."""
    r = F.row_number().over(W.partitionBy("t").orderBy(F.desc("dollar_volume"), "asset"))
    top = panel.where("mask").select("t", "asset", "dollar_volume").where(F.col("t") % every == 0).withColumn("r", r).where(F.col("r") <= per_date)
    held = top.select(F.explode(F.sequence("t", F.col("t") + every - 1)).alias("t"), "asset", F.lit(True).alias("sel"))
    return panel.join(held, ["t", "asset"], "left").withColumn("sel", F.coalesce("sel", F.lit(False)))


def held_book(spark, sf_dir) -> DataFrame:
    return books.drift_book(selection(supplier_panel(spark, sf_dir)), 5.0)


@query
def backtest_drift(spark, sf_dir):
    return held_book(spark, sf_dir)


@query
def perf_stats(spark, sf_dir):
    return books.perf(held_book(spark, sf_dir), 12).drop("mdd")


@query
def max_drawdown(spark, sf_dir):
    return books.perf(held_book(spark, sf_dir), 12).select("mdd")


@query
def yearly_increment(spark, sf_dir):
    return increment.yearly(monthly_books(spark, sf_dir))


@query
def increment_curves(spark, sf_dir):
    return increment.curves(monthly_books(spark, sf_dir))


@query
def increment_summary(spark, sf_dir):
    return increment.summary(monthly_books(spark, sf_dir), 12)


@query
def increment_per_trade(spark, sf_dir):
    return books.trade_metrics(increment.per_trade(monthly_books(spark, sf_dir), 3))


@query
def implausible_magnitude(spark, sf_dir):
    ic = daily_ic(spark, sf_dir).agg(F.avg("ic").alias("mean_ic"))
    b = base_book(spark, sf_dir).where("gross is not null").agg((F.avg("gross") * 1e4).alias("bp"), F.exp(F.sum(F.log1p("gross"))).alias("multiple"))
    both = ic.crossJoin(b)
    return both.select("mean_ic", "bp", "multiple", (F.abs("mean_ic") > 0.30).alias("ic_high"), (F.abs("bp") > 60).alias("bp_high"), (F.col("multiple") > 1000).alias("multiple_high"))


@query
def universe_provenance(spark, sf_dir):
    first = supplier_panel(spark, sf_dir).agg(F.min("date").alias("first_date"))
    return rules.launches(spark).crossJoin(first).select("universe", "launched", "first_date", (F.col("first_date") < F.col("launched")).alias("predates"))


def with_events(spark, sf_dir) -> DataFrame:
    p = labelled(spark, sf_dir)
    return p.withColumn("trigger", F.coalesce(F.col("signal") > 0.03, F.lit(False)))


@query
def event_hit_rate(spark, sf_dir):
    d = with_events(spark, sf_dir).where("trigger and mask and fwd is not null")
    real = d.agg(F.count(F.lit(1)).alias("n_events"), F.avg("fwd").alias("real"))
    return d.crossJoin(F.broadcast(real)).groupBy("n_events", "real").agg(F.avg((F.signum("fwd") == F.signum("real")).cast("double")).alias("hit_rate"))


@query
def user_activity_freshness(spark, sf_dir):
    return inputs.freshness(user_panel(spark, sf_dir), ["n", "value", "buys"])


@query
def null_full_shuffle(spark, sf_dir):
    return nulls.mean_ic_by_draw(nulls.full_shuffle(labelled(spark, sf_dir), DRAWS), min_n=MIN_N)


@query
def null_matched_buckets(spark, sf_dir):
    return nulls.mean_ic_by_draw(nulls.matched_shuffle(labelled(spark, sf_dir), ["size", "vol"], DRAWS, 3), min_n=MIN_N)


@query
def null_identity(spark, sf_dir):
    return nulls.mean_ic_by_draw(nulls.relabelled(labelled(spark, sf_dir), DRAWS, keep=["fwd", "mask"]), "mask", MIN_N)


@query
def null_identity_grouped(spark, sf_dir):
    return nulls.mean_ic_by_draw(nulls.relabelled(labelled(spark, sf_dir), DRAWS, group="grp", keep=["fwd", "mask"]), "mask", MIN_N)


@query
def null_events(spark, sf_dir):
    return nulls.random_events(with_events(spark, sf_dir), DRAWS)


def free_books(spark, sf_dir) -> DataFrame:
    s = selection(supplier_panel(spark, sf_dir)).select("t", "asset", "ret", "mask", "sel")
    dates = nulls.draws(s.select("t").distinct(), DRAWS)
    return books.drift_book(nulls.free_selection(s, DRAWS), 5.0, ["draw"], dates=dates, returns=s)


@query
def null_free_selection(spark, sf_dir):
    return books.perf(free_books(spark, sf_dir), 12, ["draw"]).select("draw", F.col("sharpe").alias("stat"))


@query
def matched_selection_null(spark, sf_dir):
    s = selection(supplier_panel(spark, sf_dir)).select("t", "asset", "ret", "mask", "sel")
    drawn = nulls.matched_selection(s, DRAWS).withColumn("sel", F.lit(True))
    book = books.drift_book(drawn, 5.0, ["draw"], dates=nulls.draws(s.select("t").distinct(), DRAWS), returns=s)
    return books.perf(book, 12, ["draw"]).select("draw", F.col("sharpe").alias("stat"))


@query
def random_selection_book(spark, sf_dir):
    p = supplier_panel(spark, sf_dir)
    counts = p.groupBy("t").agg(F.lit(10).alias("want"))
    return nulls.random_selection(p, counts, 5, hold=3).groupBy("draw", "t").agg(F.count(F.lit(1)).alias("n"))


def judged(draws_: DataFrame, real: DataFrame) -> DataFrame:
    return draws_.crossJoin(F.broadcast(real)).groupBy("real").agg(F.count("stat").alias("n_draws"), nulls.percentile_of(F.col("real")).alias("percentile"), nulls.empirical_p(F.col("real")).alias("p"), nulls.empirical_p(F.col("real"), two_sided=True).alias("p_two_sided"))


@query
def null_percentile(spark, sf_dir):
    real = daily_ic(spark, sf_dir).agg(F.avg("ic").alias("real"))
    return judged(nulls.mean_ic_by_draw(nulls.full_shuffle(labelled(spark, sf_dir), DRAWS), min_n=MIN_N), real).select("real", "n_draws", "percentile")


@query
def empirical_p(spark, sf_dir):
    p = with_events(spark, sf_dir)
    real = p.where("trigger and mask and fwd is not null").agg(F.avg("fwd").alias("real"))
    return judged(nulls.random_events(p, DRAWS), real).select("real", "p", "p_two_sided")


@query
def increment_null(spark, sf_dir):
    return increment.null_deltas(monthly_books(spark, sf_dir), DRAWS, 12)


@query
def tokenize_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", retrieval.tokenize(F.col("text")).alias("terms"))
    return d.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"))


@query
def bm25_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.bm25(d, "thinhely thnd eauouon heitag the ciónra")


@query
def prior_validation(spark, sf_dir):
    return retrieval.validate(rules.sample_priors(spark), taxonomy.modes(spark))


@query
def prior_checklist(spark, sf_dir):
    return retrieval.checklist(rules.sample_priors(spark), taxonomy.modes(spark))


@query
def verdict_fold(spark, sf_dir):
    return rules.fold(rules.sample_checks(spark, sf_dir))


@query
def taxonomy_coverage(spark, sf_dir):
    return taxonomy.coverage(spark)


@query
def taxonomy_uncovered(spark, sf_dir):
    return taxonomy.uncovered(spark)


@query
def knob_monotonicity(spark, sf_dir):
    """Rank correlation of a lookback with the IC it gives, in either half of the sample."""
    p = labelled(spark, sf_dir)
    d = labels.variants(p, "knob", "signal", {k: -labels.trailing_mean("ret", k) for k in (1, 2, 3, 4, 6)}, KEEP)
    ic = cross_section.rank_ic(d, min_n=MIN_N, by=["knob"]).where("ic is not null")
    ic = ic.withColumn("segment", F.when(F.col("t") < 42, "train").otherwise("valid"))
    return rules.knob_rho(ic.groupBy("segment", "knob").agg(F.avg("ic").alias("metric")))


@query
def rolling_fit_predict(spark, sf_dir):
    from ..operators.fit import RollingFit

    return RollingFit(features=("f1", "f2", "f3"), window=24, horizon=1, stride=3, min_n=20).predict(rules.feature_panel(supplier_panel(spark, sf_dir)))


@query
def truncation_rebuild(spark, sf_dir):
    from ..operators.fit import RollingFit

    fit = RollingFit(features=("f1", "f2", "f3"), window=24, horizon=1, stride=3, min_n=20)
    return fit.rebuild_difference(rules.feature_panel(supplier_panel(spark, sf_dir)), (39, 51, 63))


@query
def label_shuffle_refit(spark, sf_dir):
    from ..operators.fit import RollingFit

    fit = RollingFit(features=("f1", "f2", "f3"), window=24, horizon=1, stride=3, min_n=20)
    return fit.shuffled_ic(rules.feature_panel(supplier_panel(spark, sf_dir)), 5)
