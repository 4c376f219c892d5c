"""Statistics of series with one value a date. Series are small: one row a date and group."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def long_run_variance(e: str, n: Column, lags: Column) -> Column:
    """Variance with Bartlett weights from an array of demeaned values, in order."""

    def lag_sum(k: Column) -> Column:
        return F.aggregate(F.sequence(k, n - 1), F.lit(0.0), lambda acc, i: acc + F.get(F.col(e), i)["e"] * F.get(F.col(e), i - k)["e"])

    base = F.aggregate(F.col(e), F.lit(0.0), lambda acc, x: acc + x["e"] * x["e"]) / n
    more = F.aggregate(F.sequence(F.lit(1), lags), F.lit(0.0), lambda acc, k: acc + 2.0 * (1.0 - k / (lags + 1.0)) * lag_sum(k) / n)
    return base + F.when(lags >= 1, more).otherwise(0.0)


def summarise(ic: DataFrame, value: str = "ic", by: list[str] | None = None, horizon: int = 1, periods_per_year: int = 252, lags: int | None = None) -> DataFrame:
    """n, mean, std, icir, t_nw, n_eff, spacing of each series.

    Missing values are left out, so lags count observations. The cadence is the median gap between
    observations; overlap = max(1, horizon / cadence) gives n_eff = n / overlap and ceil(overlap) - 1
    lags, for which 0 means the automatic bandwidth floor(4 (n/100)^(2/9)). ``lags`` overrides. t_nw is NULL
    under 10 observations or without variance.
    """
    keys = by or []
    d = ic.where(F.col(value).isNotNull()).select(*keys, "t", F.col(value).alias("v")).withColumn("one_", F.lit(1))
    w = W.partitionBy("one_", *keys)
    d = d.withColumn("e", F.col("v") - F.avg("v").over(w)).withColumn("gap", F.col("t") - F.lag("t").over(w.orderBy("t")))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.greatest(F.coalesce(F.median("gap"), F.lit(1.0)), F.lit(1.0)).alias("spacing"),
        F.array_sort(F.collect_list(F.struct("t", "e"))).alias("es"),
    )
    g = g.where("n > 0").withColumn("overlap", F.greatest(F.lit(1.0), F.lit(float(horizon)) / F.col("spacing")))
    auto = F.floor(4.0 * F.pow(F.col("n") / 100.0, F.lit(2.0 / 9.0)))
    want = F.ceil("overlap") - 1 if lags is None else F.lit(lags)
    chosen = F.when(want > 0, want).otherwise(auto) if lags is None else want
    g = g.withColumn("lags", F.greatest(F.lit(0), F.least(chosen, F.col("n") - 2)).cast("int"))
    g = g.withColumn("var", F.when(F.col("n") >= 10, long_run_variance("es", F.col("n").cast("int"), F.col("lags"))))
    t = F.when(F.col("var") > 0, F.col("mean") / F.sqrt(F.col("var") / F.col("n")))
    icir = F.try_divide(F.col("mean"), F.nullif("std", F.lit(0.0))) * F.sqrt(F.lit(float(periods_per_year)) / F.greatest("spacing", F.lit(float(horizon))))
    return g.select(*keys, "n", "mean", "std", icir.alias("icir"), t.alias("t_nw"), (F.col("n") / F.col("overlap")).alias("n_eff"), "spacing")


def sampling(ic: DataFrame, horizon: int = 1, value: str = "ic") -> DataFrame:
    """n, spacing, overlap, n_eff, lags, period of one series."""
    d = ic.where(F.col(value).isNotNull()).select("t", (F.col("t") - F.lag("t").over(W.orderBy("t"))).alias("gap"))
    g = d.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.coalesce(F.median("gap"), F.lit(1.0)), F.lit(1.0)).alias("spacing"))
    g = g.withColumn("overlap", F.greatest(F.lit(1.0), F.lit(float(horizon)) / F.col("spacing")))
    return g.select("n", "spacing", "overlap", (F.col("n") / F.col("overlap")).alias("n_eff"), (F.ceil("overlap") - 1).cast("long").alias("lags"), F.greatest("spacing", F.lit(float(horizon))).alias("period"))


def halves(ic: DataFrame, parts: int = 2, value: str = "ic") -> DataFrame:
    """Mean and plain standard error of consecutive parts of a series: (part, n, mean, se)."""
    d = ic.where(F.col(value).isNotNull()).withColumn("part", F.ntile(parts).over(W.orderBy("t")))
    return d.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("se"))


def deflated_threshold(trials: int, alpha: float = 0.05) -> float:
    """|t| that ``trials`` candidates must clear: the two-sided normal quantile at alpha over their number."""
    return NormalDist().inv_cdf(1.0 - alpha / (2.0 * max(1, int(trials))))
