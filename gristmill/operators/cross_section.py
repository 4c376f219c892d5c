"""Statistics across the assets of one date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import average_rank, bucket, inverse_normal, safe_corr


def rank_ic(df: DataFrame, signal: str = "signal", fwd: str = "fwd", mask: str | None = "mask", min_n: int = 30, by: list[str] | None = None) -> DataFrame:
    """Rank correlation of signal and label for each date: (by.., t, n, ic).

    Dates with fewer than min_n usable assets are absent; ic is NULL where a side has no variance.
    """
    keys = [*(by or []), "t"]
    ok = F.col(signal).isNotNull() & F.col(fwd).isNotNull()
    d = df.where(ok & F.col(mask) if mask else ok).select(*keys, F.col(signal).alias("s_"), F.col(fwd).alias("f_"))
    d = d.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*keys))).where(F.col("n") >= min_n)
    d = d.select(*keys, "n", average_rank(keys, "s_").alias("rs"), average_rank(keys, "f_").alias("rf"))
    return d.groupBy(*keys).agg(F.first("n").alias("n"), safe_corr(F.col("rs"), F.col("rf")).alias("ic"))


def zscore(df: DataFrame, column: str, out: str = "z", clip: float = 5.0) -> DataFrame:
    """Standard score within the date, clipped; NULL where the date has no variance."""
    w = W.partitionBy("t")
    z = F.try_divide(F.col(column) - F.avg(column).over(w), F.nullif(F.stddev_pop(column).over(w), F.lit(0.0)))
    return df.withColumn("z_", z).withColumn(out, F.when(F.col("z_").isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col("z_"))))).drop("z_")


def normal_score(df: DataFrame, column: str, out: str = "score") -> DataFrame:
    """Inverse normal of average rank over n + 1, within the date; rows without a value are dropped."""
    d = df.where(F.col(column).isNotNull())
    n = F.count(F.lit(1)).over(W.partitionBy("t"))
    return d.withColumn("u_", average_rank(["t"], column) / (n + 1)).withColumn(out, inverse_normal(F.col("u_"))).drop("u_")


def buckets(df: DataFrame, column: str, n_buckets: int, keys: list[str] | None = None, out: str = "bucket") -> DataFrame:
    """Equal-count buckets by rank within keys; ties are broken by asset."""
    keys = keys or ["t"]
    r = F.row_number().over(W.partitionBy(*keys).orderBy(column, "asset")) - 1
    return df.withColumn(out, bucket(r, F.count(F.lit(1)).over(W.partitionBy(*keys)), n_buckets))


def residual(df: DataFrame, signal: str, control: str, min_extra: int = 5, mask: str = "mask") -> DataFrame:
    """Residual of the signal against one control and a constant, within the date, as column residual.

    Dates with fewer than 1 + min_extra rows are absent; without variance in the control the residual is signal minus its mean.
    """
    d = df.where(F.col(signal).isNotNull() & F.col(control).isNotNull() & F.col(mask))
    w = W.partitionBy("t")
    d = d.withColumn("n_", F.count(F.lit(1)).over(w)).where(F.col("n_") >= 1 + min_extra)
    d = d.withColumn("my", F.avg(signal).over(w)).withColumn("mx", F.avg(control).over(w)).withColumn("sl", F.coalesce(F.try_divide(F.covar_pop(signal, control).over(w), F.nullif(F.var_pop(control).over(w), F.lit(0.0))), F.lit(0.0)))
    return d.withColumn("residual", F.col(signal) - F.col("my") - F.col("sl") * (F.col(control) - F.col("mx"))).drop("n_", "my", "mx", "sl")


def residual_many(df: DataFrame, signal: str, controls: list[str], mask: str = "mask") -> DataFrame:
    """Residual against several controls: (t, asset, residual), by least squares of minimal norm in one task a date."""
    ok: Column = F.col(mask) & F.col(signal).isNotNull()
    for c in controls:
        ok = ok & F.col(c).isNotNull()

    def fit(g):
        import numpy as np

        if len(g) < len(controls) + 5:
            return g.iloc[:0][["t", "asset"]].assign(residual=0.0)
        x = np.column_stack([np.ones(len(g)), *[g[c].to_numpy(float) for c in controls]])
        y = g[signal].to_numpy(float)
        return g[["t", "asset"]].assign(residual=y - x @ np.linalg.lstsq(x, y, rcond=None)[0])

    kinds = dict(df.dtypes)
    return df.where(ok).select("t", "asset", signal, *controls).groupBy("t").applyInPandas(fit, f"t {kinds['t']}, asset {kinds['asset']}, residual double")


def common_share(df: DataFrame, column: str = "fwd", min_n: int = 20, mask: str = "mask") -> DataFrame:
    """How much of each date's variation the market is: mean squared over mean of squares (t, share)."""
    g = df.where(F.col(mask) & F.col(column).isNotNull()).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("m"), F.avg(F.col(column) * F.col(column)).alias("m2"))
    return g.where((F.col("n") >= min_n) & (F.col("m2") > 0)).select("t", (F.col("m") * F.col("m") / F.col("m2")).alias("share"))


def label_persistence(df: DataFrame, fwd: str = "fwd", mask: str = "mask", min_n: int = 30) -> DataFrame:
    """Rank correlation of adjacent dates' labels over the assets usable on both: (t, n, rho)."""
    time = W.partitionBy("asset").orderBy("t")
    d = df.select("t", "asset", F.col(fwd).alias("a_"), F.col(mask).alias("m0"), F.lead(fwd).over(time).alias("b_"), F.lead(mask).over(time).alias("m1"))
    d = d.where("m0 and m1 and a_ is not null and b_ is not null").withColumn("n", F.count(F.lit(1)).over(W.partitionBy("t"))).where(F.col("n") >= min_n)
    d = d.select("t", "n", average_rank(["t"], "a_").alias("ra"), average_rank(["t"], "b_").alias("rb"))
    return d.groupBy("t").agg(F.first("n").alias("n"), safe_corr(F.col("ra"), F.col("rb")).alias("rho"))


def bucket_means(df: DataFrame, n_buckets: int = 10, min_n: int = 30, signal: str = "signal", fwd: str = "fwd", mask: str = "mask") -> DataFrame:
    """Pooled mean label of each rank bucket: (bucket, n, mean)."""
    d = df.where(F.col(signal).isNotNull() & F.col(fwd).isNotNull() & F.col(mask)).withColumn("n_", F.count(F.lit(1)).over(W.partitionBy("t"))).where(F.col("n_") >= min_n)
    return buckets(d, signal, n_buckets).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(fwd).alias("mean"))
