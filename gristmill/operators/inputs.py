"""Screens of a panel's inputs, run before anything is measured."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def unpivot(panel: DataFrame, columns: list[str]) -> DataFrame:
    """(input, t, asset, value): the inputs one below the other, in one pass."""
    return panel.select("t", "asset", F.explode(F.array(*[F.struct(F.lit(c).alias("input"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.input", "t", "asset", "x.value")


def flat_runs(panel: DataFrame, columns: list[str], share: float = 0.98) -> DataFrame:
    """(input, flat_share, is_static, run, start, end): the longest stretch over which nearly the whole panel repeats itself.

    A step is flat if at least ``share`` of the assets with a value on either side did not change; an input flat
    on 95% of its steps never moved and is static, without a run. start and end are the first step's origin and the last step's date.
    """
    d = unpivot(panel, columns)
    w = W.partitionBy("input", "asset").orderBy("t")
    d = d.withColumn("prev", F.lag("value").over(w)).where("t > 0")
    s = d.groupBy("input", "t").agg(F.count_if(F.expr("value is not null or prev is not null")).alias("live"), F.count_if(F.expr("value is not null and value <=> prev")).alias("same"))
    s = s.withColumn("flat", (F.col("live") > 0) & (F.col("same") >= share * F.col("live")))
    byi = W.partitionBy("input")
    s = s.withColumn("flat_share", F.avg(F.col("flat").cast("double")).over(byi)).withColumn("island", F.col("t") - F.row_number().over(W.partitionBy("input", "flat").orderBy("t")))
    runs = s.groupBy("input", "flat", "island").agg(F.count(F.lit(1)).alias("len"), F.min("t").alias("first"), F.max("t").alias("last"), F.first("flat_share").alias("flat_share"))
    best = runs.groupBy("input").agg(F.first("flat_share").alias("flat_share"), F.min(F.when(F.col("flat"), F.struct((-F.col("len")).alias("l"), F.col("first").alias("f"), F.col("last").alias("e")))).alias("m"))
    static = F.col("flat_share") >= 0.95
    return best.select("input", "flat_share", static.alias("is_static"), F.when(static, 0).otherwise(F.coalesce(-F.col("m.l"), F.lit(0))).cast("long").alias("run"), F.when(~static, F.col("m.f") - 1).cast("long").alias("start"), F.when(~static, F.col("m.e")).cast("long").alias("end"))


def freshness(panel: DataFrame, columns: list[str], horizon: int = 1, max_lag: int = 2) -> DataFrame:
    """(input, last_t, lag, cadence, allowed, stale): how far each input ends before the panel does."""
    end = panel.agg(F.max("t").alias("end"))
    live = unpivot(panel, columns).where("value is not null").select("input", "t").distinct()
    live = live.withColumn("gap", F.col("t") - F.lag("t").over(W.partitionBy("input").orderBy("t")))
    g = live.groupBy("input").agg(F.max("t").alias("last_t"), F.coalesce(F.floor(F.median("gap")), F.lit(1)).cast("long").alias("cadence")).crossJoin(F.broadcast(end))
    g = g.withColumn("lag", (F.col("end") - F.col("last_t")).cast("long")).withColumn("allowed", F.greatest(F.lit(max_lag), F.col("cadence") + horizon - 1).cast("long"))
    return g.select("input", F.col("last_t").cast("long").alias("last_t"), "lag", "cadence", "allowed", (F.col("lag") > F.col("allowed")).alias("stale"))


def spikes(panel: DataFrame, k: float = 6.0, revert: float = 0.6, ret: str = "ret") -> DataFrame:
    """(n_obs, n_bad, share): steps many robust deviations wide that the next step undoes."""
    med = panel.where(F.col(ret).isNotNull()).groupBy("asset").agg(F.median(ret).alias("med"))
    dev = panel.where(F.col(ret).isNotNull()).join(med, "asset").groupBy("asset").agg((1.4826 * F.median(F.abs(F.col(ret) - F.col("med")))).alias("scale"))
    d = panel.select("asset", F.col(ret).alias("a"), F.lead(ret).over(W.partitionBy("asset").orderBy("t")).alias("b")).where("a is not null and b is not null").join(dev, "asset")
    bad = (F.col("scale") > 0) & (F.abs("a") > k * F.col("scale")) & (F.signum("a") != F.signum("b")) & (F.abs("b") > revert * F.abs("a"))
    return d.agg(F.count(F.lit(1)).alias("n_obs"), F.count_if(bad).alias("n_bad")).withColumn("share", F.try_divide(F.col("n_bad").cast("double"), F.nullif("n_obs", F.lit(0)).cast("double")))


def sealed_rows(panel: DataFrame, columns: list[str], valid_end: date) -> DataFrame:
    """(input, n): dates after the seal's end on which an input carries a value; for booleans, is true. One pass."""
    kinds = dict(panel.dtypes)
    d = panel.where(F.col("date") > F.lit(valid_end))
    live = lambda c: F.col(c) if kinds[c] == "boolean" else F.col(c).isNotNull()
    one = d.agg(*[F.count_distinct(F.when(live(c), F.col("t"))).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("input"), F.col(c).alias("n")) for c in columns])).alias("x")).select("x.input", "x.n")


def redact(panel: DataFrame, columns: list[str], valid_end: date) -> DataFrame:
    """NULL (false for booleans) for everything after the seal's end."""
    kinds = dict(panel.dtypes)
    open_ = F.col("date") <= F.lit(valid_end)
    return panel.withColumns({c: F.col(c) & open_ if kinds[c] == "boolean" else F.when(open_, F.col(c)) for c in columns})
