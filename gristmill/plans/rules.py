"""Small dimension tables and rules that queries and checks share."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import average_rank, safe_corr
from ..operators import cross_section, labels
from ..sources.panel import supplier_panel
from ..sources.priors import PRIOR_SCHEMA

# fixed values: first trading days of index universes
LAUNCHES = (
    ("csi_300", date(2005, 4, 8)),
    ("csi_500", date(2007, 1, 15)),
    ("csi_1000", date(2014, 10, 17)),
    ("csi_2000", date(2023, 8, 11)),
    ("csi_a500", date(2024, 9, 23)),
    ("cybz", date(2010, 6, 1)),
)


def launches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LAUNCHES), "universe string, launched date")


def sample_priors(spark: SparkSession) -> DataFrame:
    """Seven made-up records, most with a fault that validation must name."""
    fine = ("the book lost to a random one of equal turnover", "match turnover before believing a percentile")
    rows = [
        ("p1", "rotation beats the index", "REJECTED", ["null-turnover-unmatched", "cost-eats-it"], *fine, [], "a", "2020-01-01", "", "", "", ""),
        ("p2", "sentiment leads price", "REJECTED", ["leak-alignment-offset"], *fine, ["text"], "a", "2020-02-01", "", "", "", ""),
        ("p3", "no cause given", "REJECTED", [], *fine, [], "b", "2020-03-01", "", "", "", ""),
        ("p4", "unknown cause", "REJECTED", ["not-a-mode"], *fine, [], "b", "2020-04-01", "", "", "", ""),
        ("p5", "thin record", "SURVIVES", [], "short", "short", [], "c", "2020-05-01", "", "", "", ""),
        ("p2", "the same id again", "SURVIVES", [], *fine, [], "c", "2020-06-01", "", "", "", ""),
        ("p6", "taken back", "REJECTED", ["cost-eats-it"], *fine, [], "d", "2020-07-01", "", "misread", "p9", "2020-08-01"),
        ("p7", "replaced, not withdrawn", "REJECTED", ["cost-eats-it"], *fine, [], "d", "2020-07-02", "", "", "p1", ""),
    ]
    return spark.createDataFrame(rows, PRIOR_SCHEMA)


def sample_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four claims, a signal with different signs and delays, each with a power and a direction check."""
    p = labels.forward_returns(supplier_panel(spark, sf_dir), 1)
    signals = {0: F.col("signal"), 1: -F.col("signal"), 2: labels.shifted("signal", -1), 3: F.lit(None).cast("double")}
    d = labels.variants(p, "claim", "signal", signals, ["t", "asset", "mask", "fwd"])
    ic = cross_section.rank_ic(d, min_n=30, by=["claim"]).groupBy("claim").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), (F.stddev_samp("ic") / F.sqrt(F.count("ic"))).alias("se"))
    ic = spark.range(4).select(F.col("id").cast("int").alias("claim")).join(ic, "claim", "left")
    t = F.try_divide(F.col("mean"), F.nullif("se", F.lit(0.0)))
    power = F.struct(F.lit("S6").alias("id"), F.lit(True).alias("blocking"), F.when(F.abs(t) >= 3, "PASS").otherwise("INCONCLUSIVE").alias("outcome"))
    sign = F.struct(F.lit("S4").alias("id"), (F.col("claim") != 2).alias("blocking"), F.when(t.isNull(), "NA").when(t >= 2, "PASS").otherwise("FAIL").alias("outcome"))
    return ic.select("claim", F.explode(F.array(power, sign)).alias("c")).select("claim", "c.id", "c.blocking", "c.outcome")


def fold(checks: DataFrame) -> DataFrame:
    """(claim, outcome, killers) of check rows (claim, id, blocking, outcome).

    A blocking FAIL rejects; else a blocking INCONCLUSIVE, or no blocking PASS at all, leaves the claim undecided.
    """
    hit = lambda what: F.bool_or(F.col("blocking") & (F.col("outcome") == what))
    g = checks.groupBy("claim").agg(hit("FAIL").alias("f"), hit("INCONCLUSIVE").alias("i"), hit("PASS").alias("p"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("blocking") & (F.col("outcome") == "FAIL"), F.col("id")))), ",").alias("killers"))
    return g.select("claim", F.when(F.col("f"), "REJECTED").when(F.col("i") | ~F.col("p"), "INCONCLUSIVE").otherwise("SURVIVES").alias("outcome"), "killers")


def knob_rho(curve: DataFrame) -> DataFrame:
    """(segment, n, rho): rank correlation of a knob's settings with the metric they give."""
    d = curve.where("metric is not null").select("segment", average_rank(["segment"], "knob").alias("a"), average_rank(["segment"], "metric").alias("b"))
    return d.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("a"), F.col("b")).alias("rho"))


def feature_panel(panel: DataFrame) -> DataFrame:
    """Three trailing means of the signal as features, and the one-step label."""
    return panel.select("t", "asset", "mask", labels.trailing_mean("signal", 1).alias("f1"), labels.trailing_mean("signal", 2).alias("f2"), labels.trailing_mean("signal", 3).alias("f3"), labels.forward_return(1).alias("fwd"))




