"""A rolling ridge fit over a panel of features, with the rebuild and refit probes of the point-in-time audit."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import average_rank, inverse_normal
from .cross_section import rank_ic


@dataclass(frozen=True)
class RollingFit:
    """Ridge of the label's normal score on standardised features over a trailing window of dates.

    Training dates are (t - horizon - 1 - window, t - horizon - 1]: labels are known by t. ``contaminated``
    takes (t - window, t] and ``full_sample`` all dates but the first, planted defects; so is ``standardize="full-sample"``, which takes an
    asset's mean and deviation over all dates instead of the date's over all assets. A feature without spread is missing. A forecast exists only where
    the date has min_n rows with label and features, and so on rows with their own label. ``ridge`` is a share of the mean diagonal.
    """

    features: tuple[str, ...]
    window: int = 250
    horizon: int = 1
    stride: int = 10
    min_n: int = 30
    ridge: float = 1e-2
    mode: str = "causal"
    standardize: str = "cross-section"

    def rows(self, panel: DataFrame, by: list[str]) -> DataFrame:
        keys = [*by, "t"]
        w = W.partitionBy(*by, "asset" if self.standardize == "full-sample" else "t")
        d = panel
        for i, f in enumerate(self.features):
            z = (F.col(f) - F.avg(f).over(w)) / F.nullif(F.stddev_pop(f).over(w), F.lit(0.0))
            d = d.withColumn(f"z{i}_", z)
        z = [F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.col(f"z{i}_"))) for i in range(len(self.features))]
        ok = reduce(and_, [F.col(f"z{i}_").isNotNull() for i in range(len(self.features))], F.col("mask") & F.col("fwd").isNotNull())
        d = d.where(ok).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*keys))).where(F.col("n") >= self.min_n)
        d = d.withColumn("u", average_rank(keys, "fwd") / (F.col("n") + 1))
        return d.select(*keys, "asset", "n", inverse_normal(F.col("u")).alias("y"), F.array(F.lit(1.0), *z).alias("x"))

    def coefficients(self, rows: DataFrame, by: list[str], end: int) -> DataFrame:
        """(by.., t, beta): Gram sums of each date, summed over the window by a frame, solved in small tasks."""
        k = len(self.features) + 1
        keys = [*by, "t"]
        cells = [(i, j) for i in range(k) for j in range(i, k)]
        g = rows.groupBy(*keys).agg(*[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"g{i}_{j}") for i, j in cells], *[F.sum(F.col("x")[i] * F.col("y")).alias(f"c{i}") for i in range(k)], F.count(F.lit(1)).alias("m"))
        dates = g.select(*by).distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(end)))) if by else rows.sparkSession.range(end + 1).select(F.col("id").cast("int").alias("t"))
        g = dates.join(g, keys, "left")
        names = [c for c in g.columns if c not in keys]
        order = W.partitionBy(*by, F.lit(1)).orderBy("t")
        frame = {"causal": order.rowsBetween(-(self.window + self.horizon), -(self.horizon + 1)), "contaminated": order.rowsBetween(-self.window + 1, 0), "full_sample": order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)}[self.mode]
        seen = F.lit(self.mode != "full_sample") | (F.col("t") > 0)
        s = g.select(*keys, *[F.sum(F.when(seen, F.col(c))).over(frame).alias(c) for c in names])
        first = 0 if self.mode == "full_sample" else self.window + self.horizon + 2
        s = s.where((F.col("t") >= first) & ((F.col("t") - first) % self.stride == 0) & (F.col("m") >= 5 * self.min_n))
        ridge = self.ridge

        @F.pandas_udf("array<double>")
        def solve(pdf: pd.DataFrame) -> pd.Series:
            out = []
            for r in pdf.itertuples(index=False):
                a, c = np.zeros((k, k)), np.array([getattr(r, f"c{i}") for i in range(k)])
                for i, j in cells:
                    a[i, j] = a[j, i] = getattr(r, f"g{i}_{j}")
                size = np.trace(a[1:, 1:]) / max(k - 1, 1)
                reg = np.eye(k) * ridge * size
                reg[0, 0] = 0.0
                try:
                    out.append(np.linalg.solve(a + reg, c) if size > 0 else None)
                except np.linalg.LinAlgError:
                    out.append(None)
            return pd.Series(out)

        return s.select(*keys, solve(F.struct(*[c for c in names if c != "m"])).alias("beta")).where("beta is not null")

    def predict(self, panel: DataFrame, by: list[str] | None = None) -> DataFrame:
        """(by.., t, asset, signal)."""
        by = by or []
        end = panel.agg(F.max("t")).first()[0] or 0
        rows = self.rows(panel, by)
        beta = self.coefficients(rows, by, int(end))
        dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return rows.join(beta, [*by, "t"]).select(*by, "t", "asset", dot.alias("signal"))

    def recompute_at(self, panel: DataFrame, t: int) -> DataFrame:
        """The row of date t, from the panel up to t and, for the date's own gate, its labels."""
        return self.predict(panel.where(F.col("t") <= t)).where(F.col("t") == t)

    def probe_dates(self, panel: DataFrame, n: int = 12) -> list[int]:
        """n dates that carry a forecast, evenly spread."""
        ts = [r[0] for r in self.predict(panel).select("t").distinct().orderBy("t").collect()]
        return sorted({ts[round(i * (len(ts) - 1) / max(1, n - 1))] for i in range(n)}) if ts else []

    def refit(self, panel: DataFrame, labels: DataFrame) -> DataFrame:
        """The forecast from other labels (t, asset, fwd)."""
        return self.predict(panel.drop("fwd").join(labels, ["t", "asset"], "left"))

    def rebuild_difference(self, panel: DataFrame, probes: tuple[int, ...]) -> DataFrame:
        """(t, n, max_diff, n_appeared, n_vanished): published values against those rebuilt from history only."""
        full = self.predict(panel).where(F.col("t").isin(*probes)).select("t", "asset", F.col("signal").alias("a"))
        again = None
        for p in probes:
            r = self.recompute_at(panel, p).select("t", "asset", F.col("signal").alias("b"))
            again = r if again is None else again.unionAll(r)
        both = full.join(again, ["t", "asset"], "full")
        return both.groupBy("t").agg(F.count_if(F.expr("a is not null and b is not null")).alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff"), F.count_if(F.expr("a is null")).alias("n_appeared"), F.count_if(F.expr("b is null")).alias("n_vanished"))

    def shuffled_ic(self, panel: DataFrame, n_draws: int) -> DataFrame:
        """(draw, stat): refit on labels permuted within each date, scored against the same permuted labels; all draws in one job."""
        from .nulls import permuted

        carry = list(self.features)
        drawn = permuted(panel.where(F.col("mask") & F.col("fwd").isNotNull()).select("t", "asset", "fwd", *carry), n_draws, ["t"], "fwd", carry).withColumn("mask", F.lit(True))
        got = self.predict(drawn, ["draw"]).join(drawn.select("draw", "t", "asset", "fwd"), ["draw", "t", "asset"])
        return rank_ic(got, mask=None, min_n=self.min_n, by=["draw"]).groupBy("draw").agg(F.avg("ic").alias("stat"))
