"""Labels and shifts along time. Frames count rows, so the panel must be a dense grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

def in_time() -> W:
    return W.partitionBy("asset").orderBy("t")


def forward_return(h: int = 1, delay: int = 0, ret: str = "ret") -> Column:
    """Compounded return over the h steps after t + delay; NULL if one of them is missing or off the panel.

    A return of -1 wipes the position out (-1); below -1 there is no compounding (NULL).
    """
    w = in_time().rowsBetween(1 + delay, delay + h)
    low = F.min(ret).over(w)
    grown = F.exp(F.sum(F.log1p(F.when(F.col(ret) > -1, F.col(ret)))).over(w)) - 1
    return F.when(F.count(ret).over(w) == h, F.when(low > -1, grown).when(low == -1, F.lit(-1.0)))


def forward_returns(panel: DataFrame, h: int = 1, delay: int = 0, ret: str = "ret", out: str = "fwd") -> DataFrame:
    return panel.withColumn(out, forward_return(h, delay, ret))


def shifted(column: str, k: int) -> Column:
    """The value k steps later (earlier if negative)."""
    return F.lead(column, k).over(in_time()) if k >= 0 else F.lag(column, -k).over(in_time())


def variants(panel: DataFrame, name: str, value: str, columns: dict[int, Column], keep: list[str]) -> DataFrame:
    """One row for each cell and variant: all columns are windows of one sort, exploded at the end."""
    made = panel.select(*keep, *[c.alias(f"v{i}") for i, c in enumerate(columns.values())])
    pairs = F.array(*[F.struct(F.lit(k).alias(name), F.col(f"v{i}").alias(value)) for i, k in enumerate(columns)])
    return made.select(*keep, F.explode(pairs).alias("x")).select(*keep, f"x.{name}", f"x.{value}")


def trailing_control(ret: str = "ret", lookback: int = 5) -> Column:
    """The default positive control: minus the sum of the last returns, missing ones as 0; NULL on the first steps."""
    w = in_time().rowsBetween(-(lookback - 1), 0)
    return F.when(F.col("t") >= lookback - 1, -F.sum(F.coalesce(F.col(ret), F.lit(0.0))).over(w))


def trailing_mean(column: str, window: int, offset: int = 0) -> Column:
    """Mean of the window that ends offset steps from t, full windows only."""
    w = in_time().rowsBetween(-window + 1 + offset, offset)
    return F.when(F.count(column).over(w) == window, F.avg(column).over(w))


def ema(panel: DataFrame, column: str, span: float, out: str = "ema") -> DataFrame:
    """(t, asset, out): the recursive mean a x + (1 - a) before, a = 2 / (span + 1), from an asset's first value on; missing values keep it. One task an asset."""
    kinds, a = dict(panel.dtypes), 2.0 / (span + 1.0)

    def fold(g):
        g, last, got = g.sort_values("t"), None, []
        for x in g[column]:
            if x == x and x is not None:
                last = x if last is None else a * x + (1 - a) * last
            got.append(last)
        return g[["t", "asset"]].assign(**{out: got}).astype({out: "float64"})

    return panel.select("t", "asset", column).groupBy("asset").applyInPandas(fold, f"t {kinds['t']}, asset {kinds['asset']}, {out} double")
