"""Freshness and staleness of panel inputs on a stream of cells, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_SCHEMA = "ts timestamp, asset long, input string, value double"


def live_counts(cells: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, input, n, distinct values seen, newest): a window's row is final once the watermark passes it.

    cells: streaming or static rows of CELL_SCHEMA. NaN, infinities and NULL are missing. State is a row for each
    open window and input.
    """
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    return (
        cells.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("window"), "input")
        .agg(F.count_if(ok).alias("n"), F.approx_count_distinct(F.when(ok, F.col("value"))).alias("n_distinct"), F.max(F.when(ok, F.col("ts"))).alias("newest"))
    )


def stale_windows(counts: DataFrame, max_flat_share: float = 0.02) -> DataFrame:
    """Windows in which an input brought nothing, or nearly one value for all assets."""
    return counts.where((F.col("n") == 0) | ((F.col("n") > 1) & (F.col("n_distinct") <= F.greatest(F.lit(1.0), F.col("n") * max_flat_share))))
