"""Panels: a dense grid of dates and assets, one row a cell, and adapters that derive them from fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import finite

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(facts: DataFrame, assets: DataFrame, date: str = "date", asset: str = "asset") -> DataFrame:
    """Every date with every asset: frames of windows count rows, so no cell may be absent.

    t numbers the dates from 0. The grid is the output's own size; only the list of dates, one row a date,
    is broadcast, after its size is known.
    """
    dates = facts.select(date).distinct()
    dates = dates.withColumn("t", (F.row_number().over(W.orderBy(date)) - 1).cast("int"))
    cells = assets.crossJoin(dates)
    return cells.join(facts, [date, asset], "left")


def ratio_return(px: Column, before: Column) -> Column:
    """A bounded return from two prices: a tenth of their difference over their sum."""
    return 0.1 * (px - before) / (px + before)


def with_returns(cells: DataFrame) -> DataFrame:
    px = F.col("dollar_volume") / F.col("quantity")
    out = cells.withColumn("px", px).withColumn("ret", ratio_return(F.col("px"), F.lag("px").over(W.partitionBy("asset").orderBy("t"))))
    return out.withColumn("signal", -F.col("ret")).withColumn("vol", F.abs("ret")).withColumn("mask", F.col("dollar_volume").isNotNull())


def supplier_panel(spark: SparkSession, sf_dir: str, step: str = "month") -> DataFrame:
    """Suppliers by month or week: t, date, asset, grp, size, dollar_volume, px, ret, signal, vol, mask."""
    li = table(spark, sf_dir, "lineitem")
    cells = li.groupBy(F.col("l_suppkey").alias("asset"), F.to_date(F.date_trunc(step, "l_shipdate")).alias("date")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("dollar_volume"), F.sum("l_quantity").alias("quantity")
    )
    assets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), F.col("s_nationkey").alias("grp"), F.col("s_acctbal").alias("size"))
    return with_returns(grid(cells, assets)).drop("quantity")


def part_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by quarter."""
    li = table(spark, sf_dir, "lineitem")
    cells = li.groupBy(F.col("l_partkey").alias("asset"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("date")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("dollar_volume"), F.sum("l_quantity").alias("quantity")
    )
    assets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset"), F.col("p_size").alias("grp"), F.col("p_retailprice").alias("size"))
    return with_returns(grid(cells, assets)).drop("quantity")


def user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by day: t, date, asset, n, value, buys."""
    ev = table(spark, sf_dir, "events")
    cells = ev.groupBy(F.col("user_id").alias("asset"), F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.count_if(F.col("event_type") == "purchase").alias("buys"))
    return grid(cells, ev.select(F.col("user_id").alias("asset")).distinct())


def clean(df: DataFrame, *columns: str) -> DataFrame:
    """NaN and infinities of a supplied panel become NULL."""
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def monthly_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three return series by month from order totals: t, date, baseline, combined, benchmark."""
    o = table(spark, sf_dir, "orders")
    month = F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")
    m = o.groupBy(month).agg(F.avg("o_totalprice").alias("a"), F.avg(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_totalprice"))).alias("b"), F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("c"))
    w = W.orderBy("date")
    r = lambda x: ratio_return(F.col(x), F.lag(x).over(w))
    out = m.select("date", (F.row_number().over(w) - 1).cast("int").alias("t"), r("a").alias("benchmark"), r("b").alias("baseline"), r("c").alias("c"))
    return out.select("t", "date", "baseline", F.coalesce((F.col("baseline") + F.col("c")) / 2, "baseline").alias("combined"), "benchmark").where("t > 0")
