"""What an addition to a book adds: series of one row a period (t, date, baseline, combined, benchmark)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import compounded


def excess(s: Column, b: Column) -> Column:
    """(1 + s) / (1 + b) - 1, missing returns as 0."""
    return (1 + F.coalesce(s, F.lit(0.0))) / (1 + F.coalesce(b, F.lit(0.0))) - 1


def with_excess(books: DataFrame) -> DataFrame:
    return books.withColumn("base", excess(F.col("baseline"), F.col("benchmark"))).withColumn("comb", excess(F.col("combined"), F.col("benchmark")))


def curves(books: DataFrame) -> DataFrame:
    """(t, date, baseline_nav, combined_nav): compounded excess."""
    w = W.orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    nav = lambda c: F.exp(F.sum(F.log1p(c)).over(w))
    return with_excess(books).select("t", "date", nav("base").alias("baseline_nav"), nav("comb").alias("combined_nav"))


def yearly(books: DataFrame) -> DataFrame:
    """(year, baseline, combined, delta): compounded excess of each year."""
    g = with_excess(books).groupBy(F.year("date").alias("year")).agg(compounded(F.col("base")).alias("baseline"), compounded(F.col("comb")).alias("combined"))
    return g.withColumn("delta", F.col("combined") - F.col("baseline"))


def per_trade(books: DataFrame, every: int) -> DataFrame:
    """Compounded difference of the two books over blocks of ``every`` periods, in basis points: (block, bp)."""
    g = with_excess(books).groupBy(F.floor(F.col("t") / every).alias("block")).agg(compounded(F.col("base")).alias("b"), compounded(F.col("comb")).alias("c"))
    return g.select("block", ((F.col("c") - F.col("b")) * 1e4).alias("bp"))


def annual_delta(books: DataFrame, periods_per_year: int, by: list[str] | None = None) -> DataFrame:
    n = F.count(F.lit(1)) / float(periods_per_year)
    ann = lambda c: F.exp(F.sum(F.log1p(c)) / n) - 1
    return with_excess(books).groupBy(*(by or [])).agg(ann("base").alias("baseline_ann"), ann("comb").alias("combined_ann")).withColumn("delta_ann", F.col("combined_ann") - F.col("baseline_ann"))


def summary(books: DataFrame, periods_per_year: int = 252) -> DataFrame:
    """Annual excess of both books, years improved, losing years before and after, and the best year's share of the gain."""
    y = yearly(books).agg(
        F.count(F.lit(1)).alias("years"), F.count_if(F.col("delta") > 0).alias("years_improved"), F.count_if(F.col("baseline") < 0).alias("negative_baseline"), F.count_if(F.col("combined") < 0).alias("negative_combined"),
        F.try_divide(F.max("delta"), F.nullif(F.sum(F.greatest("delta", F.lit(0.0))), F.lit(0.0))).alias("top_year_share"),
    )
    return annual_delta(books, periods_per_year).crossJoin(y)


def null_deltas(books: DataFrame, n_draws: int, periods_per_year: int) -> DataFrame:
    """(draw, stat): annual delta if the addition's contribution is dealt to the periods at random."""
    d = books.withColumn("add", F.coalesce("combined", F.lit(0.0)) - F.coalesce("baseline", F.lit(0.0)))
    d = d.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    i = F.row_number().over(W.partitionBy("draw").orderBy("t"))
    j = F.row_number().over(W.partitionBy("draw").orderBy(F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.col("t").cast("string")))))
    d = d.withColumn("i", i).withColumn("j", j)
    mixed = d.drop("add", "j").join(d.select("draw", F.col("j").alias("i"), "add"), ["draw", "i"])
    return annual_delta(mixed.withColumn("combined", F.coalesce("baseline", F.lit(0.0)) + F.col("add")), periods_per_year, ["draw"]).select("draw", F.col("delta_ann").alias("stat"))


def render_yearly(books: DataFrame) -> str:
    """The yearly table as text, a line a year."""
    out = ["year   baseline  combined     delta"]
    for r in yearly(books).orderBy("year").collect():  # one row a year
        out.append(f"{r.year}  {r.baseline:+9.2%} {r.combined:+9.2%} {r.delta:+9.2%}")
    return "\n".join(out)
