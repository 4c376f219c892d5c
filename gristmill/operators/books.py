"""Portfolios built from a panel and priced net of cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def usable_counts(df: DataFrame, by: list[str], signal: str, mask: str) -> DataFrame:
    return df.groupBy(*by, "t").agg(F.count_if(F.col(signal).isNotNull() & F.col(mask)).alias("n"))


def schedule(counts: DataFrame, by: list[str], hold: int, min_n: int) -> DataFrame:
    """Greedy rebalance dates (by.., j, t, n, next): the first usable date, then the first one at least ``hold`` later, and so on.

    A fold over the sorted dates of one group, which are as many as the panel has.
    """
    last = F.max("t").over(W.partitionBy(*by)) if by else F.max("t").over(W.partitionBy(F.lit(1)))
    c = counts.withColumn("end", last)
    g = c.groupBy(*by).agg(F.array_sort(F.collect_list(F.when((F.col("n") >= min_n) & (F.col("t") < F.col("end")), F.struct("t", "n")))).alias("ts"), F.first("end").alias("end"))
    kind = dict(g.dtypes)["ts"]
    start = F.struct(F.lit(-(10**9)).alias("last"), F.array().cast(kind).alias("got"))
    step = lambda a, x: F.when(x["t"] - a["last"] >= hold, F.struct(x["t"].alias("last"), F.concat(a["got"], F.array(x)).alias("got"))).otherwise(a)
    picked = g.select(*by, "end", F.posexplode(F.aggregate("ts", start, step)["got"]).alias("j", "x"))
    nxt = F.lead("x.t").over(W.partitionBy(*by, F.lit(1)).orderBy("j"))
    return picked.select(*by, "j", "x.t", "x.n", F.coalesce(nxt, F.col("end")).alias("next"))


def quantile_weights(df: DataFrame, reb: DataFrame, by: list[str], q: float, long_short: bool, signal: str, mask: str) -> DataFrame:
    """(by.., j, t, next, asset, w): the k = max(1, floor(n q)) largest signals at 1/k, the k smallest at -1/k; ties by asset."""
    keys = [*by, "t"]
    d = df.where(F.col(signal).isNotNull() & F.col(mask)).select(*keys, "asset", F.col(signal).alias("s_")).join(reb, keys)
    r = F.row_number().over(W.partitionBy(*keys).orderBy("s_", "asset"))
    k = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(q)))
    d = d.withColumn("r", r).withColumn("k", k).withColumn("w", F.when(F.lit(long_short) & (F.col("r") <= F.col("k")), -1.0 / F.col("k")).when(F.col("r") > F.col("n") - F.col("k"), 1.0 / F.col("k")))
    return d.where("w is not null").select(*by, "j", "t", "next", "asset", "w", "k")


def priced(df: DataFrame, weights: DataFrame, by: list[str], ret: str, per_date: int = 1) -> DataFrame:
    """(by.., t, gross, turnover): constant weights between rebalances, return of the next step, missing ones as 0.

    Dates before the first rebalance earn 0; the last date has no return.
    """
    dates = df.select(*by, "t").distinct().withColumn("end", F.max("t").over(W.partitionBy(*by, F.lit(1))))
    held = weights.select(*by, "asset", "w", F.explode(F.sequence(F.col("t"), F.col("next") - 1)).alias("t"))
    r = df.select(*by, (F.col("t") - 1).alias("t"), "asset", F.coalesce(F.col(ret), F.lit(0.0)).alias("r_"))
    gross = held.join(r, [*by, "t", "asset"]).groupBy(*by, "t").agg(F.sum(F.col("w") * F.col("r_")).alias("g"))
    legs = weights.select(*by, "j", "asset", "w").unionAll(weights.select(*by, (F.col("j") + 1).alias("j"), "asset", (-F.col("w")).alias("w")))
    turn = legs.groupBy(*by, "j", "asset").agg(F.sum("w").alias("d")).groupBy(*by, "j").agg((F.sum(F.abs("d")) / 2.0).alias("turnover"))
    at = weights.select(*by, "j", "t").distinct().join(turn, [*by, "j"]).select(*by, "t", "turnover")
    out = dates.join(gross, [*by, "t"], "left").join(at, [*by, "t"], "left")
    return out.select(*by, "t", F.when(F.col("t") < F.col("end"), F.coalesce("g", F.lit(0.0))).alias("gross"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def quantile_book(df: DataFrame, q: float = 0.1, hold: int = 1, long_short: bool = True, min_n: int = 30, by: list[str] | None = None, signal: str = "signal", ret: str = "ret", mask: str = "mask") -> DataFrame:
    """Equal-weight quantile book of each group: (by.., t, gross, turnover)."""
    by = by or []
    reb = schedule(usable_counts(df, by, signal, mask), by, hold, min_n)
    return priced(df, quantile_weights(df, reb, by, q, long_short, signal, mask), by, ret)


def leg_weights(df: DataFrame, reb: DataFrame, by: list[str], q: float, long_short: bool, buyable: str, shortable: str, signal: str = "signal", mask: str = "mask") -> tuple[DataFrame, DataFrame]:
    """Weights where each leg walks its ranking past what it cannot enter, until k are filled; and (by.., wanted, blocked).

    The weight stays 1/k if a leg comes out short. Names passed before a leg is full count as blocked.
    """
    keys = [*by, "t"]
    d = df.where(F.col(signal).isNotNull() & F.col(mask)).select(*keys, "asset", F.col(signal).alias("s_"), F.coalesce(F.col(buyable), F.lit(True)).alias("b_"), F.coalesce(F.col(shortable), F.lit(True)).alias("sh_")).join(reb, keys)
    d = d.withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(q))))
    run = lambda c, *order: F.count_if(c).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("lr", run(F.col("b_"), F.desc("s_"), F.desc("asset"))).withColumn("sr", run(F.col("sh_"), "s_", "asset"))
    long = F.col("b_") & (F.col("lr") <= F.col("k"))
    short = F.lit(long_short) & F.col("sh_") & (F.col("sr") <= F.col("k"))
    w = d.withColumn("w", F.when(short, -1.0 / F.col("k")).when(long, 1.0 / F.col("k")))
    miss = F.count_if(~F.col("b_") & (F.col("lr") < F.col("k"))) + (F.count_if(~F.col("sh_") & (F.col("sr") < F.col("k"))) if long_short else F.lit(0))
    per = d.groupBy(*keys).agg(F.first("k").alias("k"), miss.alias("miss"))
    tally = per.groupBy(*by).agg((F.sum("k") * (2 if long_short else 1)).alias("wanted"), F.sum("miss").alias("blocked"))
    return w.where("w is not null").select(*by, "j", "t", "next", "asset", "w", "k"), tally


def entry_scenarios(df: DataFrame, price_limit: float, min_dollar_volume: float | None, ret: str = "ret", mask: str = "mask", volume: str = "dollar_volume") -> DataFrame:
    """One copy of the panel for each scenario: free, locked (prints at the limit), locked with a liquidity floor."""
    r = F.coalesce(F.col(ret), F.lit(0.0))
    names = ["free", "locked", *(["floor"] if min_dollar_volume else [])]
    d = df.withColumn("scenario", F.explode(F.array(*[F.lit(n) for n in names])))
    bound = F.col("scenario") != "free"
    d = d.withColumn("buyable", ~bound | (r < price_limit)).withColumn("shortable", ~bound | (r > -price_limit))
    if min_dollar_volume:
        d = d.withColumn(mask, F.col(mask) & ((F.col("scenario") != "floor") | (F.coalesce(F.col(volume), F.lit(0.0)) >= min_dollar_volume)))
    return d


def leg_aware_book(df: DataFrame, q: float, hold: int, min_n: int, long_short: bool = True, by: list[str] | None = None, ret: str = "ret") -> tuple[DataFrame, DataFrame]:
    by = by or []
    reb = schedule(usable_counts(df, by, "signal", "mask"), by, hold, min_n)
    w, tally = leg_weights(df, reb, by, q, long_short, "buyable", "shortable")
    return priced(df, w, by, ret), tally


def net_of_cost(cost_bp: float, legs: float = 2.0) -> Column:
    return F.col("gross") - F.col("turnover") * (legs * cost_bp / 1e4)


def cost_gate(book: DataFrame, cost_bp: float, periods_per_year: int = 252, by: list[str] | None = None) -> DataFrame:
    """(by.., n, ann_gross, ann_net, ann_turnover, breakeven_bp, ir_net) over the dates with a return."""
    b = book.where("gross is not null").withColumn("net", net_of_cost(cost_bp))
    ny = F.count(F.lit(1)) / float(periods_per_year)
    ann = lambda c: F.exp(F.sum(F.log1p(c)) / ny) - 1
    sd = F.nullif(F.stddev_samp("net"), F.lit(0.0))
    return b.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), ann("gross").alias("ann_gross"), ann("net").alias("ann_net"), (F.avg("turnover") * periods_per_year).alias("ann_turnover"),
        (F.try_divide(F.avg("gross"), F.nullif(F.avg("turnover"), F.lit(0.0))) * 1e4 / 2.0).alias("breakeven_bp"), (F.try_divide(F.avg("net"), sd) * F.sqrt(F.lit(float(periods_per_year)))).alias("ir_net"),
    )


def trade_metrics(blocks: DataFrame, value: str = "bp") -> DataFrame:
    """n, win_rate, avg_bp, payoff_ratio, profit_factor, worst_bp, top5_share; ratios without a loss are NULL (infinite)."""
    v = F.col(value)
    win, loss = F.when(v > 0, v), F.when(v < 0, v)
    ranked = blocks.where(v.isNotNull()).withColumn("r_", F.row_number().over(W.orderBy(F.desc(value))))
    total = F.sum(v)
    return ranked.agg(
        F.count(v).alias("n_trades"), F.avg((v > 0).cast("double")).alias("win_rate"), F.avg(v).alias("avg_bp"), F.try_divide(F.avg(win), F.abs(F.avg(loss))).alias("payoff_ratio"),
        F.try_divide(F.sum(win), F.abs(F.sum(loss))).alias("profit_factor"), F.min(v).alias("worst_bp"),
        F.when((F.count(v) > 5) & (total > 1.0), F.sum(F.when(F.col("r_") <= 5, v)) / total).alias("top5_share"),
    )


def blocks(book: DataFrame, cost_bp: float) -> DataFrame:
    """Net P&L in basis points from one rebalance (turnover above 0) to the next: (block, bp)."""
    net = F.coalesce("gross", F.lit(0.0)) - F.col("turnover") * (2.0 * cost_bp / 1e4)
    seg = F.sum((F.col("turnover") > 0).cast("int")).over(W.orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    return book.select(net.alias("net"), seg.alias("block")).where("block > 0").groupBy("block").agg((F.sum("net") * 1e4).alias("bp"))


def capacity(df: DataFrame, q: float = 0.1, hold: int = 1, participation: float = 0.1, min_n: int = 30, signal: str = "signal", mask: str = "mask", volume: str = "dollar_volume") -> DataFrame:
    """(n_rebalances, capacity_median, capacity_p10): least volume of both legs times participation and k, every ``hold``-th date."""
    last = df.agg(F.max("t").alias("end"))
    d = df.crossJoin(F.broadcast(last)).where((F.col("t") < F.col("end")) & (F.col("t") % hold == 0) & F.col(mask) & F.col(signal).isNotNull() & (F.col(volume) > 0))
    w = W.partitionBy("t")
    d = d.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= min_n).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(q)))).withColumn("r", F.row_number().over(w.orderBy(signal, "asset")))
    legs = d.where((F.col("r") <= F.col("k")) | (F.col("r") > F.col("n") - F.col("k"))).groupBy("t").agg((F.min(volume) * participation * F.first("k")).alias("cap"))
    return legs.agg(F.count(F.lit(1)).alias("n_rebalances"), F.median("cap").alias("capacity_median"), F.percentile("cap", F.lit(0.1)).alias("capacity_p10"))


def drift_book(selection: DataFrame, cost_bp: float, by: list[str] | None = None, sel: str = "sel", ret: str = "ret", dates: DataFrame | None = None, returns: DataFrame | None = None) -> DataFrame:
    """Equal-weight book whose weights drift between changes of the held set: (by.., t, gross, turnover, net).

    Within a segment the wealth of a name is its first weight times its compounded return, so the book's
    return and the weights at the next change follow in closed form (wealth must stay positive). The held set earns
    the next step's return; missing returns are 0; leading dates and the last one earn 0.
    """
    by = by or []
    one = W.partitionBy(*by, F.lit(1)).orderBy("t")
    returns = selection.select("t", "asset", ret) if returns is None else returns
    dates = selection.select(*by, "t").distinct() if dates is None else dates
    held = dates.join(selection.where(F.col(sel)).groupBy(*by, "t").agg(F.array_sort(F.collect_list("asset")).alias("set")), [*by, "t"], "left")
    kind = dict(held.dtypes)["set"]
    held = held.withColumn("set", F.coalesce("set", F.array().cast(kind)))
    held = held.withColumn("before", F.coalesce(F.lag("set").over(one), F.array().cast(kind))).withColumn("end", F.max("t").over(W.partitionBy(*by, F.lit(1))))
    seg = held.where((F.size("set") > 0) & (F.col("set") != F.col("before")) & (F.col("t") < F.col("end")))
    seg = seg.select(*by, F.row_number().over(one).alias("seg"), F.col("t").alias("t0"), F.coalesce(F.lead("t").over(one), F.col("end")).alias("t1"), "set")
    names = seg.select(*by, "seg", "t0", "t1", (1.0 / F.size("set")).alias("w0"), F.explode("set").alias("asset"))
    steps = names.withColumn("t", F.explode(F.sequence(F.col("t0") + 1, F.col("t1")))).join(returns.select("t", "asset", F.coalesce(F.col(ret), F.lit(0.0)).alias("r_")), ["t", "asset"])
    grown = F.exp(F.sum(F.log1p("r_")).over(W.partitionBy(*by, "seg", "asset").orderBy("t")))
    steps = steps.withColumn("wealth", F.col("w0") * grown)
    total = steps.groupBy(*by, "seg", "t", "t0").agg(F.sum("wealth").alias("v"))
    before = F.coalesce(F.lag("v").over(W.partitionBy(*by, "seg").orderBy("t")), F.lit(1.0))
    gross = total.select(*by, (F.col("t") - 1).alias("t"), (F.col("v") / before - 1).alias("g"))
    ends = steps.where("t = t1").join(total.select(*by, "seg", "t", "v"), [*by, "seg", "t"]).select(*by, (F.col("seg") + 1).alias("seg"), "asset", (-F.col("wealth") / F.col("v")).alias("w"))
    legs = names.select(*by, "seg", "asset", F.col("w0").alias("w")).unionAll(ends)
    turn = legs.groupBy(*by, "seg", "asset").agg(F.sum("w").alias("d")).groupBy(*by, "seg").agg((F.sum(F.abs("d")) / 2.0).alias("turnover"))
    turn = seg.select(*by, "seg", F.col("t0").alias("t")).join(turn, [*by, "seg"]).select(*by, "t", "turnover")
    out = dates.join(gross, [*by, "t"], "left").join(turn, [*by, "t"], "left").select(*by, "t", F.coalesce("g", F.lit(0.0)).alias("gross"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"))
    return out.withColumn("net", net_of_cost(cost_bp))


def perf(book: DataFrame, periods_per_year: int = 252, by: list[str] | None = None, net: str = "net") -> DataFrame:
    """(by.., n, ann, sharpe, mdd); NULL under 20 observations."""
    by = by or []
    b = book.where(F.col(net).isNotNull())
    run = W.partitionBy(*by, F.lit(1)).orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumn("nav", F.exp(F.sum(F.log1p(net)).over(run))).withColumn("top", F.max("nav").over(run))
    enough = F.count(F.lit(1)) >= 20
    sd = F.nullif(F.stddev_samp(net), F.lit(0.0))
    return b.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.when(enough, F.exp(F.sum(F.log1p(net)) / (F.count(F.lit(1)) / float(periods_per_year))) - 1).alias("ann"),
        F.when(enough, F.try_divide(F.avg(net), sd) * F.sqrt(F.lit(float(periods_per_year)))).alias("sharpe"), F.when(enough, F.min(F.col("nav") / F.col("top") - 1)).alias("mdd"),
    )
