"""Permutation nulls. A draw is a column; all draws of a null run in one job.

The random order comes from md5 of draw, date and asset, which every SQL engine computes alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .cross_section import buckets, rank_ic


def draws(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def order_key(*columns: str) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def permuted(df: DataFrame, n_draws: int, keys: list[str], value: str, carry: list[str]) -> DataFrame:
    """(draw, keys.., asset, carry.., value): in each draw and group the i-th asset by id gets the i-th value in random order.

    One shuffle: a group's values are gathered as an array, and each draw sorts a copy of it. Groups are
    cross-sections, bounded by the number of assets.
    """
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("asset", *carry, F.col(value).alias("v_")))).alias("xs"))
    g = draws(g, n_draws)
    key = lambda x: F.md5(F.concat_ws("|", F.col("draw").cast("string"), F.col("t").cast("string"), x["asset"].cast("string")))
    mixed = F.array_sort(F.transform("xs", lambda x: F.struct(key(x).alias("k"), x["asset"].alias("a"), x["v_"].alias("v"))))
    rows = g.select("draw", *keys, F.explode(F.arrays_zip("xs", mixed.alias("ys"))).alias("z"))
    return rows.select("draw", *keys, "z.xs.asset", *[F.col(f"z.xs.{c}").alias(c) for c in carry], F.col("z.ys.v").alias(value))


def full_shuffle(panel: DataFrame, n_draws: int, signal: str = "signal", fwd: str = "fwd", mask: str = "mask") -> DataFrame:
    """Signal permuted within each date among usable assets: destroys everything."""
    d = panel.where(F.col(signal).isNotNull() & F.col(mask)).select("t", "asset", signal, fwd)
    return permuted(d, n_draws, ["t"], signal, [fwd])


def matched_shuffle(panel: DataFrame, covariates: list[str], n_draws: int, n_bucket: int = 5, signal: str = "signal", fwd: str = "fwd", mask: str = "mask") -> DataFrame:
    """Signal permuted within cells of bucketed covariates (names sorted): keeps what they carry.

    Assets without a covariate and dates with fewer than 2 n_bucket usable assets keep their signal;
    column moved tells which rows could move.
    """
    d = panel.where(F.col(signal).isNotNull() & F.col(mask)).select("t", "asset", signal, fwd, *covariates)
    ok = F.lit(True)
    for c in covariates:
        ok = ok & F.col(c).isNotNull()
    d = d.withColumn("ok", ok).withColumn("n_ok", F.count_if("ok").over(W.partitionBy("t")))
    live = d.where(F.col("ok") & (F.col("n_ok") >= 2 * n_bucket))
    still = d.where(~(F.col("ok") & (F.col("n_ok") >= 2 * n_bucket)))
    live = live.withColumn("cell", F.lit(0))
    for c in sorted(covariates):
        live = buckets(live, c, n_bucket, out="b_").withColumn("cell", F.col("cell") * n_bucket + F.col("b_")).drop("b_")
    moved = permuted(live, n_draws, ["t", "cell"], signal, [fwd]).select("draw", "t", "asset", fwd, signal, F.lit(True).alias("moved"))
    return moved.unionByName(draws(still, n_draws).select("draw", "t", "asset", fwd, signal, F.lit(False).alias("moved")))


def relabelled(panel: DataFrame, n_draws: int, signal: str = "signal", group: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Assets swapped once for the whole sample, within group if given: keeps persistence, destroys identity."""
    keep = keep or ["fwd", "mask"]
    assets = panel.select("asset", *([group] if group else [])).distinct()
    fixed = assets.where(F.col(group).isNull()) if group else None
    a = draws(assets.where(F.col(group).isNotNull()) if group else assets, n_draws)
    by = ["draw", *([group] if group else [])]
    a = a.withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy("asset"))).withColumn("j", F.row_number().over(W.partitionBy(*by).orderBy(order_key("draw", "asset"), "asset")))
    on = [*by, "i"]
    perm = a.select(*on, "asset").join(a.select(*by, F.col("j").alias("i"), F.col("asset").alias("source")), on).select("draw", "asset", "source")
    if fixed is not None:
        perm = perm.unionByName(draws(fixed, n_draws).select("draw", "asset", F.col("asset").alias("source")))
    values = panel.select("t", F.col("asset").alias("source"), F.col(signal).alias("signal_"))
    return perm.join(panel.select("t", "asset", *keep), "asset").join(values, ["t", "source"]).select("draw", "t", "asset", *keep, F.col("signal_").alias(signal))


def mean_ic_by_draw(shuffled: DataFrame, mask: str | None = None, min_n: int = 30, signal: str = "signal", fwd: str = "fwd") -> DataFrame:
    """(draw, stat): mean rank IC of each draw; ranks are taken anew, as values may land on rows without a label."""
    ic = rank_ic(shuffled, signal, fwd, mask, min_n, by=["draw"])
    return ic.groupBy("draw").agg(F.avg("ic").alias("stat"))


def random_events(panel: DataFrame, n_draws: int, trigger: str = "trigger", fwd: str = "fwd", mask: str = "mask") -> DataFrame:
    """(draw, stat): mean label of random events, as many on each date as the real ones."""
    d = panel.where(F.col(mask) & F.col(fwd).isNotNull()).select("t", "asset", F.col(fwd).alias("f_"), F.coalesce(F.col(trigger), F.lit(False)).alias("hit"))
    d = d.withColumn("k", F.count_if("hit").over(W.partitionBy("t"))).where("k > 0")
    d = draws(d.select("t", "asset", "f_", "k"), n_draws)
    picked = d.withColumn("r", F.row_number().over(W.partitionBy("draw", "t").orderBy(order_key("draw", "t", "asset")))).where("r <= k")
    return picked.groupBy("draw").agg(F.avg("f_").alias("stat"))


def free_selection(selection: DataFrame, n_draws: int, sel: str = "sel", mask: str = "mask") -> DataFrame:
    """(draw, t, asset, sel): on every date on which the book changes, as many random assets as it holds; held until the next change."""
    changes = book_changes(selection, sel)
    pool = selection.where(F.col(mask)).select("t", "asset").join(changes, "t")
    pool = draws(pool, n_draws).withColumn("r", F.row_number().over(W.partitionBy("draw", "t").orderBy(order_key("draw", "t", "asset"))))
    picked = pool.where("r <= n").select("draw", F.col("t").alias("t0"), "asset")
    span = changes.select(F.col("t").alias("t0"), F.coalesce(F.lead("t").over(W.orderBy("t")) - 1, F.lit(None)).alias("t1"))
    last = selection.agg(F.max("t").alias("tm"))
    span = span.crossJoin(F.broadcast(last)).select("t0", F.explode(F.sequence("t0", F.coalesce("t1", "tm"))).alias("t"))
    return picked.join(span, "t0").select("draw", "t", "asset", F.lit(True).alias(sel))


def book_changes(selection: DataFrame, sel: str = "sel") -> DataFrame:
    """(t, n): dates on which the held set changes and is not empty."""
    held = selection.groupBy("t").agg(F.array_sort(F.collect_list(F.when(F.col(sel), F.col("asset")))).alias("set"))
    w = W.orderBy("t")
    empty = F.array().cast(dict(held.dtypes)["set"])
    held = held.withColumn("before", F.coalesce(F.lag("set").over(w), empty))
    return held.where((F.size("set") > 0) & (F.col("set") != F.col("before"))).select("t", F.size("set").alias("n"))


def matched_selection(selection: DataFrame, n_draws: int, sel: str = "sel", mask: str = "mask") -> DataFrame:
    """(draw, t, asset): random books with the strategy's own turnover.

    When the strategy changes, a draw keeps as many of its names as the strategy kept, chosen at random
    among those still usable, and fills the rest at random. The state runs through time, so a draw is a fold in one task.
    """
    rows = selection.where(F.col(mask) | F.col(sel)).groupBy("t").agg(F.array_sort(F.collect_list(F.when(F.col(sel), F.col("asset")))).alias("held"), F.array_sort(F.collect_list(F.when(F.col(mask), F.col("asset")))).alias("pool"))
    every = selection.select("t").distinct().join(rows, "t", "left")
    kind = dict(selection.dtypes)["asset"]

    def fold(g):
        import hashlib

        import pandas as pd

        draw, out, real, mine = int(g.draw.iloc[0]), [], set(), set()
        for t, held, pool in g.sort_values("t")[["t", "held", "pool"]].itertuples(index=False):
            now, usable = set() if held is None else set(held), set() if pool is None else set(pool)
            if now and now != real:
                key = lambda a, t=t: hashlib.md5(f"{draw}|{t}|{a}".encode()).hexdigest()
                keep = sorted(mine & usable, key=key)[: len(now & real)]
                more = sorted(usable - set(keep), key=key)[: len(now) - len(keep)]
                mine = set(keep) | set(more)
            real = now
            out += [(draw, t, a) for a in sorted(mine)]
        return pd.DataFrame(out, columns=["draw", "t", "asset"])

    return draws(every, n_draws).groupBy("draw").applyInPandas(fold, f"draw int, t int, asset {kind}")


def random_selection(panel: DataFrame, counts: DataFrame, n_draws: int, hold: int = 1, mask: str = "mask") -> DataFrame:
    """(draw, t, asset): random books of the given breadth (t, want), each pick held for ``hold`` steps."""
    pool = panel.groupBy("t").agg(F.array_sort(F.collect_list(F.when(F.col(mask), F.col("asset")))).alias("pool")).join(counts, "t", "left")
    kind = dict(panel.dtypes)["asset"]

    def fold(g):
        import hashlib

        import pandas as pd

        draw, until, out = int(g.draw.iloc[0]), {}, []
        for t, names, want in g.sort_values("t")[["t", "pool", "want"]].itertuples(index=False):
            keep = {a for a, u in until.items() if u > t}
            need = max(0, (0 if pd.isna(want) else int(want)) - len(keep))
            picks = sorted(set(names) - keep, key=lambda a, t=t: hashlib.md5(f"{draw}|{t}|{a}".encode()).hexdigest())[:need]
            until.update({a: t + hold for a in picks})
            out += [(draw, t, a) for a in sorted(keep | set(picks))]
        return pd.DataFrame(out, columns=["draw", "t", "asset"])

    return draws(pool, n_draws).groupBy("draw").applyInPandas(fold, f"draw int, t int, asset {kind}")


def percentile_of(real: Column, stat: str = "stat") -> Column:
    """Share of draws strictly below the real value, in percent."""
    return 100.0 * F.avg(F.when(F.col(stat).isNotNull(), (F.col(stat) < real).cast("int")))


def empirical_p(real: Column, stat: str = "stat", two_sided: bool = False) -> Column:
    """(k + 1) / (n + 1), k draws at least as large as the real value."""
    hit = F.abs(F.col(stat)) >= F.abs(real) if two_sided else F.col(stat) >= real
    return (F.count_if(hit) + 1.0) / (F.count(stat) + 1.0)
