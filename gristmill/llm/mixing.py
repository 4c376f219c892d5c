"""Operator 2 [native]: mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_SQL, Workspace

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
FANOUT = 1024
LEVELS = 3
TREE_DEPTH = 4
FILL_ROUNDS = 3
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """Targets of sources (source, source_size): weights repeat over the sources in code point order, null last.

    The share c * weight holds for sources under ``cap`` times their size and the others stay
    at that cap. c follows from one pass over the sources sorted by cap / weight: it is the
    first value that no later source's cap undercuts, the point where resharing the excess ends.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by = W.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    every = W.partitionBy(F.lit(1))
    before = by.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("c", (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("share", F.max(F.when(F.col("c") * F.col("w") <= F.col("most"), F.col("c"))).over(every))
    return s.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("share") * F.col("w"), F.col("most"))).alias("target"))


def log_factorial(n: Column) -> Column:
    """ln n!: exact products below 10, Stirling's series (error under 1e-12) from there on."""
    x = n.cast("double") + 1.0
    series = (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    small = F.ln(F.factorial(F.least(n, F.lit(15)).cast("int")).cast("double"))
    return F.when(n < 16, small).otherwise(series)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``marked`` among ``total`` are in a draw of ``drawn``, by inversion of u.

    The sum runs over ten standard deviations around the mean, beyond which a double holds no mass.
    """
    mean = F.try_divide(drawn * marked.cast("double"), total.cast("double"))
    sd = F.sqrt(F.try_divide(mean * (total - marked), total.cast("double"))) + 1
    low = F.greatest(F.lit(0), drawn + marked - total, F.floor(mean - 10 * sd)).cast("long")
    high = F.greatest(low, F.least(marked, drawn, F.ceil(mean + 10 * sd))).cast("long")
    comb = lambda n, k: log_factorial(n) - log_factorial(k) - log_factorial(n - k)
    p = F.transform(F.sequence(low, high), lambda x: F.exp(comb(marked, x) + comb(total - marked, drawn - x) - comb(total, drawn)))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"))
    below = F.aggregate(p, start, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), (acc["n"] + F.when(acc["sum"] + x < u, 1).otherwise(0)).alias("n")))["n"]
    return F.when(total <= 0, F.lit(0).cast("long")).otherwise(F.least(low + below, high))


def split_quotas(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """Shares the block quotas (source, quota) among 2 ** depth output shards: (source, shard, first, blocks).

    Every node of a binary tree holds an array of quotas, one for each source. The left child
    gets half of the node's blocks; how many of each source is drawn source after source from the
    hypergeometric law of what is left, which together is a multivariate-hypergeometric draw;
    the right child gets the rest. Counts stay exact: a source's shards add up to its quota.
    ``first`` is where a shard's run starts in the source's permuted blocks. One row a node, an
    entry a source: the fold sees the list of sources, never rows or blocks.
    """
    item = F.struct("source", "quota")
    node = quotas.agg(F.array_sort(F.collect_list(item)).alias("q")).select(F.lit(0).cast("long").alias("shard"), "q")
    for level in range(depth):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["quota"])
        begin = F.struct(total.alias("left"), F.floor(total / 2).cast("long").alias("want"), F.array().cast("array<bigint>").alias("got"))

        salt = seed * 64 + level

        def draw(acc: Column, x: Column) -> Column:
            u = (F.pmod(F.xxhash64(F.lit(salt), F.col("shard"), x["source"]), F.lit(2**52)).cast("double") + 0.5) / float(2**52)  # noqa: B023
            n = hypergeometric(acc["left"], x["quota"], acc["want"], u)
            return F.struct((acc["left"] - x["quota"]).alias("left"), (acc["want"] - n).alias("want"), F.concat(acc["got"], F.array(n)).alias("got"))

        got = F.aggregate("q", begin, draw)["got"]
        node = node.withColumn("got", got).withColumn("q0", F.zip_with("q", "got", lambda x, n: F.struct(x["source"].alias("source"), n.alias("quota")))).withColumn("q1", F.zip_with("q", "got", lambda x, n: F.struct(x["source"].alias("source"), (x["quota"] - n).alias("quota"))))
        node = node.select(F.col("shard") * 2, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("q0").alias("q")), F.struct(F.lit(1).alias("side"), F.col("q1").alias("q")))).alias("c")).select((F.col("(shard * 2)") + F.col("c.side")).alias("shard"), F.col("c.q").alias("q"))
    each = node.select("shard", F.inline("q"))
    first = F.sum("quota").over(W.partitionBy("source").orderBy("shard")) - F.col("quota")
    return each.select("source", "shard", first.alias("first"), F.col("quota").alias("blocks"))


def mix_sources(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS, depth: int = TREE_DEPTH, seed: int = 11, ws: Workspace | None = None) -> DataFrame:
    """The mixture: for each document the repeats taken, and the output shard and order of each repeat.

    Returns doc_id, source, size, source_size, target, repeats (whole copies in the mixture), taken (size
    times repeats) and placements, an array of (repeat, shard, position): shards are written in
    ascending position. A source's target is floor(target / source_size) whole passes and a
    rest; in every pass its blocks come in a new random order. The rest takes blocks in hash
    order while they fit, then in the block that does not fit its sub-blocks, and so on LEVELS
    times, and last documents: what stays missing is less than one document of that last block. Document ids
    decide the blocks, so reruns agree. Null ids, null texts (size 0) and null sources count as
    values; repeated rows each count; an empty table gives no rows; extra columns are ignored.

    Only sums over (source, block) are shuffled whole; a hot source spreads over FANOUT blocks.
    """
    ws = ws or Workspace(df.sparkSession, "mix")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_SQL)), F.lit(0)).cast("long")
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    docs = ws.write(df.select("doc_id", "source", size.alias("size"), h.alias("h"), F.monotonically_increasing_id().alias("rid")), "docs")
    # blocks of the first level: at most FANOUT a source
    block = [F.pmod(F.shiftrightunsigned("h", 10 * i), F.lit(FANOUT)).alias(f"b{i}") for i in range(LEVELS)]
    docs = docs.select("*", *block)
    sums = ws.write(docs.groupBy("source", "b0").agg(F.sum("size").alias("words")), "blocks")
    targets = ws.write(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap), "targets")
    whole = F.least(F.lit(cap), F.floor(F.try_divide("target", "source_size") + 1e-9)).cast("int")
    plan = ws.write(targets.withColumn("passes", F.coalesce(whole, F.lit(0))).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))), "plan")

    small = plan.count() <= BROADCAST_SOURCES
    bounded = lambda t: F.broadcast(t) if small else t

    # how far the rest reaches, level by level: (source, path of the block that is cut, words still wanted)
    cut = plan.select("source", "rest")
    path: list[str] = []
    ends = plan
    for i in range(LEVELS):
        keys = ["source", *path, f"b{i}"]
        at = cut.select(F.col("source").alias("s_"), *[F.col(p).alias(f"{p}_") for p in path], "rest")
        on = lambda t, at=at, path=path: t["source"].eqNullSafe(at["s_"]) & reduce(and_, [t[p] == at[f"{p}_"] for p in path], F.lit(True))
        level = sums if i == 0 else docs.join(bounded(at), on(docs)).groupBy(*keys).agg(F.sum("size").alias("words"))
        level = level.join(bounded(at), on(level)).select(*[level[c] for c in keys], "words", "rest")
        level = level.withColumn("run", F.sum("words").over(W.partitionBy("source").orderBy(f"b{i}")))
        first = F.min(F.when(F.col("run") > F.col("rest"), F.col(f"b{i}"))).over(W.partitionBy("source"))
        cut = level.withColumn("first", first).where(F.col(f"b{i}") == F.col("first"))
        cut = ws.write(cut.select("source", *path, f"b{i}", (F.col("rest") - F.col("run") + F.col("words")).alias("rest")), f"cut-{i}")
        f = cut.select(F.col("source").alias("s_"), F.col(f"b{i}").alias(f"f{i}"))
        ends = ends.join(bounded(f), ends["source"].eqNullSafe(f["s_"]), "left").drop("s_")
        path = [*path, f"b{i}"]
    ends = ws.write(ends.withColumnRenamed("source", "s_"), "ends")

    d = docs.join(bounded(ends), docs["source"].eqNullSafe(ends["s_"]), "left").drop("s_")
    under = lambda i: F.coalesce(F.col(f"b{i}") < F.col(f"f{i}"), F.lit(True))
    on_edge = lambda i: F.coalesce(F.col(f"b{i}") == F.col(f"f{i}"), F.lit(False))
    before = under(0) | (on_edge(0) & (under(1) | (on_edge(1) & under(2))))
    last = on_edge(0) & on_edge(1) & on_edge(2)
    d = ws.write(d.withColumn("extra", (before & ~last & (F.col("rest") > 0)).cast("int")).withColumn("last", last), "marked")
    # inside the last cut block: documents from the longest on, each if it still fits
    c = cut.select(F.col("source").alias("s_"), F.col("rest").alias("room"))
    tail = d.where("last").select("source", "rid", "size", "h").join(bounded(c), F.col("source").eqNullSafe(F.col("s_")))
    item = "array<struct<size:bigint,h:bigint,rid:bigint>>"
    fits = F.aggregate(
        F.reverse(F.array_sort(F.collect_list(F.struct("size", "h", "rid")))), F.struct(F.first("room").alias("room"), F.array().cast(item).alias("in")),
        lambda a, x: F.struct((a["room"] - F.when(x["size"] <= a["room"], x["size"]).otherwise(0)).alias("room"), F.when(x["size"] <= a["room"], F.concat(a["in"], F.array(x))).otherwise(a["in"]).alias("in")),
    )
    picks = ws.write(tail.groupBy("source").agg(fits["in"].alias("in")).select(F.explode("in.rid").alias("p_")), "picks-0")
    # what is still missing: the longest document that fits, some more times
    for i in range(FILL_ROUNDS):
        d = d.join(bounded(picks), F.col("rid") == F.col("p_"), "left").withColumn("extra", F.when(F.col("p_").isNotNull(), 1).otherwise(F.col("extra"))).drop("p_")
        d = ws.write(d, f"filled-{i}")
        gap = d.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * (F.col("passes") + F.col("extra")))).alias("gap")).select(F.col("source").alias("s_"), "gap")
        more = d.where(f"extra = 0 and passes < {cap} and size > 0").join(bounded(gap), F.col("source").eqNullSafe(F.col("s_")) & (F.col("size") <= F.col("gap")))
        picks = ws.write(more.groupBy("source").agg(F.max(F.struct("size", "h", "rid")).alias("m")).select(F.col("m.rid").alias("p_")), f"picks-{i + 1}")
    d = d.join(bounded(picks), F.col("rid") == F.col("p_"), "left").withColumn("extra", F.when(F.col("p_").isNotNull(), 1).otherwise(F.col("extra"))).drop("p_")
    d = ws.write(d, "taken")

    # block quotas: every source's blocks, once a pass, and once more those that the rest takes from
    some = d.groupBy("source", "b0").agg(F.max("extra").alias("some"), F.max("passes").alias("passes"))
    drawn = some.select("source", "b0", F.explode(F.sequence(F.lit(0), F.col("passes") + F.col("some"))).alias("pass"), "passes", "some")
    drawn = drawn.where(F.col("pass") < F.col("passes") + F.col("some")).select("source", "b0", "pass")
    order = F.row_number().over(W.partitionBy("source").orderBy("pass", F.xxhash64(F.lit(seed + 1), "b0", "pass"))) - 1
    drawn = ws.write(drawn.withColumn("nth", order), "drawn")
    shards = ws.write(split_quotas(drawn.groupBy("source").agg(F.count(F.lit(1)).alias("quota")), depth, seed), "shards").where("blocks > 0")
    s2 = shards.select(F.col("source").alias("s_"), "shard", "first", "blocks")
    hit = drawn.join(bounded(s2), drawn["source"].eqNullSafe(s2["s_"]) & (drawn["nth"] >= s2["first"]) & (drawn["nth"] < s2["first"] + s2["blocks"]))
    places = ws.write(hit.groupBy(drawn["source"], "b0").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("at")).select(F.col("source").alias("s_"), F.col("b0").alias("b_"), "at"), "places")
    d = d.join(places, d["source"].eqNullSafe(places["s_"]) & (d["b0"] == places["b_"]), "left")
    repeats = F.coalesce(F.col("passes"), F.lit(0)) + F.coalesce(F.col("extra"), F.lit(0))
    own = F.filter("at", lambda x: (x["pass"] < F.col("passes")) | (F.col("extra") == 1))
    placed = F.transform(own, lambda x: F.struct(x["pass"].alias("repeat"), x["shard"].alias("shard"), F.xxhash64(F.lit(seed + 2), F.col("doc_id"), x["pass"]).alias("position")))
    return d.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"), placed.alias("placements"))
