"""Operator 5: sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Workspace

RACKS_PER_REGION = 2
SHARDS_PER_RACK = 2
ROWS_PER_SLOT_GROUP = 1024


def uniform(key: Column, *salt: object) -> Column:
    """A draw in (0, 1) that depends on key and salt only."""
    h = F.xxhash64(key, *[F.lit(s) for s in salt])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(2**53))


def tree(shards: int, weights: list[float] | None = None) -> dict[int, dict[int, dict[int, float]]]:
    """region -> rack -> shard -> weight."""
    out: dict[int, dict[int, dict[int, float]]] = {}
    for s in range(shards):
        rack = s // SHARDS_PER_RACK
        out.setdefault(rack // RACKS_PER_REGION, {}).setdefault(rack, {})[s] = 1.0 if weights is None else float(weights[s])
    return out


def weight(node: dict | float) -> float:
    return sum(weight(c) for c in node.values()) if isinstance(node, dict) else max(float(node), 0.0)


def draw(key: Column, level: str, children: dict[int, float]) -> Column:
    """The child that wins: each arrives at -ln(u)/w, an exponential of rate w, u being its own hash draw; the first one wins, with its share of the weight.

    A child's arrival hangs on its own weight only: one that grows takes rows into itself, one that shrinks gives rows up, and
    none move between the others.
    """
    arrivals = [F.struct((-F.ln(uniform(key, level, name)) / F.lit(w)).alias("arrival"), F.lit(name).alias("name")) for name, w in children.items() if w > 0]
    return (F.array_min(F.array(*arrivals)) if len(arrivals) > 1 else arrivals[0])["name"]


def descend(key: Column, node: dict, levels: tuple[str, ...] = ("region", "rack", "shard")) -> Column:
    """Goes down from the root: a weighted draw among the regions, then among the racks of that region, then among its shards.

    Only draws on the way down are made. A changed weight changes the weights of its own ancestors: rows move between
    such a region and the others, inside it between such a rack and the others, inside that between its shards;
    subtrees without a change exchange no row.
    """
    chosen = draw(key, levels[0], {name: weight(c) for name, c in node.items()})
    out = F.lit(None).cast("int")
    for name, child in node.items():
        if weight(child) > 0:
            below = descend(key, child, levels[1:]) if isinstance(child, dict) else F.lit(name)
            out = F.when(chosen == name, below).otherwise(out)
    return out.cast("int")


def shard_of(key: Column, shards: int, weights: list[float] | None = None) -> Column:
    return descend(key, tree(shards, weights))


def grown_shard_of(key: Column, shards: int, weights: list[float] | None = None, more: float = 1.0) -> Column:
    """The shard after one more of weight ``more`` opens: it is a subtree of its own beside the old root, so it takes rows into itself only."""
    old = weight(tree(shards, weights))
    return F.when(draw(key, "growth", {0: old, 1: more}) == 1, F.lit(shards)).otherwise(shard_of(key, shards, weights)).cast("int")


def shard(df: DataFrame, shards: int = 8, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", ws: Workspace | None = None) -> DataFrame:
    """Assigns every row to a shard, and to a slot in it.

    The law is ``key``: the id, the shard count and the weights decide, and one more shard
    takes rows only into itself (``grown_shard``). Returns doc_id, size long (UTF-8 bytes plus
    1; null text 1), text_crc32 long (null text as empty), law, shard int, slot long (gapless from 0 in each
    shard, in hash order), grown_shard int. A null id is a key of its own; rows that repeat an id share its shard and get
    slots of their own; equal texts under different ids are keys of their own and may part. An empty table gives no rows; extra columns are ignored.

    Slots come without sorting a shard in one task: repeated rows are counted before the shuffle
    and numbered as a run, rows fall into groups by hash, and only the rows of one small group
    are ordered together, after the rows of the groups before it.
    """
    ws = ws or Workspace(df.sparkSession, "shard")
    key = F.struct(F.col(id_col))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        shard_of(key, shards, weights).alias("shard"), grown_shard_of(key, shards, weights).alias("grown_shard"), F.xxhash64(F.col(id_col), text).alias("h"),
    )
    rows = ws.write(rows.groupBy(*rows.columns).count(), "rows")
    groups = max(1, rows.count() // (shards * ROWS_PER_SLOT_GROUP))
    rows = rows.withColumn("g", F.pmod("h", F.lit(groups)))
    by = W.partitionBy("shard").orderBy("g")
    starts = ws.write(rows.groupBy("shard", "g").agg(F.sum("count").alias("n")).withColumn("first", F.sum("n").over(by) - F.col("n")).drop("n"), "starts")
    run = F.sum("count").over(W.partitionBy("shard", "g").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("end", run).join(starts, ["shard", "g"])
    placed = placed.withColumn("slot", F.explode(F.sequence(F.col("first") + F.col("end") - F.col("count"), F.col("first") + F.col("end") - 1)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
