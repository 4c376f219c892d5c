"""Operator 1: near-duplicate documents by a chosen-path set similarity join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Workspace, bounded, components, mix64, rolling, small_batches, word_hashes

SHINGLE = 5
PERCENT = 75
#: Trees whose roots enter in each round; the first find most links, so that the later ones start with labels.
ROUNDS_OF_TREES = ((0, 1), (2, 3, 4, 5), (6, 7, 8, 9))
TREES = 10
BRANCHES = 2
#: Members that are compared at a time: those of one block, or of two larger ones.
BLOCK, WIDE_BLOCK = 128, 256
#: A node is compared exhaustively if its members times those outside its most frequent label are no more than this squared.
NODE_LIMIT = 1024
MAX_DEPTH = 12


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of all runs of SHINGLE words; a shorter text is one shingle."""
    h = word_hashes(text)
    return np.unique(rolling(h, min(SHINGLE, len(h)))) if len(h) else h


def seeds_of(key: int, n: int) -> np.ndarray:
    """n hash seeds that a key decides."""
    return mix64(np.uint64(key & 0xFFFFFFFFFFFFFFFF) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


ROOT_SEEDS = seeds_of(0, TREES)


def tokens(s: np.ndarray, seeds: np.ndarray) -> list[int]:
    """The minwise token of a set under the hash function of each seed, as signed 64 bits."""
    return [int(mix64(s ^ x).min()) - 2**63 for x in seeds]


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the whole set."""
    raw = s.tobytes()
    return xxhash.xxh64_intdigest(raw, 1) - 2**63, xxhash.xxh64_intdigest(raw, 2) - 2**63


def runs(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The groups of frames sorted by key; a group may reach over frames."""
    held: pd.DataFrame | None = None
    for f in frames:
        if held is not None:
            f = pd.concat([held, f], ignore_index=True)
            held = None
        if len(f) == 0:
            continue
        k = f[key].to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        start = 0
        for c in cuts:
            yield f.iloc[start:c]
            start = c
        held = f.iloc[start:]
    if held is not None and len(held):
        yield held


def node_links(labels: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Compares all members of different labels on their full sets; links (label, label) that span what they connect.

    Members of one label are linked already, so those of the most frequent label meet the others only.
    """
    _, at, n = np.unique(labels, return_inverse=True, return_counts=True)
    if len(n) < 2:
        return []
    size = np.array([len(s) for s in sets])
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[element] > 1
    member, element = np.repeat(np.arange(len(sets)), size)[shared], element[shared]
    ends = np.cumsum(np.bincount(member, minlength=len(sets)))
    near = np.zeros((len(sets), len(sets)), bool)
    mark = np.zeros(len(times), bool)
    for i in np.flatnonzero(at != np.argmax(n)):
        own = element[(ends[i - 1] if i else 0) : ends[i]]
        if len(own):
            mark[own] = True
            both = np.bincount(member[mark[element]], minlength=len(sets))
            mark[own] = False
            near[i] |= (100 * both >= PERCENT * (size[i] + size - both)) & (at != at[i])
    near |= near.T
    out, new = [], np.ones(len(sets), bool)
    for start in np.flatnonzero(near.any(1)):
        todo = [start] if new[start] else []
        new[start] = False
        while todo:
            i = todo.pop()
            reached = np.flatnonzero(new & (near[i] | (at == at[i])))
            new[reached] = False
            out += [(int(labels[i]), int(labels[j])) for j in reached if at[j] != at[i]]
            todo += reached.tolist()
    return out


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


class Join:
    """One similarity join; classes are documents of equal shingle sets, cid is a class, a label the least cid of a component."""

    def __init__(self, docs: DataFrame, ws: Workspace, id_col: str, text_col: str):
        self.ws, self.spark = ws, docs.sparkSession
        small_batches(self.spark)
        text = F.col(text_col).cast("string")
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
        self.labels: DataFrame | None = None

    def sketch(self) -> DataFrame:
        """Per document its set's size, fingerprint and root tokens; rid numbers the rows."""

        def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for doc, text, mark in zip(f.doc_id, f.text, f.text_hash, strict=True):
                    s = shingles(text)
                    out.append((None if pd.isna(doc) else int(doc), mark, len(s), *fingerprint(s), tokens(s, ROOT_SEEDS) if len(s) else []))
                yield pd.DataFrame(out, columns=["doc_id", "text_hash", "n_shingles", "f1", "f2", "roots"]).astype({"doc_id": "Int64"})

        got = self.docs.mapInPandas(make, "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, roots array<long>")
        return self.ws.write(got.withColumn("rid", F.monotonically_increasing_id()), "sketch")

    def roots(self) -> DataFrame:
        """The roots with several members: (node, cid, tree)."""
        keys = self.classes.select("cid", F.posexplode("roots").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "cid", "tree")
        many = keys.groupBy("node").count().where("count > 1").select("node")
        return self.ws.write(keys.join(many, "node").select("node", "cid", "tree"), "roots")

    def fetch(self) -> DataFrame:
        """The full shingle sets of the classes in such roots, in one more pass over their texts."""
        ids = self.nodes.select("cid").distinct()
        need = self.ws.write(self.classes.join(ids, "cid").select("cid", "f1", "f2", F.col("lead.doc_id").alias("d_"), F.col("lead.text_hash").alias("t_")), "need")
        near = bounded(need)
        texts = self.docs.join(near, self.docs["doc_id"].eqNullSafe(near["d_"]) & (self.docs["text_hash"] == near["t_"])).select("cid", "f1", "f2", "text")

        def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for cid, f1, f2, text in zip(f.cid, f.f1, f.f2, f.text, strict=True):
                    s = shingles(text)
                    if fingerprint(s) == (f1, f2):
                        out.append((cid, s.tobytes()))
                yield pd.DataFrame(out, columns=["cid", "s"])

        sets = texts.mapInPandas(make, "cid long, s binary")
        if not self.docs.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
            sets = sets.dropDuplicates(["cid"])
        return self.ws.write(sets, "sets")

    def with_sets(self, rows: DataFrame) -> DataFrame:
        """Staged rows with the sets of their classes: few rows go to the sets; else the sets that rows need are shuffled."""
        near = bounded(rows, 2 * BROADCAST_ROWS)
        if near is rows:
            return rows.join(self.sets.join(bounded(rows.select("cid").distinct()), "cid", "left_semi"), "cid")
        return self.sets.join(near, "cid")

    def described(self, nodes: DataFrame, r: int) -> DataFrame:
        """Nodes with their labels as known now, and of each: size n and members m outside its most frequent label.

        Nodes of one label are done and absent, and of small ones with the same members one stays.
        Counts are by node and label, so that a label with most of a node's members is counted before the shuffle.
        """
        ws = self.ws
        rows = nodes.withColumn("label", F.col("cid")) if self.labels is None else nodes.join(self.labels, "cid", "left").withColumn("label", F.coalesce("component", "cid")).drop("component")
        rows = ws.write(rows, f"labelled-{r}")
        same = [F.bit_xor(F.xxhash64(F.lit(i), "cid")).alias(f"x{i}") for i in range(2)]
        per = rows.groupBy("node", "age", "label").agg(F.count(F.lit(1)).alias("c"), *same)
        s = per.groupBy("node", "age").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("kinds"), *[F.bit_xor(f"x{i}").alias(f"x{i}") for i in range(2)]).where("kinds > 1")
        s = ws.write(s.select("node", "age", "n", F.col("top.label").alias("most"), (F.col("n") - F.col("top.c")).alias("m"), "x0", "x1"), f"stats-{r}")
        small = (F.col("age") == 0) & (F.col("n") <= BLOCK)
        one = s.where(small).groupBy("n", "x0", "x1").agg(F.min("node").alias("node"))
        s = ws.write(s.where(~small).select("node", "n", "m", "most").unionAll(one.join(s, ["node", "n", "x0", "x1"]).select("node", "n", "m", "most")), f"open-{r}")
        out = ws.write(rows.join(bounded(s), "node"), f"level-{r}")
        ws.drop(f"labelled-{r}", f"stats-{r}")
        return out

    @staticmethod
    def within(level: DataFrame) -> DataFrame:
        """Each node once: whole if it is small, else dealt out in blocks of about BLOCK members that are compared each by itself."""
        block = F.pmod(F.xxhash64("cid", "node"), F.ceil(F.col("n") / BLOCK))
        return level.select(F.when(F.col("n") <= BLOCK, F.xxhash64("node")).otherwise(F.xxhash64("node", block)).alias("unit"), "cid", "label")

    @staticmethod
    def across(level: DataFrame) -> DataFrame:
        """All pairs of labels of each node: every block of members outside the most frequent label meets every block of the node."""
        p, q = F.ceil(F.col("m") / WIDE_BLOCK), F.ceil((F.col("n") - F.col("m")) / WIDE_BLOCK)
        h = F.xxhash64("cid", "node")
        minor = F.col("label") != F.col("most")
        own = F.when(minor, F.pmod(h, p)).otherwise(p + F.pmod(h, q)).cast("int")
        rows = level.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(minor, p + q - 1).otherwise(p - 1).cast("int"))))
        return rows.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "cid", "label")

    def meet(self, units: DataFrame, r: int) -> DataFrame:
        """Links between labels from units (unit, cid, label) of bounded size, confirmed on full sets."""
        rows = self.with_sets(self.ws.write(units, f"units-{r}"))

        def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in runs(frames, "unit"):
                out = node_links(g.label.to_numpy(), [np.frombuffer(s, np.uint64) for s in g.s])
                if out:
                    yield pd.DataFrame(out, columns=["a", "b"])

        rows = rows.select("unit", "cid", "label", "s").repartition("unit").sortWithinPartitions("unit")
        return self.ws.write(rows.mapInPandas(compare, "a long, b long").distinct(), f"links-{r}")

    def children(self, big: DataFrame, r: int) -> DataFrame:
        """The members of large nodes one level down, BRANCHES times each: every node draws hash functions of its own for its members' minwise tokens."""
        rows = self.with_sets(self.ws.write(big.select("node", "cid", "tree", "depth"), f"big-{r}"))

        def branch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                kids = []
                for node, s in zip(f.node, f.s, strict=True):
                    seeds = seeds_of(node, BRANCHES)
                    low = np.array(tokens(np.frombuffer(s, np.uint64), seeds), np.int64).view(np.uint64)
                    kids.append(mix64(low ^ mix64(seeds)).view(np.int64))
                if kids:
                    yield pd.DataFrame({"node": np.concatenate(kids), "cid": np.repeat(f.cid.to_numpy(), BRANCHES), "tree": np.repeat(f.tree.to_numpy(), BRANCHES), "depth": np.repeat(f.depth.to_numpy() + 1, BRANCHES)})

        return self.ws.write(rows.select("node", "cid", "tree", "depth", "s").mapInPandas(branch, "node long, cid long, tree int, depth int"), f"kids-{r}").withColumn("age", F.lit(0))

    def relabel(self, links: DataFrame, r: int) -> None:
        """Joins the labels that links connect; a class that no link has reached yet is a label of its own and not in the table."""
        merged = components(self.ws, links, f"round-{r}")
        if self.labels is None:
            self.labels = merged.withColumnRenamed("id", "cid")
            return
        old = self.labels
        to = merged.select(F.col("id").alias("component"), F.col("component").alias("top"))
        moved = old.join(to, "component", "left").select("cid", F.coalesce("top", "component").alias("component"))
        fresh = merged.join(old.select(F.col("cid").alias("id")), "id", "left_anti").select(F.col("id").alias("cid"), "component")
        self.labels = self.ws.write(moved.unionAll(fresh), f"labels-{r}")

    def links(self) -> None:
        """Finds and confirms links between classes until no node of any tree has two labels left.

        Each of TREES roots sends a class to the node of its minwise token under the tree's own hash function. A node's members are
        first compared within blocks, which joins alike groups at little cost: trees block them differently. What then still has
        several labels is compared exhaustively if it is small (members times those outside the most frequent label up to
        NODE_LIMIT squared), else branches: the node draws BRANCHES hash functions, and each member goes on to the children of its
        minwise tokens. A pair of similarity s shares a child of a shared node with 1 - (1 - s) ** BRANCHES, at the threshold 0.94,
        and is never parted for good on all branches with 0.89; it shares none of the TREES roots with about 1e-6.
        Labels are the components of all links confirmed so far. At MAX_DEPTH a node is compared whatever its size.
        """
        ws, r = self.ws, 0
        waiting: DataFrame | None = None
        while True:
            nodes = [] if waiting is None else [waiting]
            if r < len(ROUNDS_OF_TREES):
                some = self.nodes.where(F.col("tree").isin(*ROUNDS_OF_TREES[r]))
                nodes.append(some.select("node", "cid", "tree", F.lit(0).alias("depth"), F.lit(0).alias("age")))
            if not nodes:
                return
            level = self.described(union(nodes), r)
            first, later = level.where("age = 0"), level.where("age = 1")
            few = (F.col("m") * F.col("n") <= NODE_LIMIT**2) | (F.col("depth") >= MAX_DEPTH)
            found = self.meet(self.within(first).unionAll(self.across(later.where(few))), r)
            large = first.where(F.col("n") > BLOCK).select("node", "cid", "tree", "depth", F.lit(1).alias("age"))
            big = later.where(~few)
            waiting = large if big.isEmpty() else large.unionAll(self.children(big, r))
            if not found.isEmpty():
                self.relabel(found, r)
            if r > 0:
                ws.drop(f"level-{r - 1}", f"open-{r - 1}", f"units-{r - 1}", f"big-{r - 1}", f"kids-{r - 1}")
            ws.release()
            r += 1
            if r >= len(ROUNDS_OF_TREES) and waiting.isEmpty():
                return

    def run(self) -> DataFrame:
        ws = self.ws
        sketch = self.sketch()
        lead = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash", "rid")
        own = sketch.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("low"), F.min(lead).alias("lead"), F.first("roots").alias("roots"))
        self.classes = ws.write(own, "classes")
        self.nodes = self.roots()
        self.sets = self.fetch()
        self.links()
        comp = self.labels if self.labels is not None else self.spark.createDataFrame([], "cid long, component long")
        comp = self.classes.select("cid", "f1", "f2", "low", "lead").join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        comp = ws.write(comp, "class-components")
        ws.drop("sets", "roots")
        low = ws.write(comp.groupBy("component").agg(F.min("low").alias("component_id"), F.min("lead").alias("lead")).select("component", "component_id", F.col("lead.rid").alias("lead")), "lowest")
        comp = ws.write(comp.select("component", "f1", "f2").join(bounded(low), "component").select("f1", "f2", "component_id", "lead"), "class-ids")
        ws.drop("class-components", "lowest", "classes")
        out = sketch.select("doc_id", "n_shingles", "f1", "f2", "text_hash", "rid").join(bounded(comp), ["f1", "f2"], "left")
        out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", (F.coalesce("lead", "rid") == F.col("rid")).alias("representative"))
        return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ws: Workspace | None = None) -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

    Returns a row a document: doc_id, n_shingles long, component_id long (smallest doc_id
    reachable by links, itself included), text_hash long (xxhash64 of the text), representative boolean (true for one row of
    every component, that of the least id and hash, nulls last), kept boolean (doc_id = component_id). Words are runs of anything but ASCII white
    space, A-Z lower-cased; a text of fewer than five words is one shingle; texts without words
    are linked with nothing. Documents of equal sets form a class, so exact copies make no pairs
    at all; links between classes are confirmed on the full sets of whole texts. Rows that
    repeat an id are documents of their own that answer with that id; null ids are never the
    smallest and never kept, their component is null where no id is reachable. An empty table
    gives no rows; extra columns are ignored.
    """
    return Join(docs, ws or Workspace(docs.sparkSession, "minhash"), id_col, text_col).run()


def one_of_each(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """One document of every component, that of the smallest id, unchanged; texts without words stay.

    Rows that repeat an id are told apart by their texts; of rows equal in both one stays. Rows without an id go
    if a named document, or another of them, is a near duplicate.
    """
    ws = ws or Workspace(docs.sparkSession, "one-of-each")
    chosen = near_duplicates(docs, ws=ws).where("representative").groupBy(F.col("doc_id").alias("d_"), F.col("text_hash").alias("t_")).count()
    chosen = ws.write(chosen, "chosen")
    near = bounded(chosen.select("d_", "t_"))
    text = F.xxhash64(F.col("text").cast("string"))
    out = docs.join(near, docs["doc_id"].eqNullSafe(near["d_"]) & (text == near["t_"]), "left_semi").select(*docs.columns)
    if docs.groupBy("doc_id", text.alias("t_")).count().where("count > 1").isEmpty():
        return out
    return out.withColumn("t_", F.xxhash64("text")).dropDuplicates(["doc_id", "t_"]).select(*docs.columns)
