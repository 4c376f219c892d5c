"""Operator 6: near-duplicate vectors by NN-descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Workspace, components, finite_vector
from .minhash import runs

THRESHOLD = 0.9
LIST = 8
LONGEST_LIST = 64
TABLES = 8
GROUP = 64
ROUNDS = 6
STILL = 0.01
AUDIT = 4096
TARGET = 0.995
#: Components from HOT classes on are audited apart; so many sampled classes with links outside them are evidence.
HOT, EVIDENCE = 64, 2_000
BLOCK = 256


def unit(packed: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    n, out = len(near), []
    new = np.ones(n, bool)
    for start in range(n):
        if not new[start]:
            continue
        new[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            js = np.flatnonzero(near[i] & new)
            new[js] = False
            out += [(i, int(j)) for j in js]
            todo += js.tolist()
    return out


def local_join(ids: np.ndarray, u: np.ndarray, lists: np.ndarray, bars: np.ndarray, threshold: float) -> tuple[list, list]:
    """All comparisons in a small group: neighbours that improve a member's list, and links that span the group's clusters."""
    s = u @ u.T
    np.fill_diagonal(s, -2)
    near = s >= threshold
    links = [(int(ids[i]), int(ids[j])) for i, j in spanning(near)] if near.any() else []
    out = []
    n = len(ids)
    for i in range(n):
        k = min(int(lists[i]), n - 1)
        best = np.argpartition(-s[i], k - 1)[:k] if k < n - 1 else np.delete(np.arange(n), i)
        best = best[s[i, best] > bars[i]]
        out += [(int(ids[i]), int(ids[j]), float(s[i, j])) for j in best]
    return out, links


class Descent:
    """The neighbour graph over classes of equal vectors (cid), refined in rounds."""

    def __init__(self, df: DataFrame, ws: Workspace, id_col: str, vec_col: str, threshold: float):
        self.ws, self.spark, self.threshold = ws, df.sparkSession, threshold
        v = F.col(vec_col).cast("array<double>")
        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        ok = finite_vector("v") & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
        rows = rows.select("vec_id", F.when(ok, F.col("v")).alias("v")).withColumn("f1", F.xxhash64(F.lit(1), "v")).withColumn("f2", F.xxhash64(F.lit(2), "v"))
        self.rows = ws.write(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
        classes = self.rows.where("v is not null").groupBy("f1", "f2").agg(F.min("rid").alias("cid"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"))
        self.classes = ws.write(classes, "classes")

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"cid": f.cid, "dims": [len(v) for v in f.v], "v": [np.asarray(v, "<f8").tobytes() for v in f.v]})

        vec = self.rows.select(F.col("rid").alias("cid"), "v").join(self.classes.select("cid"), "cid")
        self.vectors = ws.write(vec.mapInPandas(pack, "cid long, dims int, v binary"), "vectors")
        self.n = self.vectors.count()
        self.k = LIST
        self.links: list[DataFrame] = []

    def meet(self, members: DataFrame, state: DataFrame | None, label: str) -> DataFrame:
        """Local joins of groups (gid, cid): rows (id, nbr, sim), of which those with a null sim are links.

        Groups of more than GROUP members are dealt out at random into parts of about that size.
        """
        ws, k, threshold = self.ws, self.k, self.threshold
        members = ws.write(members.distinct(), f"{label}-members")
        sizes = ws.write(members.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), f"{label}-sizes")
        dealt = members.join(sizes, "gid").select(F.xxhash64("gid", F.pmod(F.xxhash64("cid", "gid"), F.col("parts"))).alias("gid"), "cid")
        rows = dealt.join(self.vectors.select("cid", "v"), "cid")
        rows = rows.withColumn("list", F.lit(k)).withColumn("bar", F.lit(-2.0)) if state is None else rows.join(state, "cid", "left").withColumn("list", F.coalesce("list", F.lit(k))).withColumn("bar", F.coalesce("bar", F.lit(-2.0)))

        def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows, cols = [], ["id", "nbr", "sim"]
            for g in runs(frames, "gid"):
                if len(g) > 1:
                    got, links = local_join(g.cid.to_numpy(), unit(list(g.v)), g["list"].to_numpy(), g.bar.to_numpy(), threshold)
                    rows += got
                    rows += [(a, b, None) for a, b in links]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=cols).astype({"sim": "float64"})
                    rows = []
            yield pd.DataFrame(rows, columns=cols).astype({"sim": "float64"})

        rows = rows.select("gid", "cid", "v", "list", "bar").repartition("gid").sortWithinPartitions("gid")
        out = ws.write(rows.mapInPandas(join, "id long, nbr long, sim double"), f"{label}-met")
        self.links.append(out.where("sim is null").select(F.col("id").alias("a"), F.col("nbr").alias("b")))
        ws.drop(f"{label}-members", f"{label}-sizes")
        return out.where("sim is not null")

    def start(self) -> DataFrame:
        """A first graph from buckets of random hyperplanes."""
        bits = int(np.clip(np.ceil(np.log2(max(self.n, 2) / 24)), 1, 40))

        def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            planes: dict[int, np.ndarray] = {}
            for f in frames:
                for dims, g in f.groupby("dims"):
                    if dims not in planes:
                        planes[dims] = np.random.default_rng(int(dims)).normal(size=(int(dims), TABLES * bits))
                    side = (unit(list(g.v)) @ planes[dims] > 0).reshape(len(g), TABLES, bits)
                    code = side @ (1 << np.arange(bits)) + (int(dims) << 41)
                    yield pd.DataFrame({"cid": np.repeat(g.cid.to_numpy(), TABLES), "t": np.tile(np.arange(TABLES), len(g)), "code": code.ravel()})

        m = self.vectors.mapInPandas(keys, "cid long, t int, code long")
        return self.meet(m.select(F.xxhash64("t", "code").alias("gid"), "cid"), None, "start")

    def merge(self, old: DataFrame | None, met: DataFrame, state: DataFrame | None, label: str) -> DataFrame:
        """The best of old and new neighbours of each id; fresh marks those that were not there."""
        new = met.select("id", "nbr", "sim", F.lit(1).alias("fresh"))
        both = new if old is None else new.unionAll(old.select("id", "nbr", "sim", F.lit(0).alias("fresh")))
        both = both.groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        w = W.partitionBy("id").orderBy(F.desc("sim"), "nbr")
        if state is not None:
            both = both.join(state.select(F.col("cid").alias("id"), "list"), "id", "left")
        else:
            both = both.withColumn("list", F.lit(None).cast("int"))
        ranked = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.coalesce("list", F.lit(self.k)))
        return self.ws.write(ranked.select("id", "nbr", "sim", "fresh", "list"), f"{label}-graph")

    def state(self, graph: DataFrame, label: str) -> DataFrame:
        """Length of each list and its worst entry; a list full of links is saturated and doubles."""
        s = graph.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.min("sim").alias("worst"), F.max(F.coalesce("list", F.lit(self.k))).alias("list"))
        full = F.col("c") >= F.col("list")
        longer = full & (F.col("worst") >= self.threshold) & (F.col("list") < LONGEST_LIST)
        s = s.select(F.col("id").alias("cid"), F.when(longer, F.col("list") * 2).otherwise(F.greatest("list", F.lit(self.k))).cast("int").alias("list"), F.when(full & ~longer & (F.col("list") >= self.k), F.col("worst")).otherwise(-2.0).alias("bar"))
        return self.ws.write(s, f"{label}-state")

    def refine(self, graph: DataFrame, rounds: int, label: str) -> DataFrame:
        """Rounds of neighbours-of-neighbours joins until hardly an entry changes."""
        for r in range(rounds):
            state = self.state(graph, f"{label}-{r}")
            moving = graph.where("fresh = 1").select(F.explode(F.array("id", "nbr")).alias("gid")).distinct()
            near = graph.select(F.col("id").alias("gid"), F.col("nbr").alias("cid")).unionAll(graph.select(F.col("nbr").alias("gid"), F.col("id").alias("cid"))).unionAll(graph.select(F.col("id").alias("gid"), F.col("id").alias("cid")))
            met = self.meet(near.join(moving, "gid"), state, f"{label}-{r}")
            graph = self.merge(graph, met, state, f"{label}-{r}")
            if graph.where("fresh = 1").count() <= STILL * self.n * self.k:
                break
        return graph

    def compare(self, sample: DataFrame, placed: DataFrame, label: str) -> DataFrame:
        """Compares at most some AUDIT sampled classes with all: rows (a, b, c, n) of a's n links in its component (b null), and of each link (a, b) that leaves it."""
        got = sample.toPandas()
        by = {d: (g.cid.to_numpy(), g.component.to_numpy(), unit(list(g.v))) for d, g in got.groupby("dims")}
        threshold = self.threshold

        def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for dims, g in f.groupby("dims"):
                    if dims in by:
                        ids, comp, u = by[dims]
                        near = u @ unit(list(g.v)).T >= threshold
                        near &= ids[:, None] != g.cid.to_numpy()[None, :]
                        same = comp[:, None] == g.component.to_numpy()[None, :]
                        n = (near & same).sum(1)
                        a, b = np.nonzero(near & ~same)
                        at = np.flatnonzero(n)
                        out = pd.DataFrame({"a": np.concatenate([ids[at], ids[a]]), "n": np.concatenate([n[at], np.zeros(len(a), np.int64)])})
                        out["b"] = pd.array([None] * len(at) + g.cid.to_numpy()[b].tolist(), dtype="Int64")
                        yield out[["a", "b", "n"]]

        return self.ws.write(placed.select("cid", "component", "dims", "v").mapInPandas(meet, "a long, b long, n long"), label)

    def audit(self, comp: DataFrame, label: str, whole: bool) -> tuple[list[DataFrame], float]:
        """Links that leave their components, and the recall: the mean over sampled classes of the share of their links inside.

        Classes of components of HOT members and more count apart from the others, and the lower of both means is the recall, so
        that a large group hides no small one. The others are sampled block by block until EVIDENCE of them have links or all
        are compared; ``whole`` compares all of both kinds.
        """
        sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        where = comp.join(sizes, "component").select(F.col("id").alias("cid"), "component", (F.col("size") >= HOT).alias("hot"))
        placed = self.vectors.join(where, "cid", "left").withColumn("component", F.coalesce("component", "cid")).withColumn("hot", F.coalesce("hot", F.lit(False)))
        placed = self.ws.write(placed, f"{label}-placed")
        missed, worst = [], 1.0
        for hot in (True, False):
            kind = placed.where(F.col("hot") == hot)
            slices, linked, total = -(-kind.count() // AUDIT), 0, 0.0
            for k in range(slices):
                name = f"{label}-{hot}-{k}"
                found = self.compare(kind.where(F.pmod(F.xxhash64(F.lit(5), "cid"), F.lit(slices)) == k), placed, name)
                missed.append(found.where("b is not null").select("a", "b"))
                share = found.groupBy("a").agg((F.sum("n") / (F.sum("n") + F.count("b"))).alias("s"))
                n, s = share.agg(F.count(F.lit(1)), F.coalesce(F.sum("s"), F.lit(0.0))).first()
                linked, total = linked + n, total + s
                if not whole and (hot or linked >= EVIDENCE):
                    break
            worst = min(worst, total / linked if linked else 1.0)
        return missed, worst

    def connect(self, label: str) -> DataFrame:
        edges = self.links[0]
        for e in self.links[1:]:
            edges = edges.unionAll(e)
        return components(self.ws, edges, label)

    def run(self) -> tuple[DataFrame, float]:
        """(id, component) of the classes with links, and the audited recall; 1 where no growth of the lists reaches TARGET and all were compared."""
        graph = self.merge(None, self.start(), None, "start")
        t = 0
        while True:
            graph = self.refine(graph, ROUNDS, f"refine{t}")
            comp = self.connect(f"comp{t}")
            missed, recall = self.audit(comp, f"audit{t}", False)
            self.links += missed
            if recall < TARGET and t == 3:
                self.links += self.audit(comp, "whole", True)[0]
                return self.connect("comp-whole"), 1.0
            if recall == 1.0:
                return comp, recall
            if recall >= TARGET:
                return self.connect(f"comp{t}-audited"), recall
            self.k, t = self.k * 2, t + 1
            graph = graph.withColumn("fresh", F.lit(1))

    def counts(self, comp: DataFrame) -> DataFrame:
        """Exact links of every class in a component: (cid, links), copies counted.

        A link never leaves its component, so members meet the members of their own component
        only, in blocks of about BLOCK vectors, each pair of blocks a row of its own; a task holds two
        blocks and returns counts, never pairs.
        """
        ws, threshold = self.ws, self.threshold
        sizes = ws.write(comp.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "block-sizes")
        m = comp.join(sizes, "component").select(F.col("id").alias("cid"), "component", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
        m = m.join(self.vectors.select("cid", "v"), "cid").join(self.classes.select("cid", "n"), "cid")
        packed = ws.write(m.groupBy("component", "block").agg(F.collect_list(F.struct("cid", "n", "v")).alias("xs")), "blocks")
        pairs = packed.select("component", "block").join(sizes, "component").select("component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        left = pairs.join(packed, ["component", "block"]).select("component", F.col("other"), "xs")
        both = left.join(packed.select("component", F.col("block").alias("other"), F.col("xs").alias("ys")), ["component", "other"]).select("xs", "ys")

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for xs, ys in zip(f["xs"], f["ys"], strict=True):
                    near = unit([x["v"] for x in xs]) @ unit([y["v"] for y in ys]).T >= threshold
                    own = np.array([x["cid"] for x in xs])[:, None] == np.array([y["cid"] for y in ys])[None, :]
                    yield pd.DataFrame({"cid": [x["cid"] for x in xs], "links": (near | own) @ np.array([y["n"] for y in ys], np.int64)})

        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
        out = both.mapInPandas(count, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))
        return ws.write(out, "counts")


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", ws: Workspace | None = None) -> DataFrame:
    """Components of vectors linked by a cosine of ``threshold`` or more, in double precision.

    Returns a row a vector: vec_id, n_links long (other rows linked directly), component_id
    long (smallest vec_id reachable), kept boolean. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing, and so do vectors of different lengths. Equal vectors form a
    class, whose members count as links without a comparison. Rows that repeat an id answer each
    with that id; null ids are never kept. An empty table gives no rows; extra columns are
    ignored. The graph is refined until sampled classes, compared with all rows, have on
    the mean TARGET of their links inside components, those outside large components by themselves; each failed audit
    doubles the lists, and after the fourth all classes are compared.
    """
    ws = ws or Workspace(df.sparkSession, "nndescent")
    d = Descent(df, ws, id_col, vec_col, threshold)
    comp, _ = d.run() if d.n else (d.spark.createDataFrame([], "id long, component long"), 1.0)
    counts = d.counts(comp)
    low = ws.write(comp.join(d.classes.select(F.col("cid").alias("id"), "low"), "id").groupBy("component").agg(F.min("low").alias("least")), "least")
    where = ws.write(comp.join(low, "component").select(F.col("id").alias("cid"), "least"), "where")
    c = d.classes.join(counts, "cid", "left").join(where, "cid", "left")
    c = ws.write(c.select("f1", "f2", (F.coalesce("links", "n") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id")), "answers")
    out = d.rows.select("vec_id", "f1", "f2", F.col("v").isNotNull().alias("ok")).join(c, ["f1", "f2"], "left")
    out = out.select("vec_id", F.when(F.col("ok"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.coalesce(F.when(F.col("ok"), F.col("component_id")), F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
