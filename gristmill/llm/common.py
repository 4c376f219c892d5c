"""Shared pieces of the training-data operators: staged tables, words, hashes, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task may fold.
SMALL_EDGES = 200_000
WORD_SQL = r"[^\x20\x09-\x0D]+"
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="gristmill-"))
    return _own_dir[0]


#: Share of the largest heap that the driver's JVM may hold committed before a staged write collects it.
HEAP_SHARE = 0.6


def trim(spark: SparkSession) -> bool:
    """Hands memory that the driver's JVM freed outside its heap (compilers, buffers) back to the system; False on a JVM that cannot.

    The C library keeps such memory in an arena a thread, which in a long session is hundreds of megabytes.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        kinds, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = jvm.java.lang.Class.forName(kind)
        given[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given[1] = "systemTrimNativeHeap"
        call = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


class Workspace:
    """Tables written to the shared folder, so that a lost executor costs one stage and lineage stays short."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gristmill-{name}-{uuid.uuid4().hex[:12]}"

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """Writes df as Parquet and reads it back; then the driver returns freed memory, after a collection if its heap has grown near its bound."""
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(label))
        heap = self.spark._jvm.java.lang.Runtime.getRuntime()
        if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
            self.release()
        else:
            trim(self.spark)
        return self.spark.read.schema(schema).parquet(self.path(label))

    def drop(self, *labels: str) -> None:
        """Deletes staged tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for label in labels:
            p = jvm.org.apache.hadoop.fs.Path(self.path(label))
            p.getFileSystem(conf).delete(p, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished steps, as it does once the driver has collected their plans, and returns the driver's freed memory."""
        gc.collect()
        self.spark._jvm.System.gc()
        trim(self.spark)


#: Rows of a few numbers each that may be sent to every executor, some ten megabytes.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table, marked for broadcast if it has at most ``rows`` rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_batches(spark: SparkSession, rows: int = 128) -> None:
    """Bounds what one Arrow batch, and one batch of the Parquet reader, can hold of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(4 * rows))


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased; bytes.lower and bytes.split mean just that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


M64 = np.uint64(0xFF51AFD7ED558CCD)
M65 = np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the murmur finalizer)."""
    x = x ^ (x >> np.uint64(33))
    x = x * M64
    x = x ^ (x >> np.uint64(33))
    x = x * M65
    return x ^ (x >> np.uint64(33))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive entries of h."""
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix64(out)


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 20
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base modulo 2 ** 64, at least n, and those of its inverse."""
    while len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            step = np.uint64(pow(base, len(_powers[i]), 2**64))
            _powers[i] = np.concatenate([_powers[i], _powers[i] * step])
    return _powers[0], _powers[1]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word of ``words``, alike in every process: a polynomial of its bytes, by differences of prefix sums."""
    raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(raw):
        stop = len(raw)
        if stop - at > _CHUNK:  # a piece ends at white space
            stop = at + _CHUNK
            while stop < len(raw) and not _SPACE[raw[stop]]:
                stop += 1
        b = np.frombuffer(raw, np.uint8, stop - at, at)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b], [True]])))
        start, end = edge[::2], edge[1::2]
        power, inverse = powers(len(b))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=sums[1:])
        out.append(mix64((sums[end] - sums[start]) * inverse[start]))
        at = stop
    return np.concatenate(out)


def gathered(frames: Iterator, size: int = 20_000) -> Iterator:
    """Joins small frames until they hold size rows."""
    import pandas as pd

    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n >= size:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def finite_vector(col: str) -> Column:
    """True where an array of floats is present, not empty, and holds only finite numbers."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(col).isNotNull() & (F.size(col) > 0) & ~bad, F.lit(False))


def fold_components(frames: Iterator) -> Iterator:
    """Union-find over a few edges: (id, smallest id of its component)."""
    import pandas as pd

    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for f in frames:
        for a, b in zip(f.a.tolist(), f.b.tolist(), strict=True):
            x, y = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            up[max(x, y)] = min(x, y)
    if up:
        yield pd.DataFrame({"id": list(up), "component": [root(x) for x in up]})


def components(ws: Workspace, edges: DataFrame, label: str) -> DataFrame:
    """Connected components of edges (a, b): one row (id, component) for each id with an edge.

    component is the smallest id reachable. Each round hooks every node to its neighbour of
    least random rank, follows those pointers to their roots, and rewrites the edges
    between roots; random ranks keep pointer chains, and so the rounds, logarithmic. Every
    grouping combines before its shuffle, and every table is staged: a node that has a third
    of the edges makes no large task. No edges give no rows.
    """
    spark = ws.spark
    rank = lambda c: F.struct(F.xxhash64(F.lit(17), c).alias("r"), F.col(c).alias("v"))
    e = ws.write(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), f"{label}-e0")
    maps: DataFrame | None = None
    used = [f"{label}-e0"]
    n = 0
    count = e.count()
    if count <= SMALL_EDGES:
        out = ws.write(e.coalesce(1).mapInPandas(fold_components, "id long, component long"), f"{label}-out")
        ws.drop(*used)
        return out
    while not e.isEmpty():
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("id")).agg(F.min(rank("b")).alias("m"))
        hook = low.select("id", F.when(F.col("m.r") < F.xxhash64(F.lit(17), "id"), F.col("m.v")).otherwise(F.col("id")).alias("up"))
        hook = ws.write(hook, f"{label}-h{n}.0")
        used.append(f"{label}-h{n}.0")
        k = 0
        while True:  # pointer jumping to the roots
            up = hook.select(F.col("id").alias("up"), F.col("up").alias("top"))
            jumped = ws.write(hook.join(up, "up").select("id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), f"{label}-h{n}.{k + 1}")
            used.append(f"{label}-h{n}.{k + 1}")
            k += 1
            hook = jumped.select("id", "up")
            if jumped.where("moved").isEmpty():
                break
        to = lambda c, h=hook: h.select(F.col("id").alias(c), F.col("up").alias(f"{c}2"))
        e2 = e.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct()
        e = ws.write(e2, f"{label}-e{n + 1}")
        if maps is None:
            maps = hook
        else:
            nxt = hook.select(F.col("id").alias("up"), F.col("up").alias("top"))
            maps = ws.write(maps.join(nxt, "up", "left").select("id", F.coalesce("top", "up").alias("up")), f"{label}-m{n}")
        used.append(f"{label}-e{n + 1}")
        n += 1
    if maps is None:
        ws.drop(*used)
        return spark.createDataFrame([], "id long, component long")
    least = ws.write(maps.groupBy("up").agg(F.min("id").alias("component")), f"{label}-least")
    out = ws.write(maps.join(least, "up").select("id", "component"), f"{label}-out")
    ws.drop(*used, *[f"{label}-m{i}" for i in range(1, n)])
    return out


def batches(frames: Iterator, size: int) -> Iterator:
    """Joins pandas frames until they hold size rows."""
    import pandas as pd

    held, n = [], 0
    for f in frames:
        for at in range(0, len(f), size):
            part = f.iloc[at : at + size]
            held.append(part)
            n += len(part)
            if n >= size:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


SPLIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
