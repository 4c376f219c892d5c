"""Operator 9: exact top-k by inner product, exhaustive and term at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, batches, finite_vector

QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
INT_LIMIT = 2**62


def accumulate(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Scores of every query against every candidate, one term (dimension) after another.

    Each term's posting list scatters query weight times posting weight into the dense
    score array; a term that a query or a candidate lacks (weight 0) is left out.
    """
    scores = np.zeros((len(queries), len(postings)), queries.dtype)
    for term in range(min(queries.shape[1], postings.shape[1])):
        q, c = np.flatnonzero(queries[:, term]), np.flatnonzero(postings[:, term])
        if len(q) == 0 or len(c) == 0:
            continue
        if len(q) == len(queries) and len(c) == len(postings):
            scores += queries[:, term, None] * postings[None, :, term]
        else:
            scores[np.ix_(q, c)] += queries[q, term, None] * postings[None, c, term]
    return scores


def dense(vectors: list, width: int, limit: int | None = None) -> np.ndarray:
    """floor(1024 x) as integers, short vectors padded with zeros; Python integers where 64 bits could overflow."""
    raw = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        raw[i, : len(v)] = np.asarray(v, np.float64)
    raw = np.floor(1024 * raw)
    if limit is not None and np.abs(raw).max(initial=0) > limit:
        return np.array([[int(x) for x in row] for row in raw], object).reshape(raw.shape)
    return raw.astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query its k best candidates: partition selection on the score, ties to the smaller id. ids ascend."""
    n = scores.shape[1]
    for q in range(len(scores)):
        row = scores[q]
        keep = np.flatnonzero(ids != own[q])
        row = row[keep]
        if len(row) > k:
            bar = np.partition(row, len(row) - k)[len(row) - k] if row.dtype != object else sorted(row)[len(row) - k]
            over = np.flatnonzero(row > bar)
            tie = np.flatnonzero(row == bar)[: k - len(over)]
            at = np.concatenate([over, tie])
        else:
            at = np.arange(len(row))
        yield q, keep[at]
    assert n == len(ids)


def top_k(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", ws: Workspace | None = None) -> DataFrame:
    """The k rows of highest integer inner product for every row whose id is divisible by ``every``.

    Components become floor(1024 x), x as double. Candidates are all rows but those with the
    query's own id. Returns query_id long, rank int, vec_id long, score long; ties go to the
    smaller vec_id. Rows with a null id, a null or empty vector, or null or non-finite
    components take no part. Vectors of different lengths meet on the dimensions they share.
    Repeated rows are candidates as often as they occur, in the ranks next to each other; of
    repeated query ids the least vector is the query. Scores past 64 bits raise an error. An
    empty table, or one without queries, gives no rows. Extra columns are ignored.

    Queries are packed into blocks of at most 2 * QUERY_BLOCK rows, and each block is sent to
    all candidate partitions: memory in a task is a block of queries times CANDIDATE_BLOCK,
    whatever the size of the input. Every partition keeps k rows a query, merged by one
    window over the query id.
    """
    spark: SparkSession = df.sparkSession
    ws = ws or Workspace(spark, "topk")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & finite_vector("v"))
    q = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    q = ws.write(q, "queries")
    n = q.count()
    schema = "query_id long, vec_id long, score long"
    blocks = max(1, -(-n // QUERY_BLOCK))
    parts = []
    for b in range(blocks if n else 0):
        block = q.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()  # one block: about QUERY_BLOCK rows
        if not block:
            continue
        own = np.array([r[0] for r in block], np.int64)
        width = max(len(r[1]) for r in block)
        top = max(1, int(max(abs(np.floor(1024 * np.asarray(r[1]))).max() for r in block)))
        limit = INT_LIMIT // (top * width)
        qs = dense([r[1] for r in block], width, INT_LIMIT // width)

        def scan(frames: Iterator[pd.DataFrame], own=own, qs=qs, width=width, limit=limit) -> Iterator[pd.DataFrame]:
            best: pd.DataFrame | None = None
            for f in batches(frames, CANDIDATE_BLOCK):
                f = f.sort_values("vec_id", kind="stable")
                ids = f.vec_id.to_numpy()
                x = dense([v[:width] for v in f.v], width, limit)
                qq = qs.astype(object) if x.dtype == object else qs
                s = accumulate(qq, x.astype(object) if qq.dtype == object else x)
                found = [(own[i], ids[at], s[i][at]) for i, at in select(s, ids, own, k)]
                if not found:
                    continue
                now = pd.DataFrame({"query_id": np.repeat([a for a, _, _ in found], [len(c) for _, c, _ in found]), "vec_id": np.concatenate([c for _, c, _ in found]), "score": np.concatenate([c for _, _, c in found])})
                best = now if best is None else pd.concat([best, now])
                best = best.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)
            if best is not None and len(best):
                yield best.astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

        part = rows.mapInPandas(scan, schema)
        parts.append(part if blocks == 1 else ws.write(part, f"block-{b}"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionAll(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return allp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
