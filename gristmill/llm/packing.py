"""Operator 8: packing pieces into sequences by a configuration linear program."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Workspace, small_batches
from .tokens import encoder

CAPACITY = 2048
ROUNDS = 160
RANK_GROUP = 2048
STAGES = 4


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> list[int]:
    """Knapsack by dynamic programming: the lengths, repeats allowed, of greatest total value that fit capacity."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1, np.int64)
    for room in range(int(lengths[0]), capacity + 1):
        k = int(np.searchsorted(lengths, room, "right"))
        with_item = best[room - lengths[:k]] + values[:k]
        j = int(np.argmax(with_item))
        if with_item[j] > best[room - 1]:
            best[room], last[room] = with_item[j], j
        else:
            best[room], last[room] = best[room - 1], -1
    out, room = [], capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            out.append(int(lengths[last[room]]))
            room -= out[-1]
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how many sequences get each; together they hold exactly the histogram.

    The linear program covers every length's count with configurations (multisets of lengths
    that fit). Multiplicative weights: a length's price falls exponentially with the share of its count
    that is covered, knapsack pricing finds the configuration of greatest value, and the mean of the
    configurations is the fractional solution. It is rounded up to whole sequences, the fullest configurations first, as far as pieces are
    left; the program is solved again for those that rounding leaves, and the last go longest first. Where that
    needs more sequences than longest first alone, which small or easy histograms may, the latter is the answer. Input and work depend on the
    number of distinct lengths only, at most ``capacity``.
    """
    left = Counter({int(n): int(c) for n, c in histogram.items() if c > 0})
    plain = longest_first(left, capacity)
    out: Counter = Counter()
    for _ in range(STAGES):
        before = sum(left.values())
        if not before:
            break
        for config, times in fractional(left, capacity, rounds):
            uses = Counter(config)
            whole = min(math.ceil(times), *(left[n] // c for n, c in uses.items()))
            if whole > 0:
                out[config] += whole
                for n, c in uses.items():
                    left[n] -= c * whole
        left = +left
        if sum(left.values()) > 0.9 * before:
            break
    for config, times in longest_first(left, capacity).items():
        out[config] += times
    return sorted((out if sum(out.values()) <= sum(plain.values()) else plain).items())


def fractional(left: Counter, capacity: int, rounds: int) -> list[tuple[tuple[int, ...], float]]:
    """The program's solution: configurations and the sequences each should get, the fullest and then the most frequent first."""
    lengths = np.array(sorted(left), np.int64)
    need = np.array([left[int(n)] for n in lengths], float)
    step = float((need * lengths).sum()) / capacity / rounds
    found: Counter = Counter()
    cover = np.zeros(len(lengths))
    eta = np.log(max(2, len(lengths))) * 4
    at = {int(n): i for i, n in enumerate(lengths)}
    for t in range(rounds):
        gap = cover / need - (t + 1) / rounds
        y = np.exp(-eta * np.clip(gap * rounds / 8, -4, 4)) * lengths
        config = price(y / y.sum() * len(lengths) + 1e-9 * lengths, lengths, capacity)
        found[tuple(sorted(config, reverse=True))] += 1
        for n in config:
            cover[at[n]] += step
    return sorted(((c, n * step) for c, n in found.items()), key=lambda x: (-sum(x[0]), -x[1], x[0]))


def longest_first(counts: Counter, capacity: int) -> Counter:
    """Each sequence takes the longest remaining length that fits, again and again; equal sequences are made at once."""
    left, out = +Counter(counts), Counter()
    lengths = sorted(left, reverse=True)
    while lengths:
        room, uses = capacity, {}
        for n in lengths:
            take = min(left[n], room // n)
            if take:
                uses[n] = take
                room -= n * take
        times = min(left[n] // c for n, c in uses.items())
        out[tuple(n for n, c in uses.items() for _ in range(c))] += times
        for n, c in uses.items():
            left[n] -= c * times
        lengths = [n for n in lengths if left[n]]
    return out


def tokenize_pieces(df: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32; row tells repeats of an id apart."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for f in frames:
            out = []
            for doc, text in zip(f.doc_id, f.text, strict=True):
                ids = enc.ids(text)
                n = len(ids) // 4
                first = n - capacity * ((n - 1) // capacity)
                at, piece, doc = 0, 0, None if pd.isna(doc) else int(doc)
                while at < n:
                    length = first if piece == 0 else capacity
                    out.append((doc, piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                    at, piece = at + length, piece + 1
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return rows.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", ws: Workspace | None = None) -> DataFrame:
    """Packs the token ids of all documents, an end id after each, into sequences of at most ``capacity``.

    Only longer documents are cut, into pieces of ``capacity``, the first of them the shorter.
    Returns doc_id, piece int, start long, length long, ids_crc32 long, sequence_id long and
    offset long, a row a piece. Null texts are empty: the end id alone. Repeated rows are packed
    as often as they occur; null ids count as an id. An empty table gives no rows; extra columns
    are ignored.

    The driver sees the length histogram (at most ``capacity`` rows) and gives each length runs
    of places, a run for every configuration that has it; the number of runs depends on the configurations, not on the
    rows. Pieces are numbered within their length through counts by (length, hash
    group), so that a length that a third of all rows have is numbered in many tasks.
    """
    spark = df.sparkSession
    ws = ws or Workspace(spark, "pack")
    pieces = ws.write(tokenize_pieces(df, tokenizer, capacity, id_col, text_col), "pieces")
    groups = max(16, pieces.count() // RANK_GROUP)
    pieces = pieces.groupBy("doc_id", "piece", "start", "length", "ids_crc32").count()
    pieces = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    pieces = ws.write(pieces, "distinct")
    counts = ws.write(pieces.groupBy("length", "g").agg(F.sum("count").alias("n")).withColumn("first", F.sum("n").over(W.partitionBy("length").orderBy("g")) - F.col("n")), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    runs, sequence, used = [], 0, Counter()
    for config, times in solve(histogram, capacity):
        offset = 0
        for n in config:
            runs.append((n, used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    table = pd.DataFrame(runs, columns=["length", "rank", "sequence", "offset"]).sort_values(["length", "rank"])
    by = {int(n): (g["rank"].to_numpy(), g["sequence"].to_numpy(), g["offset"].to_numpy()) for n, g in table.groupby("length")}
    shared = spark.sparkContext.broadcast(by)  # a row for each place in a configuration

    rank = F.sum("count").over(W.partitionBy("length", "g").orderBy("doc_id", "piece", "start", "ids_crc32").rowsBetween(W.unboundedPreceding, 0))
    ranked = pieces.withColumn("end", rank).join(counts.select("length", "g", "first"), ["length", "g"])
    ranked = ranked.withColumn("rank", F.explode(F.sequence(F.col("first") + F.col("end") - F.col("count"), F.col("first") + F.col("end") - 1)))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = shared.value
        for f in frames:
            seq, off = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            ranks, lengths = f["rank"].to_numpy(), f["length"].to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                first, sequences, offsets = tables[int(n)]
                k = np.searchsorted(first, ranks[at], "right") - 1
                seq[at], off[at] = sequences[k] + ranks[at] - first[k], offsets[k]
            yield pd.DataFrame({"doc_id": f.doc_id.astype("Int64"), "piece": f.piece, "start": f.start, "length": f["length"], "ids_crc32": f.ids_crc32, "sequence_id": seq, "offset": off})

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
