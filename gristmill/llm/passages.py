"""Operator 10: repeated passages by collinear chaining of shared seeds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD_SQL, Workspace, bounded, gathered, rolling, small_batches, word_hashes
from .minhash import runs, union

#: Words of a shingle, by which passages are alike or not.
SHINGLE = 5
#: Words of a seed, and how many successive runs of so many words choose one: any SEED + WINDOW - 1 = 24 words that two texts share have a seed in common.
#: A passage of n words at the similarity has at most (n - 4) / 35 edits, so that some 24 successive words of it are free of them.
SEED = 12
WINDOW = 13
GAP = 0.1
MIN_WORDS = 51
#: Bits of a word's place beside a text's id in 64 bits.
PLACE_BITS = 26
#: Parts of the seeds, by hash, that are joined each by itself, so that a task sorts and counts few of them at a time.
SLICES = 4
SIMILARITY = 0.75
SHIFT = 8
AGREE = 4
#: The columns that name a text, and what tells a match from its own first occurrence.
TEXT = ["doc", "k"]
OTHER = "doc <> adoc or k <> ak"
CHAR_WORD = re.compile(r"[^ \t-\r]+")


def seeds(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the winnowed SEED-word runs: the least of every WINDOW successive ones.

    Of equal ones a window takes the choice of the window before it, else the last, so that words that repeat themselves give few seeds.
    """
    g = rolling(h if len(h) >= MIN_WORDS else h[:0], SEED)
    if not len(g):
        return np.zeros(0, np.int64), g
    view = np.lib.stride_tricks.sliding_window_view(g, min(WINDOW, len(g)))
    width = view.shape[1]
    last = width - 1 - view[:, ::-1].argmin(1) + np.arange(len(view))
    at = np.unique(last)
    if (g[at[1:]] == g[at[:-1]]).any():
        kept = [int(last[0])]
        for i, j in enumerate(last.tolist()):
            if kept[-1] < i or g[kept[-1]] != g[j]:
                kept.append(j)
        at = np.array(kept)
    return at, g[at]


def chain(xs: list[int], ys: list[int]) -> list[list[int]]:
    """Collinear chains of matches (x ascending), each a list of indices; the best chain first.

    score(i) = SEED + max over j with x and y before i of score(j) - GAP * (distance in x + distance in y),
    or SEED alone. The maximum over all y before comes from a Fenwick tree of prefix maxima.
    """
    n = len(xs)
    order = {y: r + 1 for r, y in enumerate(sorted(set(ys)))}
    size = len(order)
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    for i in range(n):
        at = xs[i] + ys[i]
        best, r = (float("-inf"), -1), order[ys[i]] - 1
        while r > 0:
            if tree[r] > best:
                best = tree[r]
            r &= r - 1
        gain = best[0] - GAP * at
        score[i] = SEED + max(gain, 0.0)
        if gain > 0:
            back[i] = best[1]
        put, r = (score[i] + GAP * at, i), order[ys[i]]
        while r <= size:
            if put > tree[r]:
                tree[r] = put
            r += r & -r
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda k: (-score[k], k)):
        got, k = [], i
        while k >= 0 and not used[k]:
            used[k] = True
            got.append(k)
            k = back[k]
        if got:
            out.append(got[::-1])
    return out


def extend(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (i, j, length) of equal words of two sequences from their start on, over differences of at most SHIFT words."""
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        run, width = 0, 32
        while True:
            n = min(len(a) - i - run, len(b) - j - run, width)
            differ = np.flatnonzero(a[i + run : i + run + n] != b[j + run : j + run + n])
            run += int(differ[0]) if len(differ) else n
            if len(differ) or n < width:
                break
            width *= 4
        if run:
            out.append((i, j, run))
            i, j = i + run, j + run
        x, y = a[i : i + SHIFT + AGREE], b[j : j + SHIFT + AGREE]
        m, n = len(x) - AGREE + 1, len(y) - AGREE + 1
        if m < 1 or n < 1:
            break
        same = x[:, None] == y[None, :]
        di, dj = np.nonzero(np.logical_and.reduce([same[k : k + m, k : k + n] for k in range(AGREE)]))
        if not len(di):
            break
        k = np.lexsort((-di, di != dj, di + dj))[0]  # the least difference, on the diagonal if that is one
        i, j = i + int(di[k]), j + int(dj[k])
    return out


def run_around(a: np.ndarray, b: np.ndarray, x: int, y: int, most: int) -> int:
    """How many successive words around a shared seed are equal; at most about twice ``most``."""
    back, on = min(x, y, most), min(len(a) - x, len(b) - y, most)
    before = np.flatnonzero(a[x - back : x] != b[y - back : y])
    after = np.flatnonzero(a[x : x + on] != b[y : y + on])
    return (back - 1 - int(before[-1]) if len(before) else back) + (int(after[0]) if len(after) else on)


def align(a: np.ndarray, b: np.ndarray, points: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Runs of equal words along a chain of seeds and past its ends, in order in both texts; runs that touch are one."""
    out: list[tuple[int, int, int]] = []
    at = to = 0
    for x, y in points:
        if x < at or y < to:
            continue
        back = extend(a[at:x][::-1], b[to:y][::-1])
        for i, j, n in [*((x - i - n, y - j - n, n) for i, j, n in reversed(back)), *((x + i, y + j, n) for i, j, n in extend(a[x:], b[y:]))]:
            if out and (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) == (i, j):
                i, j, n = out[-1][0], out[-1][1], out.pop()[2] + n
            out.append((i, j, n))
        at, to = out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, y = np.unique(rolling(a, SHINGLE)), np.unique(rolling(b, SHINGLE))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) and len(y) else 0.0


def longest(value: np.ndarray) -> tuple[int, int] | None:
    """The longest stretch [i, j) of non-negative sum."""
    total = np.concatenate([[0.0], np.cumsum(value)])
    starts = [0]
    for i in range(1, len(total)):
        if total[i] < total[starts[-1]]:
            starts.append(i)
    best = None
    for j in range(len(total) - 1, 0, -1):
        while starts and total[starts[-1]] <= total[j] + 1e-9:
            i = starts.pop()
            if i < j and (best is None or j - i > best[1] - best[0]):
                best = (i, j)
    return best


def passages(a: np.ndarray, b: np.ndarray, path: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    """The stretches of a path that are long and similar enough: (start, end, other start, other end, similarity).

    Similarity s or more means (1 + s) * shared shingles >= s * shingles of both sides, a sum over the
    runs, so the longest stretch of non-negative sum is taken first, then what is left on either side.
    """
    out, todo = [], [(path, SIMILARITY)]
    while todo:
        p, level = todo.pop()
        if not p or p[-1][0] + p[-1][2] - p[0][0] < MIN_WORDS or p[-1][1] + p[-1][2] - p[0][1] < MIN_WORDS:
            continue
        x, y, n = (np.array(c) for c in zip(*p, strict=True))
        value = (1 + level) * np.maximum(n - SHINGLE + 1, 0) - level * 2 * n
        gap = level * ((x[1:] - x[:-1] - n[:-1]) + (y[1:] - y[:-1] - n[:-1]))
        steps = np.zeros(2 * len(p) - 1)
        steps[::2], steps[1::2] = value, -gap
        steps[0] += 2 * level * (SHINGLE - 1)  # a stretch of w words has w - SHINGLE + 1 shingles
        got = longest(steps)
        if got is None:
            k = int(np.argmax(n))
            got = (2 * k, 2 * k + 1) if n[k] >= MIN_WORDS else None
        if got is None:
            continue
        i, j = (got[0] + 1) // 2, got[1] // 2 + got[1] % 2
        i, j = min(i, len(p) - 1), max(j, i + 1)
        s, t, e, f = p[i][0], p[i][1], p[j - 1][0] + p[j - 1][2], p[j - 1][1] + p[j - 1][2]
        if e - s >= MIN_WORDS and f - t >= MIN_WORDS:
            like = similarity(a[s:e], b[t:f])
            if like >= SIMILARITY:
                out.append((s, e, t, f, like))
            elif level < 0.99:
                todo.append((p[i:j], min(1.0, level + 0.1)))
        if j - i < len(p):
            todo += [(p[:i], level), (p[j:], level)]
    return out


def stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """The starts [i, j) of all MIN_WORDS words that may be repeated as a whole, from a text's ascending repeated seeds.

    Such words choose a seed within their first WINDOW runs, then each no more than WINDOW on, and one within their last.
    """
    out = []
    for part in np.split(x, np.flatnonzero(np.diff(x) > WINDOW) + 1):
        i, j = int(part[0]) - WINDOW + 1, int(part[-1]) + SEED + WINDOW - MIN_WORDS
        if i < j:
            out.append((max(i, 0), j))
    return out


def seed_pairs(x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, second) of all pairs of one text's ascending seeds that MIN_WORDS words can hold."""
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, len(x)):
        at = np.flatnonzero(x[step:] - x[:-step] <= MIN_WORDS - SEED)
        if not len(at):
            break
        i, j = [*i, at], [*j, at + step]
    a, b = np.concatenate(i), np.concatenate(j)
    return rolling(np.stack([h[a], h[b]], 1).ravel(), 2)[::2], a, b


class Search:
    """One search for repeated passages. A text is named by doc (its id) and k: 0, or its hash where an id has several texts."""

    def __init__(self, docs: DataFrame, ws: Workspace, id_col: str, text_col: str):
        self.ws, self.spark = ws, docs.sparkSession
        small_batches(self.spark)
        text = F.col(text_col).cast("string")
        rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("mark")).where("doc is not null and text is not null")
        marks = ws.write(rows.groupBy("doc", "mark").agg(F.count(F.lit(1)).alias("count"), F.max(F.octet_length("text")).alias("bytes")), "marks")
        several = ws.write(marks.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc", F.lit(True).alias("several")), "several")
        low, high, longest = marks.agg(F.min("doc"), F.max("doc"), F.max("bytes")).first()
        self.fits = several.isEmpty() and low is not None and low >= 0 and high < 2 ** (63 - PLACE_BITS) and longest < 2**PLACE_BITS
        copies = marks.groupBy("mark").agg(F.min("doc").alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1").select("mark", "lead")
        self.copies = ws.write(copies, "copies")
        keyed = lambda t: t.join(bounded(several), "doc", "left").withColumn("k", F.when(F.col("several"), F.col("mark")).otherwise(0)).drop("several")
        self.marks = ws.write(keyed(marks).select("doc", "k", "mark"), "marks-k")
        led = keyed(rows).join(bounded(self.copies), "mark", "left")
        self.later = led.where("lead <> doc").select("doc", "mark", "lead", F.regexp_count("text", F.lit(WORD_SQL)).alias("n"))
        self.texts = led.where("lead is null or lead = doc").select("doc", "k", "text")
        if not marks.where("count > 1").isEmpty():
            self.later, self.texts = self.later.distinct(), self.texts.dropDuplicates(TEXT)

    def among(self, need: DataFrame, label: str) -> DataFrame:
        """The texts that a list of them names."""
        return self.texts.join(bounded(self.ws.write(need.select(*TEXT).distinct(), label)), TEXT, "left_semi")

    def first(self, rows: DataFrame, key: str, *places: str) -> DataFrame:
        """The first place of every key that several texts have: key, adoc, ak and the places as a0, a1; combined before the shuffle.

        Where a place fits 64 bits with its id, it is compared as one number, which a hash aggregation can hold; else as a struct, which is sorted.
        """
        if self.fits and len(places) == 1:
            got = rows.groupBy(key).agg(F.min(F.shiftleft("doc", PLACE_BITS) + F.col(places[0])).alias("m"), F.max("doc").alias("last"))
            got = got.withColumn("adoc", F.shiftright("m", PLACE_BITS)).where("adoc <> last")
            return got.select(key, "adoc", F.lit(0).cast("long").alias("ak"), F.col("m").bitwiseAND(F.lit(2**PLACE_BITS - 1)).cast("int").alias("a0"))
        got = rows.groupBy(key).agg(F.min(F.struct(*TEXT, *places)).alias("m"), F.max(F.struct(*TEXT)).alias("last"))
        got = got.where((F.col("m.doc") != F.col("last.doc")) | (F.col("m.k") != F.col("last.k")))
        return got.select(key, F.col("m.doc").alias("adoc"), F.col("m.k").alias("ak"), *[F.col(f"m.{p}").alias(f"a{i}") for i, p in enumerate(places)])

    def sow(self) -> DataFrame:
        def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                got = [seeds(word_hashes(t)) for t in f.text]
                if got:
                    n = [len(g[0]) for g in got]
                    yield pd.DataFrame({"h": np.concatenate([g[1] for g in got]).view(np.int64), "doc": np.repeat(f.doc.to_numpy(), n), "k": np.repeat(f.k.to_numpy(), n), "x": np.concatenate([g[0] for g in got]).astype(np.int32)})

        return self.ws.write(self.texts.mapInPandas(make, "h long, doc long, k long, x int"), "seeds")

    def link(self, all_seeds: DataFrame) -> DataFrame:
        """Chains of each text and the texts that its seeds occur in first (xs, ys), and a row (xs, hs) of its seeds that others have earlier."""
        slices = [all_seeds.where(F.pmod("h", F.lit(SLICES)) == i) for i in range(SLICES)]
        matches = union([s.join(self.first(s, "h", "x").hint("merge"), "h").where(OTHER) for s in slices])  # one plan at all sizes

        def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cols = ["doc", "k", "adoc", "ak", "xs", "ys", "hs"]
            out: list[tuple] = []
            for g in runs(frames, "gid"):
                text, x, y, h = (int(g.doc.iloc[0]), int(g.k.iloc[0])), g.x.to_numpy(), g.a0.to_numpy(), g.h.to_numpy()
                other, at = np.unique(np.stack([g.adoc.to_numpy(), g.ak.to_numpy()], 1), axis=0, return_inverse=True)
                for i, (adoc, ak) in enumerate(other.tolist()):
                    j = np.flatnonzero(at == i)
                    xs, ys = x[j].tolist(), y[j].tolist()
                    out += [(*text, adoc, ak, [xs[m] for m in c], [ys[m] for m in c], []) for c in chain(xs, ys)]
                if len(x) > 1:  # one alone makes no longer key
                    out.append((*text, None, None, x.tolist(), [], h.tolist()))
                if len(out) > 5_000:
                    yield pd.DataFrame(out, columns=cols).astype({"adoc": "Int64", "ak": "Int64"})
                    out = []
            yield pd.DataFrame(out, columns=cols).astype({"adoc": "Int64", "ak": "Int64"})

        rows = matches.select(F.xxhash64(*TEXT).alias("gid"), *TEXT, "x", "h", "adoc", "ak", "a0").repartition("gid").sortWithinPartitions("gid", "x")
        return self.ws.write(rows.mapInPandas(make, "doc long, k long, adoc long, ak long, xs array<int>, ys array<int>, hs array<long>"), "chains")

    def confirm(self, pairs: DataFrame, label: str) -> DataFrame:
        """Passages of pairs (doc, k, adoc, ak, chains), aligned on whole texts; a loose entry holds matches that are not chained yet."""
        ws = self.ws
        pairs = ws.write(pairs, f"pairs-{label}")
        need = pairs.select(F.explode(F.array(F.struct(*TEXT), F.struct(F.col("adoc").alias("doc"), F.col("ak").alias("k")))).alias("t")).select("t.doc", "t.k")
        texts = ws.write(self.among(need, f"need-{label}"), f"texts-{label}")
        ws.release()

        def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last: tuple[str, np.ndarray] = ("", word_hashes(""))
            for f in frames:
                out = []
                for doc, k, adoc, ak, cs, t1, t2 in zip(f.doc, f.k, f.adoc, f.ak, f.chains, f.t1, f.t2, strict=True):
                    if t2 != last[0]:  # pairs come sorted by the other text
                        last = (t2, word_hashes(t2))
                    a, b, found = word_hashes(t1), last[1], []
                    for c in cs:
                        xs, ys = list(c["xs"]), list(c["ys"])
                        for part in chain(xs, ys) if c["loose"] else [range(len(xs))]:
                            points = [(xs[i], ys[i]) for i in part]
                            if len(points) == 1 and run_around(a, b, *points[0], SEED + WINDOW) < SEED + WINDOW - 1:
                                continue  # no passage, or one with another seed, whose pair with this one is a longer key
                            if not all(any(s <= x and x + SEED <= e for s, e, *_ in found) for x, _ in points):  # words known to be in the other text
                                found += [p for p in passages(a, b, align(a, b, points)) if p not in found]
                    out += [(doc, k, s, e, e == len(a), adoc, ak, t, u, like) for s, e, t, u, like in found]
                yield pd.DataFrame(out, columns=["doc", "k", "start", "end", "ends_text", "adoc", "ak", "other_start", "other_end", "similarity"])

        both = pairs.join(texts.withColumnRenamed("text", "t1"), TEXT).join(texts.select(F.col("doc").alias("adoc"), F.col("k").alias("ak"), F.col("text").alias("t2")), ["adoc", "ak"])
        got = both.select(*TEXT, "adoc", "ak", "chains", "t1", "t2").mapInPandas(check, "doc long, k long, start int, end int, ends_text boolean, adoc long, ak long, other_start int, other_end int, similarity double")
        got = ws.write(got, f"passages-{label}")
        ws.drop(f"pairs-{label}", f"need-{label}", f"texts-{label}")
        ws.release()
        return got

    def outside(self, asked: DataFrame, found: DataFrame, margin: int, label: str) -> DataFrame:
        """What of each text's repeated seeds (xs, hs) does not lie ``margin`` words inside a passage found (open), and the seeds beside.

        A passage that begins or ends with the text needs no margin there. Texts of whose seeds none is left are absent.
        """
        spans = found.groupBy(*TEXT).agg(F.array_sort(F.collect_set(F.struct("start", "end", "ends_text"))).alias("spans"))
        rows = asked.join(bounded(self.ws.write(spans, f"covered-{label}"), BROADCAST_ROWS // 2), TEXT, "left")

        def rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for doc, k, xs, hs, spans in zip(f["doc"], f["k"], f["xs"], f["hs"], f["spans"], strict=True):
                    x, h = np.asarray(xs, np.int64), np.asarray(hs, np.int64)
                    left = np.ones(len(x), bool)
                    for s in [] if spans is None else spans:
                        left &= (x < s["start"] + (margin if s["start"] else 0)) | (x + SEED > s["end"] - (0 if s["ends_text"] else margin))
                    at = x[left]
                    if len(at):
                        i = np.searchsorted(at, x)
                        beside = np.minimum(np.abs(x - at[np.minimum(i, len(at) - 1)]), np.abs(x - at[np.maximum(i - 1, 0)])) <= MIN_WORDS
                        out.append((doc, k, x[beside].tolist(), h[beside].tolist(), left[beside].tolist(), spans))
                yield pd.DataFrame(out, columns=["doc", "k", "xs", "hs", "open", "spans"])

        schema = "doc long, k long, xs array<int>, hs array<long>, open array<boolean>, spans array<struct<start:int,end:int,ends_text:boolean>>"
        return self.ws.write(rows.select(*TEXT, "xs", "hs", "spans").mapInPandas(rest, schema), f"asked-{label}")

    def again(self, mine: DataFrame, keys: DataFrame, places: list[str]) -> DataFrame:
        """Pairs to confirm of texts by the first place, among all keys (key, doc, k, places), of those that they ask for."""
        met = mine.join(self.first(keys, "key", *places), "key").where(OTHER)
        point = F.explode(F.array(*[F.struct(F.col(p).alias("x"), F.col(f"a{i}").alias("y")) for i, p in enumerate(places)]))
        met = met.select(*TEXT, "adoc", "ak", point.alias("p")).groupBy(*TEXT, "adoc", "ak").agg(F.array_sort(F.collect_set("p")).alias("m"))
        entry = F.struct(F.transform("m", lambda p: p["x"]).alias("xs"), F.transform("m", lambda p: p["y"]).alias("ys"), F.lit(True).alias("loose"))
        return met.select(*TEXT, "adoc", "ak", F.array(entry).alias("chains"))

    def by_pairs(self, occurrences: DataFrame, asked: DataFrame) -> DataFrame:
        """Pairs to confirm by the keys of all pairs of near seeds of a text, those asked for with an open seed."""

        def keyed(doc: int, k: int, x: np.ndarray, h: np.ndarray, of: np.ndarray | None) -> pd.DataFrame:
            key, i, j = seed_pairs(x, h.view(np.uint64))
            wanted = np.ones(len(key), bool) if of is None else of[i] | of[j]
            return pd.DataFrame({"key": key.view(np.int64), "doc": doc, "k": k, "x": x[i].astype(np.int32), "z": x[j].astype(np.int32)})[wanted]

        def every(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return gathered(keyed(int(g["doc"].iloc[0]), int(g["k"].iloc[0]), g["x"].to_numpy(), g["h"].to_numpy(), None) for g in runs(frames, "gid"))

        def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return gathered(keyed(doc, k, np.asarray(xs, np.int64), np.asarray(hs, np.int64), np.asarray(of, bool)) for f in frames for doc, k, xs, hs, of in zip(f["doc"], f["k"], f["xs"], f["hs"], f["open"], strict=True))

        schema = "key long, doc long, k long, x int, z int"
        keys = self.ws.write(occurrences.mapInPandas(every, schema), "keys-pairs")
        return self.again(asked.select(*TEXT, "xs", "hs", "open").mapInPandas(own, schema), keys, ["x", "z"])

    def by_words(self, occurrences: DataFrame, asked: DataFrame) -> DataFrame:
        """Pairs to confirm by the keys of all MIN_WORDS successive words that may be repeated as a whole, those asked for in no passage found."""

        def where(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = ((int(g["doc"].iloc[0]), int(g["k"].iloc[0]), stretches(g["x"].to_numpy())) for g in runs(frames, "gid"))
            return gathered(pd.DataFrame({"doc": [doc], "k": [k], "begin": [[i for i, _ in at]], "stop": [[j for _, j in at]]}) for doc, k, at in got if at)

        def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 4]
                for doc, k, begin, stop, text in zip(f["doc"], f["k"], f["begin"], f["stop"], f["text"], strict=True):
                    g = rolling(word_hashes(text), MIN_WORDS)
                    x = np.unique(np.concatenate([np.arange(i, min(j, len(g))) for i, j in zip(begin, stop, strict=True)]))
                    out.append([g[x].view(np.int64), np.full(len(x), doc), np.full(len(x), k), x])
                yield pd.DataFrame(dict(zip(("key", "doc", "k", "x"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

        at = self.ws.write(occurrences.mapInPandas(where, "doc long, k long, begin array<int>, stop array<int>"), "stretches")
        rows = self.texts.join(bounded(at, BROADCAST_ROWS // 2), TEXT).select(*TEXT, "begin", "stop", "text")
        keys = self.ws.write(rows.mapInPandas(make, "key long, doc long, k long, x int"), "keys-words")
        inside = F.exists("spans", lambda s: (s["start"] <= F.col("x")) & (F.col("x") + MIN_WORDS <= s["end"]))
        mine = keys.join(bounded(asked.select(*TEXT, "spans"), BROADCAST_ROWS // 2), TEXT).where(~F.coalesce(inside, F.lit(False))).drop("spans")
        return self.again(mine, keys, ["x"])

    def run(self) -> DataFrame:
        ws = self.ws
        all_seeds = self.sow()
        chains = self.link(all_seeds)
        ws.release()
        chained = chains.where("adoc is not null").groupBy(*TEXT, "adoc", "ak")
        out = [self.confirm(chained.agg(F.array_sort(F.collect_list(F.struct("xs", "ys", F.lit(False).alias("loose")))).alias("chains")), "seeds")]
        repeated = chains.where("adoc is null").select(*TEXT, "xs", "hs")
        for label, more, margin in (("pairs", self.by_pairs, 0), ("words", self.by_words, MIN_WORDS - SEED)):
            asked = self.outside(repeated, union(out), margin, label)
            some = ws.write(asked.select(F.explode("hs").alias("h")).distinct(), f"wanted-{label}")
            occurrences = all_seeds.join(bounded(some), "h", "left_semi").select(F.xxhash64(*TEXT).alias("gid"), *TEXT, "x", "h").repartition("gid").sortWithinPartitions("gid", "x")
            out.append(self.confirm(more(occurrences, asked), label))
            ws.drop(f"keys-{label}", f"wanted-{label}", f"covered-{label}", f"asked-{label}")
        ws.drop("seeds", "chains")
        marks = self.marks
        got = union(out).distinct().join(marks, TEXT).select(F.col("doc").alias("doc_id"), "start", "end", F.col("adoc").alias("other_doc_id"), "other_start", "other_end", (F.col("end") - F.col("start")).alias("n_words"), "similarity", F.col("mark").alias("text_hash"))
        zero, n = F.lit(0), F.col("n").cast("int")
        whole = self.later.where(F.col("n") >= MIN_WORDS).select(F.col("doc").alias("doc_id"), zero.alias("start"), n.alias("end"), F.col("lead").alias("other_doc_id"), zero.alias("other_start"), n.alias("other_end"), n.alias("n_words"), F.lit(1.0).alias("similarity"), F.col("mark").alias("text_hash"))
        return ws.write(got.unionAll(whole), "passages")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ws: Workspace | None = None) -> DataFrame:
    """Passages of more than 50 words that a document shares, exactly or nearly, with an earlier one (of smaller id).

    Returns doc_id, start, end (word offsets, end exclusive), other_doc_id, other_start, other_end, n_words,
    similarity and text_hash (xxhash64 of the document's text), a row a passage and pair. Two passages are near if their sets of 5-word
    shingles have a Jaccard similarity of 0.75 or more. Words are as in the near-duplicate operator. A passage that thousands of
    documents share gives as many rows, not their square: every such document is paired with the first that has
    the passage or with one that does. Copies of a whole text are paired with its first document and searched
    once. Null ids and texts take no part; repeated rows are one document; different texts under one id are
    documents of their own that answer with that id, ordered by text hash. Empty tables give no rows; extra columns are ignored.

    Steps: winnowed seeds of all texts; every seed points to its first occurrence; matches are grouped by text, whose size
    bounds them, and chained; texts are fetched for chained pairs only and aligned. Repeated seeds in no passage found so, whose first
    occurrences may lie in different texts, point once more by longer keys: pairs of seeds that 51 words can hold, then all
    51 words that may be repeated as a whole, which finds every exact passage. Work stays in proportion to the occurrences.
    """
    return Search(docs, ws or Workspace(docs.sparkSession, "passages"), id_col, text_col).run()


def cut_passages(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """docs without the passages that an earlier document has; the columns of documents, n_chars counted again.

    The first document of a passage keeps it. Documents of which nothing but white space is left go; others
    keep all that is not repeated. Rows without a repeated passage pass unchanged, null ids and texts included; rows that repeat
    an id are cut each by the passages of its own text.
    """
    ws = ws or Workspace(docs.sparkSession, "cut")
    found = repeated_passages(docs, ws=ws)
    spans = found.groupBy(F.col("doc_id").alias("d_"), F.col("text_hash").alias("t_")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cut_spans_"))
    spans = bounded(ws.write(spans, "spans"), BROADCAST_ROWS // 2)
    rows = docs.join(spans, (docs["doc_id"] == spans["d_"]) & (F.xxhash64(docs["text"].cast("string")) == spans["t_"]), "left")

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cuts in zip(texts, spans, strict=True):
            if text is None or cuts is None:
                out.append(text)
                continue
            at = [m.span() for m in CHAR_WORD.finditer(text)]
            kept, last = [], 0
            for c in cuts:
                begin, end = at[c["start"]][0], at[c["end"] - 1][1]
                kept.append(text[last : max(begin, last)])
                last = max(last, end)
            left = "".join([*kept, text[last:]])
            out.append(left.strip() or None)
        return pd.Series(out)

    hit = rows.where("cut_spans_ is not null").withColumn("text", without(F.col("text").cast("string"), "cut_spans_")).where("text is not null")
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.char_length("text").cast("long"))
    return rows.where("cut_spans_ is null").select(*docs.columns).unionByName(hit.select(*docs.columns))
