"""The training-data operators against brute force on small fixtures, and their edge cases."""

import io
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import common, minhash, mixing, nndescent, packing, passages, quality, sharding, tokens, topk
from gristmill.llm.common import Workspace, components, words
from gristmill.llm.html_text import extract, main_text
from gristmill.llm.queries import OP1_SQL, op1_minhash, tokenizer_path

WORDS = [f"w{i}" for i in range(4000)]
CLASH = "size int, h int, shard int, label string, n int, sig string, rid int, target int, score int"


def prose(g, n):
    return " ".join(g.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    """Texts, copies, near copies, shared passages, empties, nulls, repeats; extra columns with names that operators use."""
    g = np.random.default_rng(1)
    rows = [(i, prose(g, int(g.integers(3, 300)))) for i in range(60)]
    base = prose(g, 200).split()
    for i in range(60, 75):  # a group of near copies
        w = list(base)
        for k in g.integers(0, 200, 2):
            w[k] = "edit" + str(i)
        rows.append((i, " ".join(w)))
    passage = prose(g, 90)
    rows += [(75 + i, f"{prose(g, 60)}\n{passage} {prose(g, 80)}") for i in range(6)]
    rows += [(90 + i, rows[5][1]) for i in range(12)]
    rows += [(102, ""), (103, None), (104, " \t\n"), (105, "one two"), (106, "ONE two"), (107, "x" * 50_000), (None, "no id"), (None, None), (3, rows[3][1]), (3, rows[3][1])]
    rows = [(d, t, None if i % 17 == 0 else f"s{i % 3}") for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASH.split(", ")]).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def sets(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, empty):
    rows = [(r.doc_id, sets(r.text)) for r in docs.collect()]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[root(i)] += [d] if d is not None else []
    want = Counter((d, len(s), min(low[root(i)], default=None)) for i, (d, s) in enumerate(rows))
    got = minhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_query_gives_the_rows_and_columns_of_its_sql(spark, docs, tmp_path):
    import duckdb

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    res = con.execute(OP1_SQL)
    got = op1_minhash(spark, str(tmp_path))
    assert got.columns == [c[0] for c in res.description]
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "bigint", "boolean"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(res.fetchall())


def test_large_nodes_branch_and_finish(spark, monkeypatch):
    """Nodes far over the limit, one component and many, give the exact components."""
    monkeypatch.setattr(minhash, "NODE_LIMIT", 8)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "WIDE_BLOCK", 4)
    monkeypatch.setattr(minhash, "MAX_DEPTH", 3)
    g = np.random.default_rng(2)
    base = prose(g, 60).split()
    texts = [" ".join(base[:45] + list(g.choice(WORDS, 25))) for _ in range(30)]  # alike, but not enough
    texts += [" ".join(base + [f"z{i}"]) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert all(got[i] == i for i in range(30)) and {got[i] for i in range(30, 60)} == {30}


def test_alike_texts_just_below_and_above(spark, monkeypatch):
    """Links at the very threshold count, in whole nodes and across blocks; a group below it stays apart."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "WIDE_BLOCK", 4)
    w = [f"a{i}" for i in range(53)]
    texts = [" ".join(w[:32]), " ".join(w[:25]), " ".join([*w[:24], "other"])]  # 28 shingles, 21 of them: 0.75 exactly; 20 of 29
    texts += [" ".join([*w[:40], *(f"b{i}_{k}" for k in range(10))]) for i in range(20)]  # 36 shared of 56
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sh = [sets(t) for t in texts]
    linked = {(i, j) for i in range(len(sh)) for j in range(i) if 100 * len(sh[i] & sh[j]) >= 75 * len(sh[i] | sh[j])}
    assert (1, 0) in linked and all(got[i] == got[j] for i, j in linked)
    assert all(got[i] == i for i in range(3, 23))


def test_node_links_are_those_of_brute_force():
    g = np.random.default_rng(8)
    base = g.integers(0, 2**63, 60).astype(np.uint64)
    members = [np.unique(np.concatenate([base[g.random(60) < 0.92], g.integers(0, 2**63, int(g.integers(0, 6))).astype(np.uint64)])) for _ in range(60)]
    labels = np.array([i if i % 3 else 0 for i in range(60)])
    up = {int(x): int(x) for x in labels}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(members[i], members[j]))
            if 100 * both >= 75 * (len(members[i]) + len(members[j]) - both):
                up[root(int(labels[i]))] = root(int(labels[j]))
    want = {frozenset(x for x in up if root(x) == r) for r in {root(x) for x in up}}
    links = minhash.node_links(labels, members)
    up = {x: x for x in up}
    for a, b in links:
        assert root(a) != root(b)  # a forest
        up[root(a)] = root(b)
    assert {frozenset(x for x in up if root(x) == r) for r in {root(x) for x in up}} == want


@pytest.mark.parametrize("text", ["", " \t\n", "One  two\x0bTHREE", "é\x85É ünï\u3000x", "\x00 a\x1c b", "x" * 3_000 + " y " * 900])
def test_word_hashes_follow_words(text, monkeypatch):
    from gristmill.llm import common

    monkeypatch.setattr(common, "_CHUNK", 1000)
    known, h = {}, common.word_hashes(text)
    assert len(h) == len(words(text))
    for w, x in zip(words(text), h.tolist(), strict=True):
        assert known.setdefault(w, x) == x == common.word_hashes(w.decode())[0]
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("small", [0, 20_000])
def test_components_of_a_long_chain(spark, monkeypatch, small):
    from gristmill.llm import common

    monkeypatch.setattr(common, "SMALL_EDGES", small)
    ids = np.random.default_rng(3).permutation(60)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, ids[1:], strict=False)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(Workspace(spark, "t"), edges, "c").collect()}
    assert {got[i] for i in range(60)} == {0} and got[101] == 100
    assert components(Workspace(spark, "t"), edges.where("false"), "c").count() == 0


def test_staged_writes_return_memory_of_the_driver(spark, monkeypatch):
    jvm = spark._jvm
    collected = lambda: sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    ws, trims = Workspace(spark, "memory"), []
    real = common.trim
    monkeypatch.setattr(common, "trim", lambda s: trims.append(real(s)))
    before = collected()
    monkeypatch.setattr(common, "HEAP_SHARE", 1.0)
    assert ws.write(spark.range(5), "a").count() == 5 and trims == [True] and collected() == before
    monkeypatch.setattr(common, "HEAP_SHARE", 0.0)
    assert ws.write(spark.range(5), "b").count() == 5 and trims == [True, True] and collected() > before


def test_mixture(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.size * r.repeats and 0 <= r.repeats <= 3 and len(r.placements or []) == r.repeats
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight, left, total, want = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set(order), sum(size.values()), {}
    while True:  # share, cap, share the excess again
        c = (total - sum(want.values())) / sum(weight[s] for s in left)
        over = {s for s in left if c * weight[s] > 3 * size[s]}
        if not over:
            break
        want |= {s: 3.0 * size[s] for s in over}
        left -= over
    want |= {s: c * weight[s] for s in left}
    assert all(target[s] == pytest.approx(want[s]) and size[s] == r2 for s, r2 in size.items())
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 60 for s in order)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)
    assert mixing.mix_sources(empty).count() == 0


def test_splitting_tree_is_exact(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), (None, 5)], "source string, quota long")
    rows = mixing.split_quotas(quotas, 3, 1).collect()
    per = Counter()
    for r in rows:
        per[r.source] += r.blocks
    assert per == {"a": 1000, "b": 37, None: 5}
    shard = Counter()
    for r in rows:
        shard[r.shard] += r.blocks
    assert max(shard.values()) - min(shard.values()) <= 1


def test_hypergeometric_law(spark):
    d = spark.range(4000).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), (F.col("id") + 0.5) / 4000).alias("x"))
    mean, var = d.agg(F.avg("x"), F.var_pop("x")).first()
    assert mean == pytest.approx(4.0, abs=0.01) and var == pytest.approx(10 * 0.4 * 0.6 * 40 / 49, abs=0.02)


def test_word_vectors_in_little_memory(monkeypatch):
    """The driver fits without the words of its texts as strings, and pieces give the sums of whole texts."""
    import tracemalloc

    g = np.random.default_rng(4)
    texts = [" ".join(f"v{i}" for i in g.integers(0, 200, n)) for n in (100_000, 1, 0, *[100] * 500)]
    tracemalloc.start()
    whole = quality.word_vectors(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    few = [t for t in texts if len(t) < 1000][:40] + ["solo Solo SOLO once", None]
    lists = [quality.tokens(t) for t in few]
    model = quality.word_vectors(few)
    names = list(model.vocabulary)
    index = dict(zip([*names, None], quality.index_vectors([*names, "<unknown>"]), strict=True))
    context, seen = {w: np.zeros(quality.DIMS) for w in index}, Counter()
    for ws in lists:
        ws = [w if w in index else None for w in ws]
        for i, w in enumerate(ws):
            seen[w] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(ws), i + quality.WINDOW + 1)):
                context[w] += index[ws[j]] if j != i else 0
    for w, v in zip([*names, None], model.vectors, strict=True):
        c = context[w] / np.sqrt(max(seen[w], 1))
        assert np.allclose(v, index[w] / np.sqrt(quality.NONZERO) + 0.5 * c / max(np.linalg.norm(c), 1e-9), atol=1e-5)
    monkeypatch.setattr(quality, "PIECE", 7)
    again = quality.word_vectors(texts)
    assert again.vocabulary == whole.vocabulary and np.array_equal(again.vectors, whole.vectors)
    assert len(quality.word_vectors([]).vocabulary) == 0


def test_quality(spark, docs, empty):
    g = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(400):
        t, good = prose(g, 60), i % 3 != 0
        rows.append((i, t if good else " ".join(w + "!!" for w in t.upper().split())))
        labels.append((i, int(good), 0))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(d, lab).join(lab, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) > 0.95
    odd = quality.classify(docs, lab).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.classify(empty, lab).count() == 0
    assert {r.score for r in quality.classify(d, lab.where("false")).collect()} == {0.5}


def test_a_text_over_the_budget_leaves_the_others(spark, monkeypatch):
    d = spark.createDataFrame([(i, "long " * 500 if i % 2 else f"some words {i} again") for i in range(60)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i // 2 % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, y: seen.extend(texts))
    quality.fit(d, lab, max_bytes=2_000)
    assert sum(t.startswith("some") for t in seen) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(0, 60, 2))
    a, b = "x" * 24 + "one", "x" * 24 + "two"
    assert quality.tokens(a) != quality.tokens(b)


def test_token_files(spark, docs, empty):
    enc = tokens.Encoder(tokenizer_path()).tokenizer
    got = tokens.token_round_trip(docs, tokenizer_path()).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*enc.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[(r.doc_id, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    named = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert named == sorted(named)
    assert tokens.token_round_trip(empty, tokenizer_path()).count() == 0


def test_frames_are_independent_and_checked(monkeypatch):
    monkeypatch.setattr(tokens, "FRAME_IDS", 50)
    g, out = np.random.default_rng(5), io.BytesIO()
    docs = [g.integers(0, 50_000, int(n)).astype("<u4").tobytes() for n in g.integers(1, 60, 40)]
    w = tokens.Writer(out)
    for d in docs:
        w.add(d)
    w.close()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    r = tokens.Reader(Source(out.getvalue()))
    seen = []
    monkeypatch.setattr(r, "frame", lambda k, f=r.frame: (seen.append(k), f(k))[1])
    assert list(r.documents([3, 30])) == [(3, docs[3]), (30, docs[30])] and len(seen) == 2 < len(r.table)
    assert [d for _, d in r.documents()] == docs
    raw = bytearray(out.getvalue())
    raw[12] ^= 1
    with pytest.raises(Exception):
        list(tokens.Reader(Source(bytes(raw))).documents([0]))


@pytest.mark.parametrize("text", ["a  b\n\n c", "don't  'll x's", "tab\there  x", "\x1c\x85 x", "中文 ١٢ ² _ <|endoftext|>", " lead", "trail \n", "é" * 300])
def test_encoder_is_that_of_the_library(text):
    e = tokens.Encoder(tokenizer_path())
    ids = [*e.tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert e.ids(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_sharding(docs, empty):
    got = sharding.shard(docs).collect()
    assert len(got) == docs.count()
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    key = lambda rs: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in rs)
    assert key(got) == key(sharding.shard(docs.repartition(5)).collect())
    assert sharding.shard(empty).count() == 0


def test_shard_weights(spark):
    """Rows move across the ancestors of a changed weight only: its shard, its rack, its region."""
    d = spark.range(40_000).select(F.col("id").alias("doc_id"))
    key = F.col("doc_id")
    w = [1, 1, 1, 1, 1, 1, 1, 3]
    moved = {(r[0], r[1]): r[2] for r in d.groupBy(sharding.shard_of(key, 8), sharding.shard_of(key, 8, w)).count().collect()}
    for (a, b), _ in moved.items():
        if a // 4 == b // 4 == 0:  # the other region
            assert a == b
        elif a // 4 == b // 4:
            assert a == b or b // 2 == 3  # into the rack of the changed shard
            assert a // 2 != 3 or a == b or b == 7
        else:
            assert (a // 4, b // 4) == (0, 1)  # into its region
    to = Counter()
    for (_, b), n in moved.items():
        to[b] += n
    assert all(to[s] == pytest.approx(4000 * w[s], rel=0.06) for s in range(8))
    grown = {(r[0], r[1]): r[2] for r in d.groupBy(sharding.shard_of(key, 8), sharding.grown_shard_of(key, 8)).count().collect()}
    assert all(b in (a, 8) for a, b in grown) and sum(n for (_, b), n in grown.items() if b == 8) == pytest.approx(40_000 / 9, rel=0.06)


@pytest.fixture(scope="module")
def vectors(spark):
    g = np.random.default_rng(6)
    rows = [(i, g.normal(size=12).tolist()) for i in range(150)]
    for c in range(5):
        center = g.normal(size=12)
        rows += [(200 + 20 * c + i, (center + 0.12 * g.normal(size=12)).tolist()) for i in range(20)]
    rows += [(400 + i, rows[0][1]) for i in range(6)] + [(410, None), (411, []), (412, [0.0] * 12), (413, [1.0, None] + [0.0] * 10), (414, [float("nan")] + [1.0] * 11), (415, [1.0, 2.0]), (None, rows[3][1]), (5, rows[5][1]), (416, [1e300] * 12), (417, [1e-300] * 12)]
    return spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "vec_id long, embedding array<double>, label int, n int").persist()


def good(v, zero=False):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))


def test_near_vectors(vectors):
    rows = vectors.collect()
    unit = [None if not good(r.embedding) else np.array(r.embedding) / max(map(abs, r.embedding)) for r in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    near = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in range(len(rows))]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min((rows[j].vec_id for j in seen if rows[j].vec_id is not None), default=None)
    want = Counter((r.vec_id, len(near[i]), comp[i]) for i, r in enumerate(rows))
    got = nndescent.near_vectors(vectors).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert nndescent.near_vectors(vectors.where("false")).count() == 0


def test_a_hot_group_hides_no_pairs(spark, monkeypatch):
    """Pairs that the first buckets part are found, though nearly all links are those of one tight group."""
    monkeypatch.setattr(nndescent, "TABLES", 1)
    monkeypatch.setattr(nndescent, "ROUNDS", 0)
    g = np.random.default_rng(12)
    center, rows = g.normal(size=16), []
    rows += [(i, (center + 0.01 * g.normal(size=16)).tolist()) for i in range(400)]
    for i in range(200):
        v = g.normal(size=16)
        rows += [(1000 + 2 * i, v.tolist()), (1001 + 2 * i, (v + 0.08 * np.linalg.norm(v) * g.normal(size=16)).tolist())]
    u = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    got = {r.vec_id: r.component_id for r in nndescent.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    linked = [i for i in range(1000, 1400, 2) if u[i] @ u[i + 1] >= 0.9]
    assert len(linked) > 50 and all(got[i] == got[i + 1] for i in linked)


def test_top_k(vectors):
    rows = [(r.vec_id, np.floor(1024 * np.array(r.embedding)).astype(object)) for r in vectors.collect() if r.vec_id is not None and good(r.embedding, True) and r.vec_id != 416]
    got = defaultdict(list)
    for r in topk.top_k(vectors.where("vec_id <> 416"), 10, 100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    qs = [(i, v) for i, v in rows if i % 100 == 0]
    assert set(got) == {i for i, _ in qs}
    for i, q in qs:
        all_ = sorted((-sum(int(a) * int(b) for a, b in zip(q, v, strict=False)), j) for j, v in rows if j != i)[:10]
        assert got[i] == [(j, -s) for s, j in all_]
    assert topk.top_k(vectors.where("false")).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, tokenizer_path(), 256).collect()
    per = defaultdict(list)
    for r in rows:
        per[r.sequence_id].append((r.offset, r.length))
    for places in per.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 256
    enc = tokens.Encoder(tokenizer_path())
    total = sum(len(enc.ids(r.text)) // 4 for r in docs.collect())
    assert sum(r.length for r in rows) == total
    assert len(per) <= sum(packing.longest_first(Counter(r.length for r in rows), 256).values())
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_configurations_hold_the_histogram():
    h = {2048: 7, 1500: 40, 900: 55, 548: 60, 300: 100, 17: 300, 1: 5}
    got = packing.solve(h)
    held = Counter()
    for config, times in got:
        assert sum(config) <= 2048
        for n in config:
            held[n] += times
    assert held == h
    assert sum(t for _, t in got) <= sum(packing.longest_first(Counter(h), 2048).values())
    assert sum(t for _, t in packing.solve({700: 21, 600: 21, 748: 21})) == 21
    assert packing.solve({}) == [] and packing.solve({5: 1}) == [((5,), 1)]


def test_pieces_are_those_of_the_tokenizer(spark):
    """piece, start, length and checksum of every row, over-long documents at 2048 included."""
    g = np.random.default_rng(31)
    texts = [prose(g, n) for n in (1, 300, 1500, 4000, 9000)] + [None, "", "x" * 30_000, prose(g, 300)]
    enc, want = tokens.Encoder(tokenizer_path()).tokenizer, Counter()
    for i, t in enumerate(texts):
        ids = [*enc.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) - 2048 * ((len(ids) - 1) // 2048)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])))] += 1
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_path()).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    per = defaultdict(list)
    for r in rows:
        per[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(p)[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(sorted(p), sorted(p)[1:], strict=False)) and sum(n for _, n in p) <= 2048 for p in per.values())


def test_passages(docs, empty):
    rows = passages.repeated_passages(docs).collect()
    text = {r.doc_id: words(r.text) for r in docs.collect() if r.doc_id is not None and r.text is not None}
    assert rows and all(r.other_doc_id < r.doc_id and r.end - r.start > 50 and r.similarity >= 0.75 for r in rows)
    runs = defaultdict(set)
    for d, w in text.items():
        for i in range(len(w) - 50):
            runs[tuple(w[i : i + 51])].add(d)
    later = {d for s in runs.values() for d in s - {min(s)}}
    assert later <= {r.doc_id for r in rows}
    clean = {d for d in text if d < 60} - {5}
    assert not clean & {r.doc_id for r in rows}
    cut = {r.doc_id: r.text for r in passages.cut_passages(docs).collect()}
    assert all(cut[d] == t for d, t in ((r.doc_id, r.text) for r in docs.collect()) if d in clean)
    assert len(words(cut[76])) <= 145 and 91 not in cut
    assert passages.repeated_passages(empty).count() == 0 and passages.cut_passages(empty).count() == 0


def test_chain_follows_the_order():
    xs, ys = [0, 5, 10, 15, 20], [100, 105, 3, 115, 120]
    assert passages.chain(xs, ys)[0] == [0, 1, 3, 4]
    assert passages.chain([0, 500], [0, 500]) == [[0], [1]]


def test_passages_of_mosaics(spark):
    """Pieces that occur earlier in other documents, alone or between, hide no partner; nor does an edited first copy."""
    g = np.random.default_rng(11)
    whole, r = prose(g, 90).split(), prose(g, 110).split()
    p, q, both = " ".join(whole[:50]), " ".join(whole[40:]), " ".join(whole)
    edited = r[:]
    edited[55] = "edit"
    around = lambda t: f"{prose(g, 40)} {t} {prose(g, 40)}"
    texts = [around(p), around(q), around(both), *[around(t) for _ in range(5) for t in (p, q)], around(both)]
    texts += [around(" ".join(t)) for t in (r[:45], r[40:85], r[75:], r, edited)]
    texts += [around(p) for _ in range(3)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.doc_id, x.other_doc_id): (x.start, x.end) for x in passages.repeated_passages(d).collect()}
    assert got == {(13, 2): (40, 130), (18, 17): (40, 150)}


def test_passages_that_first_occur_in_parts(spark):
    """The halves of what two documents share occur first, alone and too short, in others; and texts under one id are told apart."""
    g = np.random.default_rng(21)
    p = prose(g, 80).split()
    around = lambda t: f"{prose(g, 45)} {t} {prose(g, 45)}"
    q = prose(g, 70)
    rows = [(0, around(" ".join(p[:40]))), (1, around(" ".join(p[40:]))), (2, around(" ".join(p))), (3, around(" ".join(p)))]
    rows += [(5, prose(g, 120)), (5, around(q)), (6, around(q)), (7, rows[3][1]), (None, around(q)), (8, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.other_doc_id): (x.start, x.end) for x in passages.repeated_passages(d).collect()}
    assert got == {(3, 2): (45, 125), (6, 5): (45, 115), (7, 3): (0, 170)}
    kept = passages.cut_passages(d).collect()
    assert sorted(len(words(r.text)) for r in kept if r.doc_id == 5) == [120, 160] and [len(words(r.text)) for r in kept if r.doc_id == 6] == [90]
    assert not [r for r in kept if r.doc_id == 7] and sum(r.doc_id is None for r in kept) == 1


def test_fuzzy_passages_against_brute_force(spark):
    """Copies of passages with an edit for each 40 words: the edited stretch is found whole; one with too many edits is not."""
    g = np.random.default_rng(22)
    rows, want, n = [], {}, 0
    for n_words in (60, 90, 160, 400):
        for _ in range(12):
            p = prose(g, n_words).split()
            e = p[:]
            at = np.arange(20, n_words - 15, 40) + g.integers(0, 10)
            for k in at[at < n_words - 10]:
                e[k] = f"edit{n}"
            lead, tail = int(g.integers(0, 60)), int(g.integers(0, 60))
            rows += [(n, f"{prose(g, 30)} {' '.join(p)} {prose(g, 30)}"), (n + 1, " ".join([*g.choice(WORDS, lead), *e, *g.choice(WORDS, tail)]))]
            a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (p, e))
            if len(a & b) >= 0.75 * len(a | b):
                want[n + 1] = (lead, lead + n_words, n)
            n += 2
    for _ in range(10):  # every tenth word differs
        p = prose(g, 200).split()
        rows += [(n, " ".join(p)), (n + 1, " ".join(w if i % 10 else "no" for i, w in enumerate(p)))]
        n += 2
    got = {x.doc_id: (x.start, x.end, x.other_doc_id) for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 40 and set(got) <= {n for n in range(96)}
    assert all(d in got and got[d][2] == o and got[d][0] <= s + 2 and got[d][1] >= e - 2 for d, (s, e, o) in want.items())


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>site</header><nav><a href=/>home</a></nav>
<div class="cookie-notice">we use cookies</div><div id=content><div class="post"><h1>Head &amp; line</h1><p>First   <b>bold</b> text&nbsp;here, long enough to weigh something in any density.<p>Second
line with <a href=x>a link</a> and more words to make it the main part of the page.</div></div>
<div class="sidebar"><a href=1>one</a><a href=2>two</a></div><div class="comments"><p>reader says a great deal here, too much in fact to be ignored</p></div>
<form><input>Name</form><script>if (a < b) { x("</p>") }</script><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    assert main_text(PAGE).split("\n\n") == ["Head & line", "First bold text here, long enough to weigh something in any density.", "Second line with a link and more words to make it the main part of the page."]
    assert main_text("<article><p>cut &am") == "cut &am" and main_text("<article><p>x</p><p>y</p") == "x\n\ny"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>a</p>"), (4, "u", "plain text"), (5, "u", "<div>" * 3000 + "deep")]
    got = extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got][1:3] == ["", ""]


@pytest.mark.parametrize("keep", ['<div class="related-work"><p>{}</p></div>', '<h2 id="comments-on-method">{}</h2>', '<p class="notice">{}</p>', '<div class="content with-sidebar"><p>{}</p></div>', '<section id="reply-to-critics"><p>{}</p></section>', '<ul><li>{}</li></ul>', "<table><tr><td>{}</td></tr></table>", "<blockquote>{}</blockquote>"])
def test_names_alone_drop_no_article_text(keep):
    words = "some forty words of this very article that no list of names may take from it, long enough to count"
    page = f"<body><nav><a href=/>home</a></nav><article><h1>Title</h1><p>First {words}.</p>{keep.format(words)}<p>Last {words}.</p></article><footer>end</footer></body>"
    assert main_text(page).split("\n\n") == ["Title", f"First {words}.", words, f"Last {words}."]


@pytest.mark.parametrize("drop", ['<div class="ad">{}</div>', '<div class="reader-feedback"><p>{}</p></div>', '<section id="comments"><p>{}</p></section>', '<div class="box cookie-notice">{}</div>', "<aside>{}</aside>", "<form>{}</form>", '<div role="alert">{}</div>', '<ul class="share-links"><li>{}</li></ul>'])
def test_furniture_inside_the_article_goes(drop):
    words = "words that many readers would say below an article or that somebody paid for to be seen there"
    page = f"<body><article><h1>Title</h1><p>First {words}.</p>{drop.format(words)}<p>Last {words}.</p></article></body>"
    assert main_text(page).split("\n\n") == ["Title", f"First {words}.", f"Last {words}."]


def test_self_closed_svg_is_empty():
    assert main_text("<article><p>one</p><svg class='x' /><p>two <math/>three</p><svg><path/>no</svg></article>") == "one\n\ntwo three"


def test_pipeline_on_odd_tables(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    g = np.random.default_rng(0)
    spark.createDataFrame([(i, int(g.integers(0, 2)), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    deduped = corpus_pipeline.near_dedup(spark, d, str(tmp_path)).collect()
    ids = [r.doc_id for r in deduped if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 60 in ids and 61 not in ids and 90 not in ids and len(deduped) - len(ids) == 2
    mixed = corpus_pipeline.mix(spark, d, str(tmp_path))
    assert mixed.columns == d.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[0] == "doc_id" and out.count() > 0
