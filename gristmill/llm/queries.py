"""The queries of this folder, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP1_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS sh
  FROM d),
n AS (SELECT r, doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT r, unnest(sh) AS x FROM s),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS both FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.r = i.a JOIN n y ON y.r = i.b WHERE 100 * i.both >= 75 * (x.n + y.n - i.both)),
c(a, b) AS (SELECT r, r FROM n UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT c.a, min(n.doc_id) AS component_id FROM c JOIN n ON n.r = c.b GROUP BY c.a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, coalesce(n.doc_id = m.component_id, false) AS kept FROM n JOIN m ON m.a = n.r
"""


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "repeats", "placements")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_round_trip

    return token_round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=8)


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nndescent import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   AND len(list_filter(embedding, lambda x: x <> 0)) > 0
              THEN CAST(embedding AS DOUBLE[]) END AS e
  FROM embeddings),
l AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r
  WHERE a.e IS NOT NULL AND b.e IS NOT NULL AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
c(a, b) AS (SELECT r, r FROM v UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT c.a, min(v.vec_id) AS component_id FROM c JOIN v ON v.r = c.b GROUP BY c.a),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, m.component_id, coalesce(v.vec_id = m.component_id, false) AS kept
FROM v JOIN m ON m.a = v.r LEFT JOIN d ON d.a = v.r
"""


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash, op2_mix_sources, op3_quality, op4_token_frames, op5_shard_tree, op6_nn_descent, op7_main_text, op8_pack_sequences, op9_exact_topk, op10_passages)
}
ORACLES: dict[str, str] = {"op1_minhash": OP1_SQL, "op6_nn_descent": OP6_SQL, "op9_exact_topk": OP9_SQL}
