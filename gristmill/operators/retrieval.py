"""Retrieval over records of earlier verdicts, and the checks that such records must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K1, B = 1.4, 0.7
MIN_SCORE = 1.0
TOP = 8
# fixed values: what counts as a term
LATIN = r"[a-z0-9][a-z0-9_+\-.]*"
CJK = r"[一-鿿]+"


def tokenize(text: Column) -> Column:
    """Lower-cased Latin terms, then character pairs of runs of Chinese characters (a lone character is a term)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    latin = F.regexp_extract_all(low, F.lit(LATIN), F.lit(0))
    pairs = lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))))
    return F.concat(latin, F.flatten(F.transform(F.regexp_extract_all(low, F.lit(CJK), F.lit(0)), pairs)))


def bm25(docs: DataFrame, query: str, top: int = TOP, min_score: float = MIN_SCORE) -> DataFrame:
    """The best records (id, text) for a query: (rank, id, score), ties by id.

    Query terms count once. Only occurrences of query terms leave the scan; lengths and document
    frequencies are aggregates, and the answer is one ordered limit.
    """
    spark = docs.sparkSession
    q = spark.range(1).select(F.explode(F.array_distinct(tokenize(F.lit(query)))).alias("term"))
    d = docs.select("id", tokenize(F.col("text")).alias("terms"))
    stats = d.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("terms")).alias("avg_len"))
    occ = d.select("id", F.size("terms").alias("len"), F.explode("terms").alias("term")).join(F.broadcast(q), "term")  # terms of one query
    tf = occ.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    s = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    best = s.groupBy("id").agg(F.sum(part).alias("score")).where(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(top)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id"))).select("rank", "id", "score")


def prior_text(priors: DataFrame) -> DataFrame:
    """(id, text) for retrieval."""
    words = F.concat_ws(" ", "claim", "verdict", "evidence", "lesson", F.array_join("killed_by", " "), F.array_join("applies_to", " "))
    return priors.select("id", words.alias("text"))


def validate(priors: DataFrame, modes: DataFrame) -> DataFrame:
    """(problem, id, what): one row for each fault of the records."""
    blank = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0
    row = lambda d, problem, what: d.select(F.lit(problem).alias("problem"), "id", what.cast("string").alias("what"))
    live = blank("withdrawn")
    causes = priors.select("id", F.explode("killed_by").alias("mode")).join(F.broadcast(modes.select(F.col("id").alias("mode"))), "mode", "left_anti")  # the fixed list
    out = row(causes, "unknown_mode", F.col("mode"))
    out = out.unionAll(row(priors.where((F.col("verdict") == "REJECTED") & (F.coalesce(F.size("killed_by"), F.lit(0)) <= 0)), "no_cause", F.col("verdict")))
    out = out.unionAll(row(priors.where((F.length("lesson") < 20) | (F.length("evidence") < 10)), "thin", F.lit("")))
    out = out.unionAll(row(priors.groupBy("id").count().where("count > 1"), "duplicate_id", F.lit("")))
    out = out.unionAll(row(priors.where((~blank("superseded_by") & live) | (~live & (F.length("withdrawn") < 20))), "withdrawn_without_reason", F.col("withdrawn")))
    missing = priors.where(~blank("superseded_by")).join(priors.select(F.col("id").alias("superseded_by")).distinct(), "superseded_by", "left_anti")
    return out.unionAll(row(missing, "superseded_by_missing", F.col("superseded_by")))


def checklist(hits: DataFrame, modes: DataFrame) -> DataFrame:
    """(rank, mode, n, name): causes of the live records among the hits, the commonest first, then by id."""
    live = hits.where(F.length(F.trim(F.coalesce("withdrawn", F.lit("")))) == 0)
    n = live.select(F.explode("killed_by").alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))
    got = n.join(F.broadcast(modes.select(F.col("id").alias("mode"), "name")), "mode")
    return got.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "mode"))).select("rank", "mode", "n", "name")
