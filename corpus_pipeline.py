"""From raw documents to packed sequences: five stages over the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import Workspace, bounded
from gristmill.llm.minhash import one_of_each
from gristmill.llm.mixing import mix_sources
from gristmill.llm.packing import pack
from gristmill.llm.passages import cut_passages
from gristmill.llm.quality import classify
from gristmill.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.7 or more), unchanged."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, keep=docs.columns).where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group of near duplicates, unchanged."""
    return one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    return cut_passages(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: every document as often as it is taken, with the columns of documents."""
    repeats = mix_sources(docs).where("repeats > 0").groupBy(F.col("doc_id").alias("id_")).agg(F.max("repeats").alias("repeats"))
    repeats = bounded(Workspace(spark, "stage-mix").write(repeats, "repeats"))
    rows = docs.join(repeats, docs["doc_id"].eqNullSafe(repeats["id_"]))
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixture in sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_path(), capacity=2048)


STAGES = [("quality classifier", quality), ("near-duplicate documents", near_dedup), ("repeated passages", passages), ("source mixture", mix), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again before the next."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.write(docs, f"stage-{k}")
    return docs
