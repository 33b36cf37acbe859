"""A corpus from raw documents to packed sequences, in stages that each read what the stage before has written.

All stages hold for odd inputs: null and empty texts are documents without words or lines and stay until mixing, which
takes no words of them; rows with a null id are documents of their own; very long texts are read whole; further columns
of any name stay with their rows; an empty table gives an empty one. Rows are judged one by one, also those that share
an id, but for near duplicates, where the id names the document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastmark.llm import common, line_dedup, mixing, near_dedup, packing, toxicity
from pastmark.llm.queries import tokens


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier predicts to be toxic go; other rows of the same id stay."""
    common.text_batches(spark)
    return toxicity.fit(docs, common.table(spark, sf_dir, "labels")).clean(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in one of them only; all rows stay, null ids with all lines."""
    common.text_batches(spark)
    return line_dedup.without_shared_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, similarity of 0.8 or more), once if its row is
    repeated. Documents without words and rows with a null id are nobody's duplicates."""
    common.text_batches(spark)
    gone = common.saved(near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct())
    # Rows with a null id match nothing, so they are dealt by their text and not all to one task.
    dealt = common.fresh(docs, "dealt")
    away = F.when(F.col("doc_id").isNull(), F.coalesce(F.xxhash64("text"), F.lit(1))).otherwise(0)
    ids = common.small(gone.withColumn(dealt, F.lit(0).cast("long")), gone.count(), 16)
    kept = docs.withColumn(dealt, away).join(ids, ["doc_id", dealt], "left_anti").select(*docs.columns)
    # Of rows that repeat an id and a text, one stays; only rows of such ids are moved for it.
    times = kept.where("doc_id is not null").groupBy("doc_id", F.xxhash64("text").alias("mark")).agg(F.count("*").alias("n"))
    again = common.saved(times.where("n > 1").select("doc_id").distinct())
    n_again = again.count()
    if not n_again:
        return kept
    ids = common.small(again, n_again, 8)
    once = kept.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(ids, "doc_id", "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights; a row is what one round takes of a document. Documents without words
    end here. Null sources are one source."""
    common.text_batches(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of several lengths; each row of the mix is tokenised by itself."""
    common.text_batches(spark)
    return packing.pack(docs, tokens())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The stages hold a trained model and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written as Parquet in the shared folder and read again. A stage's
    output is removed when the next one is written; the last stays."""
    common.shared_checkpoints(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = f"{folder}/corpus-{uuid.uuid4().hex}"
    docs, before = common.table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.removed(spark, before)
        before = path
    return docs
