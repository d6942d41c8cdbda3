"""A corpus pipeline of four stages over documents.

Toxic documents go, one document of each class of near copies stays, documents that
hold benchmark windows go, and what is left is encoded to pieces and decoded again.
Each stage is written as Parquet beside the session's checkpoints and read again as
the next one's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, pieces, tokens, toxicity
from tidemark.llm.common import checkpoint_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score below the threshold; learns from the labelled documents of its input."""
    model = toxicity.fit(docs, toxicity.train_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, COLUMNS).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every class, and documents without words or without an id."""
    classes = jaccard.similar_classes(docs)
    copies = classes.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no window of a benchmark item occurs."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, and whether they decode to its text."""
    return pieces.round_trip(docs, tokens.model_path(), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("decontamination", drop_contaminated), ("pieces", encode)]
#: No stage can be said in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
