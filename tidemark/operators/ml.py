"""Boosted trees over the master table's features, and what they rest on."""

from __future__ import annotations

import math
import tempfile

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import roc_auc
from tidemark.schema import ORDER, PART, TIMEFRAMES, name_for

#: Stands for a missing value; below every feature.
LOW = -1e9
#: Numeric bases of the feature matrix, and the codes of states (fixed values).
NUMERIC = ("A_macd", "A_signal", "A_hist", "A_hist_slope", "A_macd_sign", "A_hist_sign", "A_macd_zero_cross", "A_hist_zero_cross", "B_gap", "B_gap_norm", "B_roc", "B_roc_invalid", "B_zroc", "B_gap_acc", "B_roc_slope", "B_zroc_extreme")
CODES = {"bull_accel": 2, "bull_decel": 1, "bear_decel": -1, "bear_accel": -2}


def feature_columns() -> list[str]:
    """73 names: 18 bases on four bar sizes, and the place in the session."""
    return ["bar_in_session", *[name_for(b, tf) for tf in TIMEFRAMES for b in (*NUMERIC, "A_state", "B_state")]]


def feature_matrix(master: DataFrame, ret: str = "ret_fwd_12", part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Rows with a return: features as doubles, states by their codes (none is 0), and y, whether the return is positive."""
    codes = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    cols = [F.coalesce(codes[F.col(c)], F.lit(0)).cast("double").alias(c) if "_state" in c else F.col(c).cast("double").alias(c) for c in feature_columns()]
    return master.where(F.col(ret).isNotNull()).select(*part, order, *cols, (F.col(ret) > 0).cast("int").alias("y"))


def class_balance(matrix: DataFrame, part: list[str] = PART) -> DataFrame:
    return matrix.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("n_pos"), F.avg(F.col("y").cast("double")).alias("share_pos"))


def cut_lineage(spark: SparkSession) -> None:
    """Boosting writes its residuals every ten rounds to the session's checkpoint folder; a local session without one gets a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if folder := spark.conf.get("spark.checkpoint.dir", None):
            context.setCheckpointDir(folder)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))


def train(matrix: DataFrame, cols: list[str], depth: int = 4, trees: int = 20, rate: float = 0.05, seed: int = 42, rows_per_task: int = 65_536) -> PipelineModel:
    """Gradient-boosted trees; missing values are filled with an impossible low one, which trees split off.

    A round is a job a level, so the rows are held in as many tasks as their number asks for.
    """
    cut_lineage(matrix.sparkSession)
    narrow = matrix.select("y", *cols).fillna(LOW, subset=cols).persist()
    filled = narrow.repartition(max(1, math.ceil(narrow.count() / rows_per_task))).persist()
    try:
        return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), GBTClassifier(labelCol="y", maxDepth=depth, maxIter=trees, stepSize=rate, seed=seed, checkpointInterval=10)]).fit(filled)
    finally:
        filled.unpersist()
        narrow.unpersist()


def predict(model: PipelineModel, matrix: DataFrame, cols: list[str]) -> DataFrame:
    return model.transform(matrix.fillna(LOW, subset=cols)).withColumn("p", vector_to_array("probability")[1])


def auc(model: PipelineModel, matrix: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    return roc_auc(predict(model, matrix, cols), "y", "p", keys or [])


def permutation_importance(model: PipelineModel, matrix: DataFrame, cols: list[str], tried: list[str], repeats: int = 2, seed: int = 42) -> DataFrame:
    """(feature, mean_drop, sd_drop) of the area under the curve when a feature's values are dealt anew.

    A repeat pairs each row with another of its series, once for all features; in every
    pair each tried feature in turn is taken from the partner, and all are scored in one pass.
    """
    from tidemark.operators.rules import shuffled
    from tidemark.operators.sequence import with_bar_idx

    base = auc(model, matrix, cols).first()["auc"]
    rows = with_bar_idx(matrix.fillna(LOW, subset=cols)).select(*PART, "bar_idx", "y", F.array(*cols).alias("_x"))
    again = rows.withColumns({"repeat": F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))), "_other": F.col("_x")})
    dealt = shuffled(again, "_other", F.col("repeat") + seed, [*PART, "repeat"])
    places = F.create_map(*[F.lit(x) for c in tried for x in (c, cols.index(c))])
    each = dealt.select("repeat", "y", "_x", "_other", F.explode(places).alias("feature", "_k"))
    mixed = F.concat(F.slice("_x", 1, F.col("_k")), F.slice("_other", F.col("_k") + 1, 1), F.slice("_x", F.col("_k") + 2, len(cols)))
    scored = model.stages[-1].transform(each.select("repeat", "y", "feature", array_to_vector(mixed).alias("features")))
    areas = roc_auc(scored.withColumn("p", vector_to_array("probability")[1]), "y", "p", ["feature", "repeat"])
    drop = F.lit(base) - F.col("auc")
    return areas.groupBy("feature").agg(F.avg(drop).alias("mean_drop"), F.stddev_pop(drop).alias("sd_drop"))


def top_splits(model: PipelineModel, cols: list[str], n: int = 3) -> list[tuple[str, float, float]]:
    """(feature, threshold, gain) of the first tree's root and its children, best gain first."""
    root = model.stages[-1].trees[0]._call_java("rootNode")
    nodes = [root] + ([root.leftChild(), root.rightChild()] if root.subtreeDepth() else [])
    found = [(cols[x.split().featureIndex()], float(x.split().threshold()), float(x.gain())) for x in nodes if x.subtreeDepth() and x.split().getClass().getSimpleName() == "ContinuousSplit"]
    return sorted(found, key=lambda s: -s[2])[:n]
