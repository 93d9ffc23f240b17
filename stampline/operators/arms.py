"""Model arms, declarations and verdicts."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampline.operators.discrimination import auprc, auroc, brier

#: Search grid of the boosted-tree arms (fixed values).
SEARCH_SPACE = {
    "num_leaves": [15, 31, 63, 127],
    "min_child_samples": [10, 20, 50, 100],
    "learning_rate": [0.02, 0.05, 0.1],
    "feature_fraction": [0.6, 0.8, 1.0],
    "bagging_fraction": [0.6, 0.8, 1.0],
    "lambda_l2": [0.0, 1.0, 10.0],
}


# ---- arms -------------------------------------------------------------------

def prevalence_arm(df: DataFrame, label: str, split: str, by: list[str] | None = None,
                   train: str = "train") -> DataFrame:
    """Score every row with the train-split mean of its label."""
    by = by or []
    rate = F.avg(F.col(label).cast("double")).alias("score")
    base = df.where(F.col(split) == train)
    if not by:
        return df.crossJoin(F.broadcast(base.agg(rate)))  # one row
    return df.join(F.broadcast(base.groupBy(*by).agg(rate)), by, "left")  # declared cells


def tree_params(trial: dict) -> dict:
    """Map the declared grid to Spark's boosted trees; L2 on leaves has no counterpart there."""
    return {
        "maxDepth": min(10, max(2, math.ceil(math.log2(trial.get("num_leaves", 31))))),
        "minInstancesPerNode": trial.get("min_child_samples", 20),
        "stepSize": trial.get("learning_rate", 0.1),
        "featureSubsetStrategy": str(float(trial.get("feature_fraction", 1.0))),
        "subsamplingRate": trial.get("bagging_fraction", 1.0),
    }


def fit_gbt_arm(matrix: DataFrame, label: str, numeric: list[str], categorical: list[str], split: str,
                trial: dict | None = None, seed: int = 0, max_iter: int = 30):
    """Boosted trees on the train split, stopped early on the validation split.

    A NULL number gets an indicator and a constant below every value, so one split can isolate
    it; a NULL category is a level of its own. Spark stops on validation loss, not on AUROC. Without
    validation rows all rounds are fitted. Trees get as many bins as the widest category has levels.
    """
    rows = with_tree_columns(matrix, label, numeric, categorical).where(F.col(split).isin("train", "val")) \
        .withColumn("is_val", F.col(split) == "val")
    indexed = [f"{c}__i" for c in categorical]
    stages, levels = [], 0
    if categorical:
        index = StringIndexer(inputCols=[f"{c}__s" for c in categorical], outputCols=indexed, handleInvalid="keep").fit(rows)
        levels = max(map(len, index.labelsArray))
        stages.append(index)
    validation = {"validationIndicatorCol": "is_val"} if rows.where("is_val").head(1) else {}
    features = [f"{c}__x" for c in numeric] + [f"{c}__na" for c in numeric] + indexed
    stages.append(VectorAssembler(inputCols=features, outputCol="features"))
    stages.append(GBTClassifier(labelCol="target", featuresCol="features", maxIter=max_iter, seed=seed,
                                maxBins=max(BINS, levels + 1), **validation, **tree_params(trial or {})))
    return Pipeline(stages=stages).fit(rows)


#: Bins of a number; a category needs one per level and one for unseen ones.
BINS = 64
#: Stands in for a NULL number; far below any feature value.
MISSING_NUMBER = -1.0e9


def with_tree_columns(df: DataFrame, label: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    new = {"target": F.col(label).cast("double")}
    for c in numeric:
        new[f"{c}__x"] = F.coalesce(F.col(c).cast("double"), F.lit(MISSING_NUMBER))
        new[f"{c}__na"] = F.col(c).isNull().cast("double")
    for c in categorical:
        new[f"{c}__s"] = F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    return df.withColumns(new)


def predict(model, matrix: DataFrame, label: str, numeric: list[str], categorical: list[str],
            keep: list[str]) -> DataFrame:
    """(keep, y, score) for every row of the matrix."""
    rows = model.transform(with_tree_columns(matrix, label, numeric, categorical))
    return rows.select(*keep, F.col("target").cast("int").alias("y"),
                       vector_to_array("probability")[1].alias("score"))


def trials(budget: int, seed: int = 0) -> list[dict]:
    """Seeded draws from the declared grid."""
    rng = random.Random(seed)
    return [{k: rng.choice(v) for k, v in SEARCH_SPACE.items()} for _ in range(budget)]


def random_search(matrix: DataFrame, label: str, numeric: list[str], categorical: list[str], split: str,
                  budget: int, seed: int = 0, parallel: int = 2, max_iter: int = 10) -> DataFrame:
    """(trial, parameters, val_auroc, best): scored on the validation split only; none is best without one.

    Each fit is a distributed job; a few run side by side. Only one number per trial comes back.
    """
    return search_shared({label: matrix}, numeric, categorical, split, budget, seed, parallel, max_iter)


def search_shared(matrices: dict[str, DataFrame], numeric: list[str], categorical: list[str], split: str,
                  budget: int, seed: int = 0, parallel: int = 2, max_iter: int = 10) -> DataFrame:
    """One configuration for all labels: the trial with the best mean validation AUROC."""
    plan = trials(budget, seed)

    def run(job):
        i, label = job
        matrix = matrices[label]
        model = fit_gbt_arm(matrix, label, numeric, categorical, split, plan[i], 0, max_iter)
        scored = predict(model, matrix.where(F.col(split) == "val"), label, numeric, categorical, [])
        found = auroc(scored, "y", "score").first()
        return i, label, found.auroc if found else None

    jobs = [(i, label) for i in range(budget) for label in matrices]
    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(run, jobs))
    spark = next(iter(matrices.values())).sparkSession
    scores = spark.createDataFrame(done, "trial int, label string, auroc double")
    grid = spark.createDataFrame(
        [(i, *[float(plan[i][k]) for k in SEARCH_SPACE]) for i in range(budget)],
        "trial int, " + ", ".join(f"{k} double" for k in SEARCH_SPACE))
    mean = scores.groupBy("trial").agg(F.avg("auroc").alias("val_auroc"), F.count("auroc").alias("n_labels"))
    out = grid.join(mean, "trial")
    top = out.agg(F.max(F.struct("val_auroc", (-F.col("trial")).alias("t"))).alias("_m")) \
        .select((-F.col("_m.t")).alias("_best"))
    best = (F.col("trial") == F.col("_best")) & F.col("val_auroc").isNotNull()
    return out.crossJoin(F.broadcast(top)).withColumn("best", best).drop("_best")


def score_arm(preds: DataFrame, by: list[str]) -> DataFrame:
    """AUROC, average precision, Brier score, counts and prevalence per cell."""
    roc = auroc(preds, "y", "score", by).withColumn("n_items", F.col("n_pos") + F.col("n_neg"))
    squares = brier(preds, "y", "score", by).drop("n_items")
    return roc.join(auprc(preds, "y", "score", by), by).join(squares, by).select(
        *by, "auroc", "auprc", "brier", "n_items", F.col("n_pos").alias("n_positives"),
        (F.col("n_pos") / F.col("n_items")).alias("prevalence"))


# ---- declarations and verdicts ----------------------------------------------

def declared_membership(runs: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Runs whose cell was never declared; they must be refused."""
    return runs.join(declared.select(*keys).distinct(), keys, "left_anti")


def require_declared(runs: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    stray = declared_membership(runs, declared, keys).select(*keys).first()
    if stray is not None:
        raise ValueError(f"undeclared run: {stray.asDict()}")
    return runs


def completeness_gate(cells: DataFrame, required: DataFrame, min_seeds: int = 5) -> DataFrame:
    """(arm, label, problem) for every missing cell and every cell short of seeds."""
    missing = required.join(cells, ["arm", "label"], "left_anti") \
        .select("arm", "label", F.lit("missing").alias("problem"), F.lit(0).cast("bigint").alias("n_seeds"))
    short = cells.join(required, ["arm", "label"], "left_semi").where(F.col("n_seeds") < min_seeds) \
        .select("arm", "label", F.lit("seeds short").alias("problem"), "n_seeds")
    return missing.unionByName(short)


def gate_verdict(problems: DataFrame, required: DataFrame, noise: DataFrame, min_seeds: int = 5) -> DataFrame:
    """One row: required cells, problems, whether every floor is measured, PASS or INCOMPLETE."""
    n = required.agg(F.count(F.lit(1)).alias("n_required"))
    bad = problems.agg(F.count_if(F.col("problem") == "missing").alias("n_missing"),
                       F.count_if(F.col("problem") == "seeds short").alias("n_short"))
    floors = noise.agg(F.coalesce(F.bool_and((F.col("n_seeds") >= min_seeds) & F.col("seed_spread").isNotNull()),
                                  F.lit(False)).alias("floors_measured"))
    ok = (F.col("n_missing") == 0) & (F.col("n_short") == 0) & F.col("floors_measured")
    return n.crossJoin(bad).crossJoin(floors).withColumn("result", F.when(ok, "PASS").otherwise("INCOMPLETE"))


def tolerance_branch(arms: DataFrame, arm: str, reference: str, tolerance: float = 0.03) -> DataFrame:
    """Per label: reference minus arm, and whether the gap is within tolerance."""
    wide = arms.groupBy("label").agg(
        F.max(F.when(F.col("arm") == arm, F.col("auroc"))).alias("arm_auroc"),
        F.max(F.when(F.col("arm") == reference, F.col("auroc"))).alias("reference_auroc"))
    gap = F.col("reference_auroc") - F.col("arm_auroc")
    return wide.dropna().withColumns({"gap": gap, "within_tolerance": gap <= tolerance})


def reproduction_gap(macro: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """Seed mean, range and spread against every published anchor and its interval.

    `anchors` is a short declared table (anchor, role, published, lo, hi).
    """
    m = F.col("macro_auroc")
    per = macro.groupBy(*by).agg(F.avg(m).alias("local_mean"), F.min(m).alias("local_min"), F.max(m).alias("local_max"),
                                 (F.max(m) - F.min(m)).alias("seed_spread"), F.count(m).alias("n_seeds"))
    return per.crossJoin(F.broadcast(anchors)).withColumns({
        "gap": F.col("local_mean") - F.col("published"),
        "inside_published": F.col("local_mean").between(F.col("lo"), F.col("hi"))})


def sparse_targets(per_target: DataFrame, target: str, below: int = 50) -> DataFrame:
    """Targets whose smallest positive count over the runs is under the limit."""
    return per_target.groupBy(target).agg(F.min("n_pos").alias("min_positives")) \
        .where(F.col("min_positives") < below)
