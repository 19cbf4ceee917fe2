"""Cross-validated gradient boosting of target-decoy candidates."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.operators.fdr import fold
from ionloom.runtime import shared_dir, stored

# Fixed values of the surveyed boosting.
ROUNDS, DEPTH, PATIENCE = 1000, 6, 100


def prepared(rows: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Features as doubles, missing ones 0 with a flag of their own."""
    cols, names = [], []
    for c in features:
        v = F.col(c).cast("double")
        bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        cols += [F.when(bad, 0.0).otherwise(v).alias(f"_x_{c}"), bad.cast("double").alias(f"_m_{c}")]
        names += [f"_x_{c}", f"_m_{c}"]
    return rows.select("*", *cols), names


def _boosted(train: DataFrame, held_out: DataFrame, rounds: int, depth: int, patience: int = PATIENCE):
    """The model of at most ``rounds`` rounds that is best on ``held_out``: training stops once ``patience``
    rounds brought nothing. Spark can't go on with a model, so a longer one starts anew, twice as long;
    its first rounds are the same, as each has its own seed."""
    from pyspark.ml.classification import GBTClassificationModel, GBTClassifier

    sc = train.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        # Cuts the lineage of the errors, which grows with every round.
        sc.setCheckpointDir(shared_dir(train.sparkSession))
    n = min(rounds, patience + patience // 4)
    while True:
        m = GBTClassifier(featuresCol="_v", labelCol="_y", weightCol="_w", maxIter=n, maxDepth=depth, stepSize=0.1, seed=42, subsamplingRate=0.8).fit(train)
        loss = m.evaluateEachIteration(held_out)
        best = next((i for i in range(n) if min(loss[i + 1 : i + 1 + patience], default=float("inf")) >= loss[i] and loss[i] == min(loss[: i + 1])), n - 1)
        if n == rounds or best + patience < n:
            break
        n = min(rounds, 2 * n)
    jvm, kept = train.sparkSession._jvm, m._java_obj
    trees, weights = (sc._gateway.new_array(kind, best + 1) for kind in (jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, jvm.double))
    for i, (tree, weight) in enumerate(zip(list(kept.trees())[: best + 1], list(kept.treeWeights()))):
        trees[i], weights[i] = tree, weight
    cut = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(kept.uid(), trees, weights, kept.numFeatures(), kept.numClasses()))
    cut = m._copyValues(cut)
    cut._transfer_params_to_java()
    return cut


def rescore(rows: DataFrame, features: list[str], is_target: str = "is_target", key: str = "id", rounds: int = ROUNDS, depth: int = DEPTH, folds: int = 3) -> DataFrame:
    """Adds discriminant_score (the margin). Each fold is scored by the model trained on another and
    stopped early by a third; targets weigh half. A fold without both classes leaves 0 scores, with a warning."""
    from pyspark.ml.feature import VectorAssembler

    p, names = prepared(rows, features)
    p = p.withColumn("_fold", fold(key, n=folds)).withColumn("_y", F.col(is_target).cast("double")).withColumn("_w", F.when(F.col(is_target), 0.5).otherwise(1.0))
    p = stored(p)
    v = VectorAssembler(inputCols=names, outputCol="_v").transform(p)
    seen = {(r[0], r[1]) for r in p.select("_fold", "_y").distinct().collect()}
    out = None
    for i in range(folds):
        train, val, test = i, (i + 1) % folds, (i + 2) % folds
        part = v.filter(F.col("_fold") == test)
        if {(f, y) for f in (train, val) for y in (0.0, 1.0)} <= seen:
            m = _boosted(v.filter(F.col("_fold") == train), v.filter(F.col("_fold") == val), rounds, depth)
            part = _margin(m.transform(part))
        else:
            warnings.warn(f"fold {test} has no scores: folds {train} and {val} don't both hold targets and decoys", stacklevel=2)
            part = part.withColumn("discriminant_score", F.lit(0.0))
        part = part.select(*rows.columns, "discriminant_score")
        out = part if out is None else out.unionByName(part)
    return stored(out)


def _margin(scored: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return scored.withColumn("discriminant_score", vector_to_array("rawPrediction")[1])


def importances(rows: DataFrame, features: list[str], is_target: str = "is_target", key: str = "id", rounds: int = ROUNDS, depth: int = DEPTH) -> list[tuple[str, float]]:
    """Features by their share of the split gain, of a model on all rows."""
    from pyspark.ml.feature import VectorAssembler

    p, names = prepared(rows, features)
    p = p.withColumn("_y", F.col(is_target).cast("double")).withColumn("_w", F.when(F.col(is_target), 0.5).otherwise(1.0)).withColumn("_val", fold(key, n=5) == 0)
    v = VectorAssembler(inputCols=names, outputCol="_v").transform(stored(p))
    m = _boosted(v.filter("not _val"), v.filter("_val"), rounds, depth)
    gain = {c: 0.0 for c in features}
    for name, g in zip(names, m.featureImportances.toArray()):
        gain[name[3:]] += float(g)
    return sorted(gain.items(), key=lambda t: (-t[1], t[0]))


def refit_mobility(rows: DataFrame) -> tuple[list[float], float, float]:
    """(coefficients, intercept, mean absolute error in percent) of the mobility model on (mz, charge,
    mobility): five features, a loss that outliers don't rule."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    q = F.col("mz") * F.col("mz") / F.col("charge")
    x = rows.na.drop().select("mobility", F.log(F.col("mz") + 1).alias("a"), F.col("mz").alias("b"), F.log(q + 1).alias("c"), q.alias("d"), F.col("charge").cast("double").alias("e"))
    v = VectorAssembler(inputCols=list("abcde"), outputCol="v").transform(x)
    m = LinearRegression(featuresCol="v", labelCol="mobility", loss="huber", maxIter=100).fit(v)
    mape = m.transform(v).select(F.avg(F.abs(F.col("prediction") - F.col("mobility")) / F.col("mobility")) * 100).first()[0]
    return m.coefficients.tolist(), m.intercept, mape
