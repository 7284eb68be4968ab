"""Per-horizon classifiers with Spark ML, uniform scoring and importances."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import FEATURES
from tidewatch.functions.columns import sigmoid, unit_draw

WINDOW, SEQUENCE = "window", "sequence"


def _perceptron(size: int):
    return MultilayerPerceptronClassifier(layers=[size, 256, 128, 2], maxIter=80, seed=1337, blockSize=256)


def _boosting(size: int):
    # a tenth of the rows is kept out; rounds end when its loss no longer falls
    return GBTClassifier(maxIter=300, stepSize=0.07, maxDepth=5, seed=1337, validationIndicatorCol="kept_out", validationTol=0.001)


MODELS: dict[str, Callable] = {
    "logistic_regression": lambda size: LogisticRegression(maxIter=2000, regParam=0.01, tol=1e-4),
    "random_forest": lambda size: RandomForestClassifier(numTrees=300, maxDepth=30, minInstancesPerNode=2, seed=1337),  # 30: the most Spark allows
    "gradient_boosting": _boosting,
    "mlp": _perceptron,
    "linear_svc": lambda size: LinearSVC(maxIter=4000, regParam=0.01, tol=1e-4),
    "gaussian_nb": lambda size: NaiveBayes(modelType="gaussian"),
}


@dataclass
class HorizonModel:
    """One fitted classifier (or a constant) per horizon step."""
    name: str
    input_kind: str
    steps: list = field(default_factory=list)      # fitted model or float


def model_input(rows: DataFrame, kind: str = WINDOW) -> DataFrame:
    """Scaled sequences -> ``features`` vector: the last window, or the whole history flattened."""
    flat = F.element_at("x", -1) if kind == WINDOW else F.flatten("x")
    return rows.withColumn("features", array_to_vector(flat))


def balanced_weight(label: Column, share: float) -> Column:
    """0.5 / p for positives, 0.5 / (1 - p) for the rest."""
    p = max(share, 1e-6)
    return F.when(label == 1, 0.5 / p).otherwise(0.5 / max(1.0 - p, 1e-6))


def fit_horizons(train: DataFrame, name: str, horizon: int, kind: str = WINDOW) -> HorizonModel:
    """K independent fits; a step with one class becomes the constant predictor of that class.

    Rows are weighted so that both classes count alike; a classifier without weights gets rows repeated by their weight.
    """
    draw = vector_to_array("features").cast("string")
    rows = model_input(train, kind).select("features", "y_atk").withColumn("kept_out", unit_draw(1337, F.lit("kept out"), draw) < 0.1).persist()
    try:
        return _fit_steps(rows, name, horizon, kind)
    finally:
        rows.unpersist()


def _fit_steps(rows: DataFrame, name: str, horizon: int, kind: str) -> HorizonModel:
    shares = rows.agg(*[F.avg(F.col("y_atk")[k].cast("double")).alias(f"p{k}") for k in range(horizon)],
                      F.max("kept_out").alias("kept_out")).first()
    size = len(rows.select(vector_to_array("features").alias("a")).first()["a"])
    out = HorizonModel(name, kind)
    for k in range(horizon):
        share = shares[f"p{k}"]
        if share in (0.0, 1.0):
            out.steps.append(float(share))
            continue
        label = F.col("y_atk")[k]
        data = rows.select("features", "kept_out", label.cast("double").alias("label"), balanced_weight(label, share).alias("weight"))
        estimator = MODELS[name](size)
        if estimator.hasParam("validationIndicatorCol") and not shares["kept_out"]:
            estimator.clear(estimator.validationIndicatorCol)
        if estimator.hasParam("weightCol"):
            estimator.setWeightCol("weight")
        else:
            data = repeated(data)
        out.steps.append(estimator.fit(data))
    return out


def repeated(data: DataFrame) -> DataFrame:
    """Each row floor(weight) times, and once more with the rest as chance, by a draw of its features."""
    more = unit_draw(1337, F.lit("repeat"), vector_to_array("features").cast("string")) < F.col("weight") - F.floor("weight")
    copies = F.floor("weight").cast("int") + more.cast("int")
    return data.withColumn("_c", copies).where("_c > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_c")))).drop("_c")


def _probability(model) -> Column:
    if "probability" in [p.name.removesuffix("Col") for p in model.params]:
        return vector_to_array("probability")[1]
    return sigmoid(vector_to_array("rawPrediction")[1])


def predict(rows: DataFrame, model: HorizonModel) -> DataFrame:
    """Add ``attack_prob``: array with one probability per horizon step."""
    out = model_input(rows, model.input_kind)
    for k, step in enumerate(model.steps):
        if isinstance(step, float):
            out = out.withColumn(f"_p{k}", F.lit(step))
            continue
        scored = step.transform(out)
        out = scored.withColumn(f"_p{k}", _probability(step)).drop("rawPrediction", "probability", "prediction")
    names = [f"_p{k}" for k in range(len(model.steps))]
    return out.withColumn("attack_prob", F.array(*names)).drop("features", *names)


def predict_with(rows: DataFrame, score: Callable, horizon: int, batch: int = 512) -> DataFrame:
    """Any user predictor ``score(x [N, L, F], dt [N, L]) -> [N, horizon]``, run in Arrow batches inside the tasks."""
    import numpy as np
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    shape = rows.select(F.size("x").alias("l"), F.size(F.element_at("x", 1)).alias("f")).first()

    def make():
        def call(x, dt):
            return np.asarray(score(x, dt), dtype=float)
        return call

    udf = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch,
                            input_tensor_shapes=[[shape["l"], shape["f"]], [shape["l"]]])
    return rows.withColumn("attack_prob", udf(F.flatten("x"), F.col("dt")))


def importance(model: HorizonModel, step: int, features=FEATURES, top: int = 15) -> list[tuple[str, float]]:
    """Largest normalised absolute coefficients or tree importances of one horizon step."""
    fitted = model.steps[step]
    if isinstance(fitted, float):
        return []
    values = [abs(float(v)) for v in (fitted.coefficients if hasattr(fitted, "coefficients") else fitted.featureImportances).toArray()]
    names = list(features) if model.input_kind == WINDOW else [
        f"{f}@{i - len(values) // len(features) + 1}" for i in range(len(values) // len(features)) for f in features]
    total = sum(values) + 1e-12
    return sorted(((n, v / total) for n, v in zip(names, values)), key=lambda p: -p[1])[:top]


def importance_table(spark, model: HorizonModel, step: int, features=FEATURES, top: int = 15) -> DataFrame:
    return spark.createDataFrame(importance(model, step, features, top), "feature string, importance double")
