"""Gates as Spark ML estimators: they fit into pipelines, and are saved and loaded by Spark ML's own writers.

Rows have features (array of doubles) and y (0 or 1); fitted ones add p, the probability of class 1, and prediction. Both estimators give a
PipelineModel, a linear gate of one stage and a perceptron of four.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions import numeric
from ravelin.plans import gate

VECTOR, SCALED, BOTH = "_vector", "_scaled", "_both"


class LinearGateModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A linear gate as a transformer; its weights and bias are parameters, and so are saved."""

    weights = Param(Params._dummy(), "weights", "of the features", TypeConverters.toListFloat)
    bias = Param(Params._dummy(), "bias", "added to the weighted sum", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, weights: list[float] | None = None, bias: float = 0.0):
        super().__init__()
        self._set(weights=weights or [], bias=bias)

    def gate(self) -> gate.LinearGate:
        return gate.LinearGate(self.getOrDefault(self.weights), self.getOrDefault(self.bias))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return gate.with_probability(dataset, self.gate()).withColumn("prediction", (F.col("p") >= 0.5).cast("double"))


class LinearGateEstimator(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Weights from the mean of class 0 to that of class 1."""

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        own = gate.fit_linear(dataset)
        return PipelineModel([LinearGateModel(weights=own.weights, bias=own.bias)])


class ToVector(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Features as a vector."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(VECTOR, array_to_vector(F.col("features")))


class ClassOne(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The second of two probabilities as p; columns of the stages before go."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("p", F.get(vector_to_array(F.col(BOTH)), F.lit(1))).drop(VECTOR, SCALED, BOTH, "rawPrediction")


class PerceptronEstimator(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Spark ML's scaler and perceptron of two hidden layers, stopped early: an analogue of the trainers' network, as units and solver are others.

    Of rows of LEAST_ROWS groups or more a share of the groups, by a hash of id, is held out. The weights are trained on by `step` iterations at a time, each
    from where the last one ended, until the loss on these rows has not fallen `patience` times, or `maxIter` is reached; the best weights stay. Rows of one class give a linear gate.
    """

    LEAST_ROWS = 20
    hidden = Param(Params._dummy(), "hidden", "units of the hidden layers", TypeConverters.toListInt)
    seed = Param(Params._dummy(), "seed", "of the first weights and the held-out groups", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "iterations at most", TypeConverters.toInt)
    step = Param(Params._dummy(), "step", "iterations between two looks at the loss", TypeConverters.toInt)
    patience = Param(Params._dummy(), "patience", "looks without a lower loss", TypeConverters.toInt)
    validation = Param(Params._dummy(), "validation", "share of groups held out, in percent", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, hidden: list[int] | None = None, seed: int = 42, maxIter: int = 100, step: int = 20, patience: int = 2, validation: int = 10):  # noqa: N803
        super().__init__()
        self._set(hidden=hidden or [128, 64], seed=seed, maxIter=maxIter, step=step, patience=patience, validation=validation)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        if dataset.select("y").distinct().limit(2).count() < 2:
            return LinearGateEstimator().fit(dataset)
        of = lambda p: self.getOrDefault(p)
        vectors = ToVector().transform(dataset)
        scaler = StandardScaler(inputCol=VECTOR, outputCol=SCALED, withMean=True).fit(vectors)
        rows = scaler.transform(vectors).withColumn("_label", F.col("y").cast("double"))
        group = F.col("id").cast("string") if "id" in dataset.columns else F.to_json(F.struct("features"))
        rows = rows.withColumn("_held", F.pmod(F.xxhash64(F.lit(of(self.seed)), group), F.lit(100)) < of(self.validation)).select(SCALED, "_label", "_held").cache()
        try:
            sides = {(r["_held"], r["_label"]): r["count"] for r in rows.groupBy("_held", "_label").count().collect()}
            stop_early = sum(sides.values()) >= self.LEAST_ROWS and all(sides.get((held, y)) for held in (False, True) for y in (0.0, 1.0))
            fitted = self._trained(rows, rows.filter("NOT _held") if stop_early else rows, rows.filter("_held") if stop_early else None)
        finally:
            rows.unpersist()
        return PipelineModel([ToVector(), scaler, fitted, ClassOne()])

    def _trained(self, rows: DataFrame, train: DataFrame, held: DataFrame | None):
        of = lambda p: self.getOrDefault(p)
        layers = [rows.first()[SCALED].size, *of(self.hidden), 2]
        best, least, worse, weights, done = None, float("inf"), 0, None, 0
        step = of(self.step) if held is not None else of(self.maxIter)
        while done < of(self.maxIter) and worse < of(self.patience):
            learner = MultilayerPerceptronClassifier(layers=layers, seed=of(self.seed), maxIter=step, featuresCol=SCALED, labelCol="_label", probabilityCol=BOTH)
            if weights is not None:
                learner = learner.setInitialWeights(weights)
            model = learner.fit(train)
            weights, done = model.weights, done + step
            loss = self.loss(model, held) if held is not None else 0.0
            best, least, worse = (model, loss, 0) if best is None or loss < least - 1e-4 else (best, least, worse + 1)
        return best

    @staticmethod
    def loss(model, rows: DataFrame) -> float:
        """Mean negative log likelihood."""
        p = F.get(vector_to_array(F.col(BOTH)), F.col("_label").cast("int"))
        return model.transform(rows).agg(F.avg(-F.log(F.greatest(p, F.lit(numeric.TOLERANCE))))).first()[0]
