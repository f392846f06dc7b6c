"""Training and scoring of the three-class direction model.

An estimator fits samples with ``features`` (array), ``label`` and ``weight`` and adds ``down``, ``flat``, ``up``. The default is
Spark ML's random forest, which trains on the cluster and keeps samples where they are; ``boosted`` is a sequence of small
trees for each class, whose probabilities are scaled to sum to 1; ``softmax`` is one sequence for all classes, trained from a
binned store by :mod:`bookflow.operators.boosting`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.operators import signals
from bookflow.operators.boosting import Booster

#: Default thresholds of the five horizons.
THRESHOLDS = {5: 0.88, 10: 0.82, 20: 0.78, 40: 0.70, 60: 0.65}
#: Named settings: trees, depth, bins.
PRESETS = {"fast": {"numTrees": 20, "maxDepth": 5}, "standard": {"numTrees": 100, "maxDepth": 8}, "deep": {"numTrees": 300, "maxDepth": 12, "maxBins": 64}}
#: The same for boosted trees: rounds at most, depth, step. The trees' lineage is cut in ``spark.checkpoint.dir``.
BOOSTED = {"fast": {"maxIter": 20, "maxDepth": 3, "stepSize": 0.2}, "standard": {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1}, "deep": {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "maxBins": 64}}
CLASSES = range(3)


@dataclass
class DirectionModel:
    preset: str = "fast"
    kind: str = "forest"
    seed: int = 42
    options: dict = field(default_factory=dict)
    fitted: object = None

    def _vectors(self, samples: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return samples.withColumn("__x", array_to_vector(F.transform("features", lambda v: v.cast("double"))))

    def fit(self, samples: DataFrame, validation: str | None = None) -> DirectionModel:
        """``validation``: a boolean column of rows that don't train. Boosting ends when its error over them no longer falls,
        and the trees of the best round stay; other kinds leave these rows out."""
        from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

        if self.kind == "softmax":
            raise ValueError("softmax boosting trains from a store of binned samples: Booster.fit")
        if self.kind == "boosted":
            vectors, stop = self._vectors(samples), {} if validation is None else {"validationIndicatorCol": validation}
            booster = GBTClassifier(featuresCol="__x", labelCol="__one", weightCol="weight", seed=self.seed, **stop, **{**BOOSTED[self.preset], **self.options})
            self.fitted = [booster.fit(vectors.withColumn("__one", (F.col("label") == k).cast("double"))) for k in CLASSES]
            return self
        if validation is not None:
            samples = samples.filter(~F.col(validation))

        common = {"featuresCol": "__x", "labelCol": "label", "weightCol": "weight", "probabilityCol": "__p"}
        if self.kind == "forest":
            estimator = RandomForestClassifier(seed=self.seed, **common, **{**PRESETS[self.preset], **self.options})
        else:
            estimator = LogisticRegression(family="multinomial", **common, **self.options)
        self.fitted = estimator.fit(self._vectors(samples))
        return self

    def score(self, samples: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        if self.kind == "softmax":
            return self.fitted.score(samples)
        if self.kind == "boosted":
            scored = self._vectors(samples)
            for k, booster in zip(CLASSES, self.fitted):
                passed = booster.copy({booster.probabilityCol: f"__p{k}", booster.rawPredictionCol: f"__r{k}", booster.predictionCol: f"__c{k}"}).transform(scored)
                scored = passed.withColumn(f"__p{k}", vector_to_array(f"__p{k}")[1]).drop(f"__r{k}", f"__c{k}")
            total = sum((F.col(f"__p{k}") for k in CLASSES), F.lit(0.0))
            return scored.withColumns({name: F.col(f"__p{k}") / total for k, name in zip(CLASSES, ("down", "flat", "up"))}).drop("__x", *(f"__p{k}" for k in CLASSES))
        scored = self.fitted.transform(self._vectors(samples)).withColumn("__a", vector_to_array("__p"))
        part = lambda k: F.coalesce(F.get("__a", F.lit(k)), F.lit(0.0))
        return scored.withColumns({"down": part(0), "flat": part(1), "up": part(2)}).drop("__x", "__p", "__a", "rawPrediction", "prediction")

    def rounds(self) -> list[int]:
        """Boosting rounds kept for each class, the best round where validation rows were given."""
        if self.kind == "softmax":
            return [len(self.fitted.rounds)] * len(CLASSES)
        return [m.getNumTrees for m in self.fitted]

    def save(self, path: str) -> None:
        if self.kind == "softmax":
            from pyspark.sql import SparkSession

            self.fitted.save(SparkSession.active(), path)
            return
        if self.kind == "boosted":
            for k, booster in zip(CLASSES, self.fitted):
                booster.write().overwrite().save(f"{path}/{k}")
            return
        self.fitted.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, kind: str = "forest") -> DirectionModel:
        from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel

        if kind == "softmax":
            from pyspark.sql import SparkSession

            return cls(kind=kind, fitted=Booster.load(SparkSession.active(), path))
        if kind == "boosted":
            return cls(kind=kind, fitted=[GBTClassificationModel.load(f"{path}/{k}") for k in CLASSES])
        return cls(kind=kind, fitted=(RandomForestClassificationModel if kind == "forest" else LogisticRegressionModel).load(path))

    def importances(self, names: list[str], most: int = 20) -> list[tuple[str, float]]:
        """The features that the trees gain most from; of boosted trees, the mean of the classes."""
        if self.kind == "softmax":
            return self.fitted.importances(names, most)
        fitted = self.fitted if self.kind == "boosted" else [self.fitted]
        gains = sum(m.featureImportances.toArray() for m in fitted) / len(fitted)
        return sorted(zip(names, gains.tolist()), key=lambda x: -x[1])[:most]


def predict(samples: DataFrame, models: dict[int, DirectionModel], thresholds: dict[int, float] = THRESHOLDS) -> DataFrame:
    """Signals of every horizon for each sample, in one table."""
    for horizon, model in models.items():
        scored = model.score(samples)
        rule = signals.threshold_rule(F.col("down"), F.col("flat"), F.col("up"), F.lit(thresholds.get(horizon, 0.88)))
        samples = scored.withColumn(f"signal_{horizon}", rule).drop("down", "flat", "up")
    return samples
