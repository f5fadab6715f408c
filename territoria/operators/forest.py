"""Regression forests with the reference's preprocessing, on Spark ML.

Numeric features: exact median imputation (fitted on the training rows).
Categorical features: most-frequent imputation (ties -> smallest value),
alphabetical indexing, one-hot with an all-zero vector for unseen values.
Training is distributed by Spark ML; only the fitted model (a few MB of
trees) lives on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage
from .median import exact_medians, most_frequents

NUMERIC = ("anio", "kwh_promedio", "potencia_carga", "consumo_wh_km")
CATEGORICAL = ("departamento", "tipo_vehiculo")
FEATURES_A = ["anio", "departamento", "tipo_vehiculo"]
FEATURES_B = ["anio", "departamento", "tipo_vehiculo", "kwh_promedio", "potencia_carga", "consumo_wh_km"]


def imputation_stats(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """One row: exact median of each numeric and most frequent value of each
    categorical column (smallest value on a tie), fitted on ``train``."""
    fills = {**{f"median_{c}": v for c, v in exact_medians(train, numeric).items()},
             **{f"mode_{c}": v for c, v in most_frequents(train, categorical).items()}}
    kinds = ", ".join([f"median_{c} double" for c in numeric] + [f"mode_{c} string" for c in categorical])
    return train.sparkSession.createDataFrame([tuple(fills.values())], kinds)


class ForestModel:
    """Fitted preprocessing + forest; ``predict`` adds a prediction column."""

    def __init__(self, pipeline: PipelineModel, fills: dict, numeric: list[str], categorical: list[str]):
        self.pipeline, self.fills, self.numeric, self.categorical = pipeline, fills, numeric, categorical

    def _prep(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.numeric:
            out = out.withColumn(f"_f_{c}", F.coalesce(F.col(c).cast("double"), F.lit(self.fills[c])))
        for c in self.categorical:
            out = out.withColumn(f"_f_{c}", F.coalesce(F.col(c).cast("string"), F.lit(self.fills[c])))
        return out

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """Add the prediction ``out``. The trees are walked once per distinct (imputed)
        feature vector and its prediction is joined to the rows: walking them for
        every row costs far more, and only the tasks that hold rows would do it."""
        rows = self._prep(df)
        keys = [f"_f_{c}" for c in self.numeric + self.categorical]
        seen = self.pipeline.transform(rows.select(*keys).distinct())
        found = seen.select(*keys, F.col("_prediction").alias(out))
        return rows.join(found, keys, "left").drop(*keys)

    def feature_importance(self, spark: SparkSession) -> DataFrame:
        """(feature, importance) sorted descending; names follow the
        ``num__col`` / ``cat__col_value`` convention."""
        forest = self.pipeline.stages[-1]
        names = []
        for c in self.numeric:
            names.append(f"num__{c}")
        stages = self.pipeline.stages
        for c in self.categorical:
            idx = next(s for s in stages if hasattr(s, "labels") and s.getOutputCol() == f"_ix_{c}")
            names.extend(f"cat__{c}_{v}" for v in idx.labels)  # unseen bucket dropped
        imp = forest.featureImportances.toArray().tolist()
        rows = list(zip(names, [float(x) for x in imp]))
        return spark.createDataFrame(rows, "feature string, importance double") \
            .orderBy(F.col("importance").desc(), F.col("feature"))


def fit_forest(train: DataFrame, features: Sequence[str], target: str, num_trees: int = 300,
               seed: int = 42, max_depth: int = 30, instances: int | None = 32,
               max_memory_mb: int = 512) -> ForestModel:
    """Fit the preprocessing and a regression forest.

    Rows with equal (imputed) features always fall into the same leaf, so they
    are reduced to their mean target. For the bootstrap a group of n rows stands
    as min(n, ``instances``) instances that share its weight: groups up to that
    size are drawn row by row as in an unreduced fit, larger ones vary a little
    more than row by row. The fit scales with the number of distinct feature
    vectors, not with the number of records; ``instances=None`` fits all rows.
    """
    numeric = [c for c in features if c in NUMERIC]
    categorical = [c for c in features if c in CATEGORICAL]
    stats = imputation_stats(train, numeric, categorical).first()
    fills = {c: (stats[f"median_{c}"] if stats[f"median_{c}"] is not None else 0.0) for c in numeric}
    fills.update({c: (stats[f"mode_{c}"] if stats[f"mode_{c}"] is not None else "") for c in categorical})
    stages = []
    for c in categorical:
        stages.append(StringIndexer(inputCol=f"_f_{c}", outputCol=f"_ix_{c}", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
    if categorical:
        stages.append(OneHotEncoder(inputCols=[f"_ix_{c}" for c in categorical],
                                    outputCols=[f"_oh_{c}" for c in categorical],
                                    handleInvalid="keep", dropLast=True))
    stages.append(VectorAssembler(inputCols=[f"_f_{c}" for c in numeric] + [f"_oh_{c}" for c in categorical],
                                  outputCol="_features"))
    model = ForestModel(None, fills, numeric, categorical)
    prepared = model._prep(train.where(F.col(target).isNotNull()))
    fcols = [f"_f_{c}" for c in numeric + categorical]
    weight = None
    if instances:
        drawn = F.least(F.col("_n"), F.lit(instances))
        # written once: indexers and forest read the few reduced rows, not the records
        prepared = (cut_lineage(prepared.groupBy(*fcols).agg(F.avg(target).alias(target), F.count(F.lit(1)).alias("_n")))
                    .withColumn("_w", F.col("_n") / drawn)
                    .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), drawn))).drop("_n", "_i"))
        weight = "_w"
    rf = RandomForestRegressor(featuresCol="_features", labelCol=target, predictionCol="_prediction",
                               numTrees=num_trees, seed=seed, minInstancesPerNode=1,
                               featureSubsetStrategy="all", maxDepth=max_depth, maxBins=64,
                               subsamplingRate=1.0, bootstrap=True, maxMemoryInMB=max_memory_mb,
                               cacheNodeIds=True)
    if weight:
        rf = rf.setWeightCol(weight)
    model.pipeline = Pipeline(stages=stages + [rf]).fit(prepared)
    return model
