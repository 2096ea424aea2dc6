"""Classifiers of trees over feature columns: fitted, saved and loaded with the map of their labels, and scored out of fold.

Boosted trees serve two labels, forests any number. Nulls and NaN among the features count as 0. Labels are any values;
they are numbered densely in the order of their texts, and the model keeps that order, so scores carry labels and not numbers.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.staging import kept

LABEL, INDEX, WEIGHT, INPUT, PREFIX = "__label", "__index", "__weight", "__input", "__x_"


def _prepared(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({PREFIX + c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features})


def fit(df: DataFrame, features: list[str], label: str, weights: dict | None = None, boosted: bool = False, trees: int = 40, depth: int = 5, seed: int = 42) -> PipelineModel:
    """A model of the rows with a label; ``weights`` give rows of some labels another weight than 1."""
    rows = df.where(F.col(label).isNotNull())
    weight = F.lit(1.0)
    for value, w in (weights or {}).items():
        weight = F.when(F.col(label) == value, float(w)).otherwise(weight)
    rows = _prepared(rows, features).withColumns({LABEL: F.col(label).cast("string"), WEIGHT: weight})
    how = {"featuresCol": INPUT, "labelCol": INDEX, "weightCol": WEIGHT, "maxDepth": depth, "seed": seed}
    learner = GBTClassifier(maxIter=trees, **how) if boosted else RandomForestClassifier(numTrees=trees, **how)
    stages = [
        StringIndexer(inputCol=LABEL, outputCol=INDEX, stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=[PREFIX + c for c in features], outputCol=INPUT),
        learner,
    ]
    return Pipeline(stages=stages).fit(rows)


def labels_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``predicted``, and a column ``p_<label>`` for each label that the model knows."""
    names = labels_of(model)
    features = [c.removeprefix(PREFIX) for c in model.stages[1].getInputCols()]
    found = PipelineModel(model.stages[1:]).transform(_prepared(df, features))
    chance = vector_to_array("probability")
    columns = {f"p_{n}": F.get(chance, F.lit(k)) for k, n in enumerate(names)}
    predicted = F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int"))
    return found.withColumns({**columns, "predicted": predicted}).select(*df.columns, "predicted", *columns)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def out_of_fold(assigned: DataFrame, features: list[str], label: str, **how) -> DataFrame:
    """Rows of ``splits.assign`` (with ``fold`` and ``role``): each fold's test rows, scored by a model of its training rows.

    A fold without two labels to learn gives no rows. Folds are few and trained one after the other, each over all executors.
    """
    assigned = kept(assigned)  # each fold reads it several times
    found = None
    for (fold,) in sorted(assigned.select("fold").distinct().collect()):
        mine = assigned.where(F.col("fold") == fold)
        train = mine.where("role = 'train'")
        if train.select(label).where(F.col(label).isNotNull()).distinct().limit(2).count() < 2:
            continue
        part = score(fit(train, features, label, **how), mine.where("role = 'test'")).drop("role")
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return assigned.where("false").drop("role").withColumn("predicted", F.lit(None).cast("string")) if found is None else found
