"""Pair classifiers: fit, predict, and linear scores as plain columns."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.similarity import logistic, logit
from tessera.operators.boosting import Trees, fitted, log_odds


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds ``label``: 1 for the pairs of ``truth (s1_id, target_id)``."""
    own = truth.select("s1_id", "target_id").distinct().withColumn("_true", F.lit(1))
    return pairs.join(own, ["s1_id", "target_id"], "left").withColumn("label", F.coalesce("_true", F.lit(0))).drop("_true")


def negatives(s1: DataFrame, targets: DataFrame, truth: DataFrame, among: int = 15, n: int = 5, by: list[str] | None = None) -> DataFrame:
    """The first ``n`` targets that are no match among the first ``among`` of the same country, or of all if ``by`` is empty."""
    by = ["country"] if by is None else by
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("ordinal"))
        few = targets.withColumn("place", place).where(F.col("place") <= among)
    else:
        few = targets.orderBy("ordinal").limit(among).withColumn("place", F.col("ordinal"))
    # at most ``among`` rows for each country
    few = F.broadcast(few.select(*by, F.col("entity_id").alias("target_id"), "place"))
    own = s1.select(F.col("entity_id").alias("s1_id"), *by)
    met = (own.join(few, by) if by else own.crossJoin(few)).join(truth, ["s1_id", "target_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy("place"))
    return met.withColumn("rank", rank).where(F.col("rank") <= n).select("s1_id", "target_id")


def training_pairs(s1: DataFrame, targets: DataFrame, truth: DataFrame, **kwargs) -> DataFrame:
    """(s1_id, target_id, label): the true pairs whose records are there, and negatives for each S1 record."""
    there = truth.distinct().join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi").join(targets.select(F.col("entity_id").alias("target_id")), "target_id", "left_semi")
    yes = there.select("s1_id", "target_id", F.lit(1).alias("label"))
    return yes.union(negatives(s1, targets, truth, **kwargs).withColumn("label", F.lit(0)))


def held_out(pairs: DataFrame, share: float = 0.8, seed: int = 42, buckets: int = 64) -> DataFrame:
    """Adds ``train``: ``share`` of the pairs of each label, by the hash of their ids. Labels are dealt to buckets, so none is one task."""
    order = F.xxhash64("s1_id", "target_id", F.lit(seed))
    group = Window.partitionBy("label", F.pmod(order, F.lit(buckets)))
    place = F.row_number().over(group.orderBy(order, "s1_id", "target_id"))
    return pairs.withColumn("train", place <= F.round(F.count("*").over(group) * share))


def class_sizes(pairs: DataFrame) -> dict[int, int]:
    """Label to rows."""
    return {r["label"]: r["n"] for r in pairs.groupBy("label").agg(F.count("*").alias("n")).collect()}


def balanced(pairs: DataFrame, sizes: dict[int, int] | None = None) -> DataFrame:
    """Adds ``weight``, n / (2 n_class)."""
    sizes = class_sizes(pairs) if sizes is None else sizes
    weight = F.lit(None).cast("double")
    for label, n in sizes.items():
        weight = F.when(F.col("label") == label, F.lit(sum(sizes.values()) / (2.0 * n))).otherwise(weight)
    return pairs.withColumn("weight", weight)


def fit(pairs: DataFrame, features: list[str], trees: bool = False, rounds: int = 300) -> Model | Trees | None:
    """A classifier of balanced classes, or None without pairs of both."""
    sizes = class_sizes(pairs)
    if len(sizes) < 2:
        return None
    if trees:
        n = sum(sizes.values())
        no, yes = (n / (2.0 * sizes[k]) for k in (0, 1))
        return fitted(pairs.select("label", *features), features, (no, yes), log_odds(no * sizes[0], yes * sizes[1]), rounds)
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(balanced(pairs, sizes)).select("features", F.col("label").cast("double").alias("label"), "weight")
    return LogisticRegression(weightCol="weight", regParam=1.0 / sum(sizes.values()), elasticNetParam=0.0, standardization=False, maxIter=500).fit(rows)


def predict(model: Model | Trees | None, pairs: DataFrame, features: list[str]) -> DataFrame:
    """``pairs`` with ``prob``; without a model that is the mean of the features."""
    if model is None:
        return pairs.withColumn("prob", sum(F.col(c) for c in features) / float(len(features)))
    if isinstance(model, Trees):
        return model.predict(pairs)
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(pairs)
    return model.transform(rows).withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def linear(weights: dict[str, float], intercept: float) -> Column:
    z = F.lit(float(intercept))
    for name, weight in weights.items():
        z = z + weight * F.col(name)
    return z


def scored(pairs: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    return pairs.withColumn("prob", logistic(linear(weights, intercept)))


def above(pairs: DataFrame, weights: dict[str, float], intercept: float, threshold: float) -> DataFrame:
    """Pairs at or above a threshold, compared on the logit so that no exponential is needed."""
    return pairs.where(linear(weights, intercept) >= logit(F.lit(threshold)))


def tiered(pairs: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """Equal names with a shared digit are 0.99; others get the linear score."""
    sure = (F.col("exact_name") == 1) & (F.col("digit_overlap") == 1)
    return pairs.withColumn("prob", F.when(sure, F.lit(0.99)).otherwise(logistic(linear(weights, intercept))))
