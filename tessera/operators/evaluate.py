"""Measures of predicted links against a ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f_half(p: Column, r: Column) -> Column:
    return F.when(0.25 * p + r > 0, 1.25 * p * r / (0.25 * p + r)).otherwise(F.lit(0.0))


def precision_recall(n_true: Column, n_pred: Column, tp: Column) -> tuple[Column, Column]:
    both = (n_true == 0) & (n_pred == 0)
    return F.when(both, 1.0).when(n_pred > 0, tp / n_pred).otherwise(0.0), F.when(both, 1.0).when(n_true > 0, tp / n_true).otherwise(0.0)


def entity_scores(s1_ids: DataFrame, truth: DataFrame, predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F0.5 for each S1 id; right singletons score 1. Predictions outside ``s1_ids`` are ignored."""
    by = by or []
    base = s1_ids
    t = truth.distinct().groupBy("s1_id").agg(F.count("*").alias("n_true"))
    p = predicted.select(*by, "s1_id", "target_id").distinct()
    marked = p.join(truth.distinct().withColumn("hit", F.lit(1)), ["s1_id", "target_id"], "left")
    n = marked.groupBy(*by, "s1_id").agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    out = base.join(t, "s1_id", "left").join(n, [*by, "s1_id"], "left").na.fill(0, ["n_true", "n_pred", "tp"])
    precision, recall = precision_recall(F.col("n_true"), F.col("n_pred"), F.col("tp"))
    return out.withColumns({"precision": precision, "recall": recall}).withColumn("f05", f_half(F.col("precision"), F.col("recall")))


def macro(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9).alias(c)
    return scores.groupBy(*(by or [])).agg(mean("precision"), mean("recall"), mean("f05"))


def sweep(s1_ids: DataFrame, truth: DataFrame, best: DataFrame, grid: DataFrame) -> DataFrame:
    """Macro scores for each threshold of a small ``grid``. ``best`` is assigned once; the arg-max has no threshold in it.

    One aggregate counts an S1 record's predictions and hits at all thresholds at once.
    """
    levels = sorted(r["threshold"] for r in grid.select("threshold").collect())
    own = truth.distinct()
    marked = best.groupBy("s1_id", "target_id").agg(F.max("prob").alias("prob")).join(own.withColumn("hit", F.lit(True)), ["s1_id", "target_id"], "left")
    at = [F.col("prob") >= F.lit(t) for t in levels]
    n = marked.groupBy("s1_id").agg(F.array(*map(F.count_if, at)).alias("n_pred"), F.array(*(F.count_if(x & F.col("hit")) for x in at)).alias("tp"))
    each = s1_ids.join(own.groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left").join(n, "s1_id", "left").na.fill(0, ["n_true"])
    nothing = F.array(*[F.lit(0).cast("long")] * len(levels))
    each = each.select("n_true", F.coalesce("n_pred", nothing).alias("n_pred"), F.coalesce("tp", nothing).alias("tp"))

    def scored(i: int) -> list[Column]:
        precision, recall = precision_recall(F.col("n_true"), F.col("n_pred")[i], F.col("tp")[i])
        mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9)
        return [mean(precision).alias("precision"), mean(recall).alias("recall"), mean(f_half(precision, recall)).alias("f05")]

    row = each.agg(*(F.struct(F.lit(t).alias("threshold"), *scored(i)).alias(f"t{i}") for i, t in enumerate(levels)))
    return row.select(F.inline(F.array(*row.columns)))


def best_of(swept: DataFrame, score: str = "f05") -> DataFrame:
    """The lowest of the best thresholds."""
    return swept.agg(F.max_by(F.struct("threshold", score), F.struct(F.col(score), -F.col("threshold"))).alias("b")).select("b.*")


def pair_sweep(labelled: DataFrame, grid: DataFrame, beta: float = 0.5) -> DataFrame:
    """Pair-level F-beta for each threshold."""
    hit, true = F.col("prob") >= F.col("threshold"), F.col("label") == 1
    n = labelled.crossJoin(F.broadcast(grid)).groupBy("threshold").agg(
        F.count(F.when(hit & true, 1)).alias("tp"), F.count(F.when(hit & ~true, 1)).alias("fp"), F.count(F.when(~hit & true, 1)).alias("fn")
    )
    b = beta * beta
    down = (1 + b) * F.col("tp") + b * F.col("fn") + F.col("fp")
    return n.withColumn("fbeta", F.round(F.when(down > 0, (1 + b) * F.col("tp") / down).otherwise(0.0), 9))


def blocking_recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    own = candidates.select("s1_id", "target_id").distinct().withColumn("hit", F.lit(1))
    return truth.distinct().join(own, ["s1_id", "target_id"], "left").agg(F.count("hit").alias("captured"), F.count("*").alias("links"), F.round(F.count("hit") / F.count("*"), 9).alias("recall"))


def candidate_distribution(s1_ids: DataFrame, candidates: DataFrame) -> DataFrame:
    n = s1_ids.join(candidates.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").na.fill(0, ["n"])
    return n.agg(F.min("n").alias("least"), F.expr("percentile(n, 0.5)").alias("median"), F.round(F.avg("n"), 9).alias("mean"), F.round(F.expr("percentile(n, 0.95)"), 9).alias("p95"), F.max("n").alias("most"))


def singleton_accuracy(scores: DataFrame) -> DataFrame:
    alone = F.col("n_true") == 0
    return scores.agg(
        F.count(F.when(alone, 1)).alias("singletons"),
        F.count(F.when(alone & (F.col("n_pred") == 0), 1)).alias("right"),
        F.round(F.avg(F.when(~alone, F.col("f05"))), 9).alias("linked_f05"),
    )


def collisions(pairs: DataFrame) -> DataFrame:
    """Targets that more than one S1 record claims."""
    return pairs.groupBy("target_id").agg(F.countDistinct("s1_id").alias("claims")).where("claims > 1")


def top_values(df: DataFrame, value: Column, name: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent values, equals by value, each with the number of different values."""
    n = df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))
    every = n.agg(F.count("*").alias("n_distinct"))  # one row
    return n.orderBy(F.desc("n"), name).limit(k).crossJoin(F.broadcast(every))


def empty_rate(lists: DataFrame, by: Column, name: str) -> DataFrame:
    empty = (F.coalesce("matched_entity_ids", F.lit("")) == "").cast("int")
    return lists.groupBy(by.alias(name)).agg(F.count("*").alias("n"), F.sum(empty).alias("n_empty"), F.round(F.avg(empty), 9).alias("empty_rate"))


def rate_class(rate: Column) -> Column:
    return F.when(rate > 0.5, "fail").when(rate > 0.15, "warn").otherwise("ok")
