"""From scored pairs to matches: thresholds, global assignment, decisions and reviews.

A target goes to its best S1 record; an S1 record may have many. As targets compete only with
themselves, that is a window over targets and no loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assigned(pairs: DataFrame, threshold: float | None = None) -> DataFrame:
    """For each target its most probable pair, equals by the S1 record's ordinal."""
    best = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("prob"), "s1_ordinal"))
    own = pairs if threshold is None else pairs.where(F.col("prob") >= threshold)
    return own.withColumn("_best", best).where("_best = 1").drop("_best")


def thresholds(df: DataFrame, low: float = 0.5, step: float = 0.025, n: int = 19) -> DataFrame:
    """A table of ``n`` thresholds."""
    return df.sparkSession.range(n).select(F.round(F.lit(low) + F.col("id") * step, 4).alias("threshold"))


def rethreshold(pairs: DataFrame, threshold: float) -> DataFrame:
    """One record for each S1 id with its matched ids by candidate rank; no assignment."""
    match = F.col("prob") >= threshold
    return pairs.groupBy("s1_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(match, F.struct("rank", "target_id")))), lambda x: x["target_id"]), ",").alias("matched_ids"),
        F.count(F.when(match, 1)).alias("n_matched"),
        F.when(F.count(F.when(match, 1)) > 0, "MATCHED").otherwise("SINGLETON").alias("status"),
    )


def decided(pairs: DataFrame, decisions: DataFrame, threshold: float) -> DataFrame:
    """``is_match`` after the latest decision of each pair; ``decisions (s1_id, target_id, action, seq)``."""
    last = decisions.groupBy("s1_id", "target_id").agg(F.max_by("action", "seq").alias("action"))
    return pairs.join(last, ["s1_id", "target_id"], "left").withColumn(
        "is_match", F.when(F.col("action").isNull(), F.col("prob") >= threshold).otherwise(F.col("action") == "accept")
    )


def review_records(s1: DataFrame, decided: DataFrame, name: str = "") -> DataFrame:
    """One record for each of ``s1`` with matched_ids, status and candidates (target_id, confidence, is_match), the most probable first."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("prob")).alias("down"), "rank", "target_id", "is_match")))
    own = decided.groupBy("s1_id").agg(best.alias("c"))
    candidates = F.coalesce(F.transform("c", lambda x: F.struct(x["target_id"].alias("target_id"), (-x["down"]).alias("confidence"), x["is_match"].alias("is_match"))), F.array().cast("array<struct<target_id:string,confidence:double,is_match:boolean>>"))
    both = s1.join(own, F.col("entity_id") == F.col("s1_id"), "left").withColumn("candidates", candidates)
    matched = F.transform(F.filter("candidates", lambda x: x["is_match"]), lambda x: x["target_id"])
    return both.select(
        F.col("entity_id").alias("s1_id"), "business_name", "business_address", "country", F.array_join(matched, ",").alias("matched_ids"),
        F.when(F.size(matched) > 0, "matched").otherwise("singleton").alias("status"), "candidates",
    )


def overview(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: records, candidate pairs, confirmed matches, singletons and the mean probability."""
    links = F.size(F.filter("candidates", lambda x: x["is_match"]))
    a = records.agg(F.count("*").alias("s1_processed"), F.coalesce(F.sum(links), F.lit(0)).alias("confirmed_matches"), F.count_if(links == 0).alias("singletons"))
    b = pairs.agg(F.count("*").alias("candidate_pairs"), F.coalesce(F.avg("prob"), F.lit(0.0)).alias("mean_prob"))
    return a.crossJoin(b)  # one row each


def first_borderline(pairs: DataFrame, threshold: float, low: float = 0.4) -> DataFrame:
    """The first candidate of each S1 record that lies between ``low`` and the threshold."""
    w = F.row_number().over(Window.partitionBy("s1_id").orderBy("rank"))
    return pairs.where((F.col("prob") >= low) & (F.col("prob") < threshold)).withColumn("_n", w).where("_n = 1").drop("_n")


def band(prob: Column) -> Column:
    return F.when(prob >= 0.75, "high").when(prob >= 0.4, "review").otherwise("low")


def reviewed(records: DataFrame, pairs: DataFrame, kind: str = "all", search: str = "", low: float = 0.4, high: float = 0.75) -> DataFrame:
    """Records of a review queue: all, matched, singleton or review, with a search over id, name, address and matches."""
    open_ = pairs.groupBy("s1_id").agg(F.max((F.col("prob") >= low) & (F.col("prob") < high)).alias("in_review"))
    out = records.join(open_, "s1_id", "left").withColumn("in_review", F.coalesce("in_review", F.lit(False)))
    if kind == "review":
        out = out.where("in_review")
    elif kind != "all":
        out = out.where(F.lower("status") == kind)
    if search:
        text = F.lower(F.concat_ws("\n", "s1_id", "business_name", "business_address", "matched_ids"))
        out = out.where(F.contains(text, F.lit(search.lower())))
    return out
