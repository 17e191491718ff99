"""Whole linkage runs: one composition, five presets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.functions import text as X
from tessera.operators import blocking as B
from tessera.operators import evaluate as V
from tessera.operators import features as FT
from tessera.operators import model as ML
from tessera.operators import resolve as R
from tessera.sources import records as IO
from tessera.sources.stage import quantile, staged


@dataclass(frozen=True)
class Preset:
    """How a run blocks, describes, scores and resolves its pairs.

    fitted_on is the share of S1 records, in order, whose candidates the model learns from (the others tune the threshold; both
    are all records where it is 1), or of each label's true and negative pairs, for presets that are tuned on pairs.
    """

    blocking: str
    features: str
    trees: bool
    tuned_on: str
    assign: bool
    top: int
    tiers: bool = False
    fitted_on: float = 1.0
    grid: tuple[float, float, int] = (0.5, 0.025, 19)


PRESETS = {
    "modular": Preset("three_passes", "sixteen", False, "macro", True, 20),
    "full": Preset("three_passes", "sixteen", False, "macro", True, 20, fitted_on=0.7),
    "fast": Preset("four_capped", "eleven", False, "macro", True, 15, tiers=True, fitted_on=0.7),
    "hardened": Preset("write_capped", "seven", True, "pairs", True, 20, fitted_on=0.8, grid=(0.5, 0.02, 23)),
    "embedding": Preset("neighbours", "six", True, "pairs", False, 20, fitted_on=0.8, grid=(0.4, 0.02, 28)),
}
NAMES = {"sixteen": FT.SIXTEEN, "eleven": FT.ELEVEN, "seven": FT.SEVEN, "six": FT.SIX}


def normalised(records: DataFrame, preset: Preset) -> DataFrame:
    if preset.features == "seven":
        n = records.select("entity_id", "ordinal", X.country("country").alias("country"), X.phrases("business_name").alias("norm_name"), X.phrases("business_address").alias("norm_addr"))
        return n.withColumn("clean_name", X.without_suffix(F.col("norm_name")))
    if preset.features == "six":
        return records.select("*", F.trim(F.lower(X.text("business_name"))).alias("name"), F.trim(F.lower(X.text("business_address"))).alias("addr"))
    return X.meta(records)


def candidates(s1: DataFrame, targets: DataFrame, preset: Preset) -> DataFrame:
    """Ranked pairs with both sides' attributes. The embedding preset wants ``vector`` columns, else it falls back to first words."""
    if preset.blocking == "neighbours" and "vector" in s1.columns:
        q, t = (d.where("vector is not null").select(F.col("ordinal").alias("id"), "country", "vector") for d in (s1, targets))
        near = B.nearest(q, t, preset.top, "country")
        a, b = s1.select(F.col("ordinal").alias("query_id"), F.col("entity_id").alias("s1_id")), targets.select(F.col("ordinal").alias("target_id_"), F.col("entity_id").alias("target_id"))
        pairs = near.withColumnRenamed("target_id", "target_id_").join(a, "query_id").join(b, "target_id_")
        pairs = pairs.select("s1_id", "target_id", F.col("query_id").alias("s1_ordinal"), F.col("target_id_").alias("ordinal"), F.col("cosine").alias("score"), "rank")
        return B.pair_up(pairs, s1.drop("vector"), targets.drop("vector"))
    if preset.blocking == "neighbours":  # all that the similarities let through
        pairs = B.first_word_pairs(s1, targets, S.fuzzy("token_sort")).join(s1.select(F.col("entity_id").alias("s1_id"), F.col("ordinal").alias("s1_ordinal")), "s1_id")
        rank = F.row_number().over(Window.partitionBy("s1_id").orderBy(F.desc("score"), "ordinal"))
        return B.pair_up(pairs.withColumn("rank", rank), s1, targets)
    passes = {"three_passes": B.THREE_PASSES, "four_capped": B.FOUR_CAPPED, "write_capped": B.WRITE_CAPPED}[preset.blocking]
    pairs = B.blocked(s1, targets, passes)
    if preset.blocking == "three_passes":
        pairs = B.rescored(pairs, s1, targets)
    return B.pair_up(B.top(pairs, preset.top), s1, targets)


def described(pairs: DataFrame, preset: Preset) -> DataFrame:
    if preset.features == "six":
        return FT.six(pairs, F.col("score"))
    return {"sixteen": FT.sixteen, "eleven": FT.eleven, "seven": FT.seven}[preset.features](pairs)


def score(model: Model | ML.Trees | None, pairs: DataFrame, preset: Preset) -> DataFrame:
    out = ML.predict(model, pairs, NAMES[preset.features])
    if preset.tiers:
        sure = (F.col("exact_name") == 1) & (F.col("digit_overlap") == 1)
        out = out.withColumn("prob", F.when(sure, F.lit(0.99)).otherwise(F.col("prob")))
    return out


def labelled_pairs(a: DataFrame, b: DataFrame, truth: DataFrame, preset: Preset, placeholder: bool = False) -> DataFrame:
    """Described true and negative pairs of normalised records; ``placeholder`` gives them cosines of 0.9 and 0.3 instead of their own."""
    six = preset.features == "six"
    wanted = ML.training_pairs(a, b, truth, **({"among": 50, "n": 3, "by": []} if six else {}))
    pairs = B.pair_up(wanted, a, b)
    if six:
        own = S.cosine(F.col("a_vector"), F.col("b_vector")) if "vector" in a.columns else F.lit(0.0)
        cosine = F.when(F.col("label") == 1, 0.9).otherwise(0.3) if placeholder else F.coalesce(own, F.lit(0.0))
        return FT.six(pairs, cosine)
    return described(pairs, preset)


def train(s1: DataFrame, targets: DataFrame, truth: DataFrame, preset: Preset, fallback: float = 0.75, placeholder: bool = False) -> tuple[Model | ML.Trees | None, float]:
    """A fitted model and the threshold that is best on pairs held out from it; no model and ``fallback`` without any positive pair.

    The embedding preset without vectors has no model: what its similarities let through is a match.
    """
    if preset.blocking == "neighbours" and "vector" not in s1.columns:
        return None, 0.0
    a, b = staged(normalised(s1, preset)), staged(normalised(targets, preset))
    grid = R.thresholds(s1, *preset.grid)
    if preset.tuned_on == "pairs":
        pairs = staged(ML.held_out(labelled_pairs(a, b, truth, preset, placeholder).select("s1_id", "target_id", "label", *NAMES[preset.features]), preset.fitted_on))
        model = ML.fit(pairs.where("train"), NAMES[preset.features], preset.trees)
        if model is None:
            return None, fallback
        best = V.best_of(V.pair_sweep(score(model, pairs.where("not train"), preset), grid), "fbeta").first()
        return model, best["threshold"] or fallback
    found = described(candidates(a, b, preset), preset)
    pairs = staged(ML.labelled(found.select("s1_id", "target_id", "s1_ordinal", *NAMES[preset.features]), truth))
    last = quantile(s1, preset.fitted_on)
    own = pairs if preset.fitted_on == 1 else pairs.where(F.col("s1_ordinal") <= last)
    model = ML.fit(own, NAMES[preset.features], preset.trees)
    if model is None:
        return None, fallback
    rest = s1 if preset.fitted_on == 1 else s1.where(F.col("ordinal") > last)
    ids = rest.select(F.col("entity_id").alias("s1_id"))
    scored = score(model, pairs if preset.fitted_on == 1 else pairs.where(F.col("s1_ordinal") > last), preset)
    best = V.best_of(V.sweep(ids, truth.join(ids, "s1_id", "left_semi"), R.assigned(scored), grid)).first()
    return model, best["threshold"] or fallback


def link(s1: DataFrame, targets: DataFrame, model: Model | ML.Trees | None, threshold: float, preset: Preset) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored pairs, the matching result and the candidates of ``s1``; each S1 record has one row in either, or it is an error."""
    a, b = staged(normalised(s1, preset)), staged(normalised(targets, preset))
    found = candidates(a, b, preset)
    if preset.blocking == "neighbours" and "vector" not in s1.columns:
        pairs = found.withColumn("prob", F.col("score"))
    else:
        pairs = score(model, described(found, preset), preset)
    pairs = staged(pairs.select("s1_id", "target_id", "s1_ordinal", "rank", "prob"))
    matches = R.assigned(pairs, threshold) if preset.assign else pairs.where(F.col("prob") >= threshold)
    order = [F.col("rank")] if preset.features == "six" else [-F.col("prob")] if preset.features == "seven" else [F.col("target_id")]
    out = pairs, staged(IO.as_lists(s1, matches, order)), IO.as_lists(s1, pairs, [F.col("rank")], "candidate_entity_ids")
    IO.assert_complete(out[1], s1)
    return out


def link_by_country(s1: DataFrame, targets: DataFrame, model: Model | ML.Trees | None, threshold: float, preset: Preset, path: str) -> DataFrame:
    """``link`` country by country with what is done kept under ``path``, so that a run can be taken up again."""

    def run(country: str) -> DataFrame:
        own = lambda d: d.where(F.col("country").eqNullSafe(country))
        return link(own(s1), own(targets), model, threshold, preset)[1].drop("ordinal")

    return IO.resume_by_country(s1, run, path)
