"""Data-quality checks as violation rows, so that a report is a union of queries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.evaluate import rate_class
from tessera.sources.records import id_list
from tessera.sources.stage import numbered


def result_violations(results: DataFrame, s1: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(rule, offender) of ``results (source1_entity_id, matched_entity_ids)`` against the S1 ids and, if given, known targets.

    Rows and S1 ids meet in one aggregate by S1 id, claims and targets in one by target.
    """
    ids = F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = results.select(F.col("source1_entity_id").alias("id"), ids.alias("ids"))
    flag = lambda when, rule: F.when(when, F.lit(rule))
    named = lambda rules: F.explode(F.array_compact(F.array(*rules))).alias("rule")
    own = rows.select("id", F.lit(0).alias("known"), (F.size("ids") > F.size(F.array_distinct("ids"))).cast("int").alias("repeats"))
    known = s1.select(F.col("entity_id").alias("id"), F.lit(1).alias("known"), F.lit(0).alias("repeats"))
    by_row = own.union(known).groupBy("id").agg(F.count_if(F.col("known") == 0).alias("n"), F.max("known").alias("known"), F.max("repeats").alias("repeats"))
    first = by_row.select(named([flag(F.col("n") > 1, "duplicate_row"), flag(F.col("repeats") > 0, "repeat_in_list"), flag(F.col("n") == 0, "missing_s1"), flag(F.col("known") == 0, "unexpected_s1")]), F.col("id").alias("offender"))
    claims = rows.select(F.explode("ids").alias("t"), "id", F.lit(0).alias("known"))
    if targets is not None:
        claims = claims.union(targets.select(F.col("entity_id").alias("t"), F.lit(None).cast("string").alias("id"), F.lit(1).alias("known")))
    by_target = claims.groupBy("t").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("known").alias("known")).where("low is not null")
    rules = [flag(F.col("low") != F.col("high"), "claimed_twice"), flag(F.startswith("t", F.lit("S1-")), "self_match"), flag(~F.col("t").rlike("^S[123]-"), "bad_prefix")]
    if targets is not None:
        rules.append(flag((F.col("known") == 0) & F.col("t").rlike("^S[23]-"), "unknown_id"))
    return first.union(by_target.select(named(rules), F.col("t").alias("offender")))


def examples(violations: DataFrame, n: int = 5) -> DataFrame:
    """(rule, n, examples): how many offend a rule, and the first few of them in order."""
    place = F.row_number().over(Window.partitionBy("rule").orderBy("offender"))
    first = violations.withColumn("_place", place).where(F.col("_place") <= n)
    few = first.groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("offender")), ",").alias("examples"))
    return violations.groupBy("rule").agg(F.count("*").alias("n")).join(few, "rule")


def result_report(results: DataFrame, s1: DataFrame, targets: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """(level, rule, n, examples): all violations of a result as errors, matches that were no candidates as a warning, and the empty rate.

    A result is fit to hand over if no row is an error. Without candidates that check is a warning of its own.
    """
    errors = examples(result_violations(results, s1, targets)).select(F.lit("error").alias("level"), "rule", "n", "examples")
    if candidates is None:
        extra = s1.sparkSession.createDataFrame([("warning", "no_candidates", 1, "")], errors.schema)
    else:
        outside = subset_violations(results, candidates).select(F.lit("no_candidate").alias("rule"), F.col("source1_entity_id").alias("offender"))
        extra = examples(outside).select(F.lit("warning").alias("level"), "rule", "n", "examples")
    empty = (F.coalesce("matched_entity_ids", F.lit("")) == "").cast("int")
    rate = results.agg(F.coalesce(F.avg(empty), F.lit(0.0)).alias("rate"), F.sum(empty).alias("n_empty"))
    kind = {"fail": "error", "warn": "warning", "ok": "info"}
    level = F.element_at(F.create_map(*(F.lit(x) for p in kind.items() for x in p)), rate_class(F.col("rate")))
    share = rate.select(level.alias("level"), F.lit("empty_rate").alias("rule"), F.coalesce("n_empty", F.lit(0)).alias("n"), F.round("rate", 6).cast("string").alias("examples"))
    return errors.union(extra).union(share)


def coverage_diagnosis(results: DataFrame, s1: DataFrame, chunk: int = 50_000) -> DataFrame:
    """(part, name, n, n_empty, empty_rate, class): the empty rate of a result overall, by country and by chunk of ``chunk`` rows in order.

    ``results`` has source1_entity_id, matched_entity_ids, country and ordinal.
    """
    row = numbered(results)
    whole = [(F.lit("all"), F.lit("all")), (F.lit("country"), F.col("country")), (F.lit("chunk"), F.floor(F.col("row") / chunk).cast("string"))]
    each = row.select("matched_entity_ids", F.explode(F.array(*(F.struct(p.alias("part"), n.alias("name")) for p, n in whole))).alias("k")).select("matched_entity_ids", "k.part", "k.name")
    empty = (F.coalesce("matched_entity_ids", F.lit("")) == "").cast("int")
    rate = each.groupBy("part", "name").agg(F.count("*").alias("n"), F.sum(empty).alias("n_empty"), F.round(F.avg(empty), 9).alias("empty_rate"))
    return rate.withColumn("class", rate_class(F.col("empty_rate")))


def subset_violations(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """S1 rows with matches that were no candidates."""
    c = candidates.select("source1_entity_id", id_list("candidate_entity_ids").alias("c"))
    both = results.join(c, "source1_entity_id", "left")
    extra = F.array_sort(F.array_except(id_list("matched_entity_ids"), F.coalesce("c", F.array().cast("array<string>"))))
    return both.select("source1_entity_id", F.array_join(extra, ",").alias("extra")).where("extra <> ''")


def coverage(results: DataFrame, s1: DataFrame) -> DataFrame:
    """Rows, distinct ids, nulls before any filling, and ids missing or extra."""
    ids = results.select(F.col("source1_entity_id").alias("entity_id"))
    a = results.agg(F.count("*").alias("n_rows"), F.countDistinct("source1_entity_id").alias("n_ids"), F.count(F.when(F.col("matched_entity_ids").isNull(), 1)).alias("n_null"))
    missing = s1.select("entity_id").join(ids, "entity_id", "left_anti").agg(F.count("*").alias("n_missing"))
    extra = ids.join(s1, "entity_id", "left_anti").agg(F.count("*").alias("n_extra"))
    return a.crossJoin(missing).crossJoin(extra)  # one row each


def source_report(spark: SparkSession, path: str, columns: list[str], prefix: str = "", check: int = 1000) -> DataFrame:
    """One row on a tab-separated source: valid, errors, warnings, n_rows, n_checked, country_counts and sample_rows.

    Errors: not found, empty, commas for tabs, other columns, and the first 5 rows with another number of fields among those read until ``check``
    rows are good. Warnings: the first 3 of these whose id begins otherwise. Countries are counted over the checked rows; the first 20 are the sample.
    """
    kind = "valid boolean, errors array<string>, warnings array<string>, n_rows long, n_checked long, country_counts map<string,long>, sample_rows array<array<string>>"
    wrong = lambda text: spark.createDataFrame([(False, [text], [], 0, 0, {}, [])], kind)
    try:
        lines = spark.read.text(path)
        # the head of a file: lines come in the order of its first partition
        head = [r["value"] for r in lines.take(1)]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return wrong("file not found")
    if not head:
        return wrong("file is empty")
    if "\t" not in head[0] and "," in head[0]:
        return wrong("commas for tabs")
    names = [c.strip().lower() for c in head[0].rstrip("\r").split("\t")]
    if names != columns:
        return wrong(f"columns are {', '.join(names)}, not {', '.join(columns)}")
    # at most ``check`` good rows and the bad ones before them reach the driver
    errors, warnings, good, counts = [], [], [], {}
    step = check + 1
    first = lines.take(step)
    while True:
        errors, warnings, good, counts = [], [], [], {}
        for number, r in enumerate(first[1:], 2):
            if len(good) >= check:
                break
            if not r["value"].strip():
                continue
            fields = r["value"].rstrip("\r").split("\t")
            if len(fields) != len(columns):
                errors.append(f"row {number} has {len(fields)} fields")
                continue
            good.append(fields)
            if not fields[0].startswith(prefix):
                warnings.append(f"row {number} has the id {fields[0]}")
            if "country" in columns:
                country = fields[columns.index("country")].strip() or "Unknown"
                counts[country] = counts.get(country, 0) + 1
        if len(good) >= check or len(errors) >= 5 or len(first) < step:
            break
        step *= 4
        first = lines.take(step)
    total = lines.agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("n")).first()["n"]
    return spark.createDataFrame([(not errors, errors[:5], warnings[:3], total, len(good), counts, good[:20])], kind)
