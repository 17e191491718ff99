"""Sources and sinks of linkage tables: tab-separated files and Parquet.

Rows carry an explicit ``ordinal`` where order matters, since distributed rows have none of their own.
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
RESULT, CANDIDATES = TRUTH, T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "candidate_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """A typed scan: all strings, nulls as empty, quotes as they are. Lines with another number of fields go."""
    part, names = F.split("value", "\t"), schema.names
    lines = spark.read.text(path).withColumn("f", part)
    header = F.array(*(F.lit(n) for n in names))
    fields = lines.where((F.size("f") == len(names)) & (F.transform("f", lambda x: F.lower(F.trim(x))) != header))
    return fields.select(*(F.element_at("f", i + 1).alias(n) for i, n in enumerate(names)))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The set of first columns of a file's rows, without the header."""
    first = F.element_at(F.split("value", "\t"), 1)
    own = spark.read.text(path).select(F.trim(first).alias("entity_id")).where("entity_id <> ''")
    return own.where(~F.lower("entity_id").isin(RECORD.names[0], TRUTH.names[0])).distinct()


def count_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row: the lines of a file without its header, never below 0."""
    return spark.read.text(path).agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("n_rows"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of vectors ``(entity_id, vector)`` written by ``write_vectors``, or None where there is none."""
    try:
        return spark.read.parquet(path).select("entity_id", "vector")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Keeps ``vectors (entity_id, vector)`` for later runs, each of unit length."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.when(norm > 0, F.transform("vector", lambda x: (x / norm).cast("float"))).otherwise(F.col("vector").cast("array<float>"))
    vectors.select("entity_id", unit.alias("vector")).write.mode("overwrite").parquet(path)


def with_vectors(df: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """``df`` with a ``vector`` if there is a table of them; without one a plan falls back to first words."""
    return df if vectors is None else df.join(vectors, "entity_id", "left")


def read_positional(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """A line scan by position; a missing column is empty, a missing country US."""
    part = F.split("value", "\t")
    default = {"country": "US"}
    lines = spark.read.text(path).where(~F.startswith("value", F.lit(schema.names[0] + "\t")))
    value = [F.coalesce(F.try_element_at(part, F.lit(i + 1)), F.lit(default.get(n, ""))) for i, n in enumerate(schema.names)]
    return lines.select(*((F.upper(F.trim(v)) if n == "country" else v).alias(n) for n, v in zip(schema.names, value, strict=True)))


def with_ordinal(df: DataFrame, key: str = "entity_id") -> DataFrame:
    """Adds ``ordinal``: the source number, then the numeric id. It stands for the order of the files."""
    source = F.substring(key, 2, 1).cast("long")
    return df.withColumn("ordinal", source * F.lit(10**12) + F.regexp_extract(key, r"(\d+)$", 1).cast("long"))


def select_rows(df: DataFrame, ids: DataFrame | None = None, first: int | None = None, country: str | None = None) -> DataFrame:
    """Rows whose id is in ``ids``, or among the ``first`` by ordinal (either, where both are given)."""
    if country is not None:
        df = df.where(F.upper(F.trim("country")) == country)
    if ids is None:
        return df if first is None else df.where(F.col("ordinal") <= _nth(df, first))
    needed = ids.select(F.col(ids.columns[0]).alias("_needed")).distinct()
    if first is None:
        return df.join(needed, df.entity_id == F.col("_needed"), "left_semi")
    both = df.join(needed, df.entity_id == F.col("_needed"), "left")
    return both.where(F.col("_needed").isNotNull() | (F.col("ordinal") <= _nth(df, first))).select(*df.columns)


def _nth(df: DataFrame, n: int) -> int:
    low = df.select("ordinal").orderBy("ordinal").limit(n).agg(F.max("ordinal")).first()[0]
    return -1 if low is None else low


def needed_ids(*ids: DataFrame) -> DataFrame:
    """The union of id sets, each once."""
    return union_sources(*(d.select(F.col(d.columns[0]).alias("entity_id")) for d in ids)).distinct()


def union_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def hash_sample(df: DataFrame, n: int, seed: int = 42, key: str = "entity_id") -> DataFrame:
    """``n`` rows that only their keys and the seed choose."""
    return df.orderBy(F.md5(F.concat_ws(":", key, F.lit(str(seed)))), key).limit(n)


def countries(df: DataFrame) -> DataFrame:
    """Countries in the order in which they first appear."""
    return df.groupBy("country").agg(F.min("ordinal").alias("first_ordinal"))


def resolve_country(df: DataFrame, asked: str) -> DataFrame:
    """Countries equal to ``asked`` or beginning with it, whatever the case; the literal if there is none."""
    found = df.select("country").distinct().where((F.lower("country") == asked.lower()) | F.startswith(F.upper("country"), F.lit(asked.upper())))
    literal = df.sparkSession.createDataFrame([(asked,)], "country string")
    none = found.agg(F.count("*").alias("n")).where("n = 0").drop("n").crossJoin(literal)
    return found.union(none)


def id_list(c: Column | str) -> Column:
    """A comma list as a sorted set of trimmed ids."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(s1_id, target_id) of a ground truth; the last row of a repeated id wins if there is an ordinal."""
    if "ordinal" in truth.columns:
        truth = truth.groupBy("source1_entity_id").agg(F.max_by("matched_entity_ids", "ordinal").alias("matched_entity_ids"))
    return truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(id_list("matched_entity_ids")).alias("target_id"))


def as_lists(s1: DataFrame, pairs: DataFrame, by: list[Column] | None = None, name: str = "matched_entity_ids") -> DataFrame:
    """One row for each S1 record with its targets as a comma list, empty where it has none."""
    order = by or [F.col("target_id")]
    keyed = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col("target_id").alias("t")))).alias("l"))
    both = s1.join(keyed, s1.entity_id == keyed.s1_id, "left")
    return both.select(F.col("entity_id").alias("source1_entity_id"), F.coalesce(F.array_join(F.transform("l", lambda x: x["t"]), ","), F.lit("")).alias(name), *(c for c in ("ordinal",) if c in s1.columns))


def write_tsv(lists: DataFrame, path: str) -> None:
    """Two columns in S1 order; a record without targets ends in a bare tab."""
    a, b = lists.columns[:2]
    ordered = lists.orderBy("ordinal") if "ordinal" in lists.columns else lists.orderBy(a)
    ordered.select(a, b).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_by_country(lists: DataFrame, path: str) -> None:
    """A restartable sink: one folder for each country, overwritten only where there are new rows."""
    lists.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country").parquet(path)


def done_countries(spark: SparkSession, path: str) -> list[str]:
    """Countries that ``write_by_country`` has written."""
    try:
        return sorted(r["country"] for r in spark.read.schema("country string").parquet(path).select("country").distinct().collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def resume_by_country(s1: DataFrame, run: Callable[[str], DataFrame], path: str) -> DataFrame:
    """Lists of all of ``s1 (entity_id, ordinal, country)``: countries that are not done are run and written one by one, the others read.

    Every S1 record has one row in the end, empty where a run gave none, in the order of S1; anything else is an error.
    """
    spark = s1.sparkSession
    done = set(done_countries(spark, path))
    # one row for each country
    for country in sorted(r["country"] for r in s1.select("country").distinct().collect()):
        if country not in done:
            write_by_country(run(country).withColumn("country", F.lit(country)), path)
    parts = spark.read.parquet(path).drop("country", "ordinal")
    a, b = parts.columns
    whole = s1.select("entity_id", "ordinal").join(parts, F.col("entity_id") == F.col(a), "left")
    out = whole.select(F.col("entity_id").alias(a), F.coalesce(b, F.lit("")).alias(b), "ordinal")
    assert_complete(out, s1)
    return out


def completeness(lists: DataFrame, s1: DataFrame) -> DataFrame:
    """One row: S1 records without a row in lists, ids that are no S1 record, and those with several rows."""
    own, name = s1.select(F.col("entity_id").alias("id"), F.lit(1).alias("x"), F.lit(0).alias("y")), lists.columns[0]
    both = own.union(lists.select(F.col(name), F.lit(0), F.lit(1))).groupBy("id").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return both.agg(F.count_if((F.col("x") > 0) & (F.col("y") == 0)).alias("missing"), F.count_if(F.col("x") == 0).alias("unexpected"), F.count_if(F.col("y") > 1).alias("repeated"))


def assert_complete(lists: DataFrame, s1: DataFrame) -> None:
    """Raises where lists do not have exactly one row for each S1 record."""
    n = completeness(lists, s1).first()
    if any(n):
        raise ValueError(f"incomplete lists: {n['missing']} records missing, {n['unexpected']} unexpected, {n['repeated']} repeated")


def write_zip(files: dict[str, str], path: str) -> None:
    """A zip of small text files, name to content, as a run is handed over."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, content in files.items():
            out.writestr(name, content)


def as_json(df: DataFrame, name: str = "payload") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))

