"""Linkage tables made of the ``documents`` table, with a truth that is known by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.sources.records import with_ordinal
from tessera.sources.stage import staged

SQL = r"""
with w as (select doc_id, upper(trim(lang)) country, {replace} t from documents),
b as (select doc_id, country, split_part(t,' ',1) w1, split_part(t,' ',2) w2, split_part(t,' ',3) w3,
             split_part(t,' ',4) w4, split_part(t,' ',5) a1, split_part(t,' ',6) a2,
             split_part(t,' ',7) a3, 1 + doc_id % 97 as num from w)
select concat('S1-', doc_id) entity_id, concat_ws(' ',w1,w2,w3,w4) business_name,
       concat_ws(' ', cast(num as varchar{n}), a1, a2, 'Road', a3) business_address, country from b
union all
select concat('S2-', doc_id), concat_ws(' ', upper(replace(w1, 'ß', 'ss')), w2, w3, w4, 'Limited'),
       concat_ws(' ', cast(num as varchar{n}), a1, a2, 'Rd'), country from b where doc_id % 10 < 7
union all
select concat('S3-', doc_id), concat_ws(' ', w2, w1, w3, 'Ltd.'),
       concat_ws(' ', a1, a2, a3), country from b where doc_id % 10 in (0,1,2,7)
"""


#: The rows of a document, as ``SQL`` has them.
ROWS = r"""
array_compact(array(
  named_struct('entity_id', concat('S1-', doc_id), 'business_name', concat_ws(' ', w1, w2, w3, w4), 'business_address', concat_ws(' ', num, a1, a2, 'Road', a3)),
  if(doc_id % 10 < 7, named_struct('entity_id', concat('S2-', doc_id), 'business_name', concat_ws(' ', upper(replace(w1, 'ß', 'ss')), w2, w3, w4, 'Limited'), 'business_address', concat_ws(' ', num, a1, a2, 'Rd')), null),
  if(doc_id % 10 in (0, 1, 2, 7), named_struct('entity_id', concat('S3-', doc_id), 'business_name', concat_ws(' ', w2, w1, w3, 'Ltd.'), 'business_address', concat_ws(' ', a1, a2, a3)), null)))
"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``SQL`` in one scan of the texts, of which only the first seven words are cut off."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.upper(F.trim("lang")).alias("country"), F.split(F.trim("text"), r"[ \n\t\r]+", 8).alias("w"))
    word = lambda i: F.when(F.col("w").isNotNull(), F.coalesce(F.try_element_at("w", F.lit(i)), F.lit("")))
    own = d.select("doc_id", "country", (1 + F.col("doc_id") % 97).cast("string").alias("num"), *(word(i).alias(c) for i, c in enumerate(("w1", "w2", "w3", "w4", "a1", "a2", "a3"), 1)))
    return with_ordinal(own.select("country", F.expr(f"inline({ROWS})")).select("entity_id", "business_name", "business_address", "country"))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = F.startswith("entity_id", F.lit("S1-"))
    return df.where(own), df.where(~own)


def truth(df: DataFrame) -> DataFrame:
    """(s1_id, target_id): targets carry the number of their S1 record."""
    return split(df)[1].select(F.concat(F.lit("S1-"), F.regexp_extract("entity_id", r"(\d+)$", 1)).alias("s1_id"), F.col("entity_id").alias("target_id"))


def normalised(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised S1 records, targets, and the truth; records are normalised once and read from there."""
    m = staged(X.meta(entities(spark, sf_dir)))
    s1, targets = split(m)
    return s1, targets, truth(m)


def vectors(spark: SparkSession, sf_dir: str, records: DataFrame) -> DataFrame:
    """Of ``records``, (entity_id, vector): records of one number share a vector of ``embeddings``, with some of the next one in S2 and more in S3."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    n = F.broadcast(v.agg(F.count("*").alias("n")))  # one row
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    both = v.join(other, "vec_id", "left").withColumn("next", F.coalesce("next", "embedding"))
    number = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("long")
    share = F.when(F.startswith("entity_id", F.lit("S2-")), 0.05).when(F.startswith("entity_id", F.lit("S3-")), 0.1).otherwise(0.0)
    own = records.select("entity_id", number.alias("number")).crossJoin(n).select("entity_id", (F.col("number") % F.col("n")).alias("vec_id"))
    return own.join(both, "vec_id").select("entity_id", F.zip_with("embedding", "next", lambda x, y: (x + share * y).cast("float")).alias("vector"))
