"""Every linkage query by name, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.functions import text as X
from tessera.operators import blocking as B
from tessera.operators import evaluate as V
from tessera.operators import features as FT
from tessera.operators import model as ML
from tessera.operators import resolve as R
from tessera.operators import validate as Q
from tessera.plans import fixture as FX
from tessera.plans import oracle as O
from tessera.plans import pipeline as PL
from tessera.plans import session as SE
from tessera.sources import records as IO
from tessera.sources.stage import numbered, quantile, scratch, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
T = 0.75


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1::double", sql)  # else decimals
        return f

    return add


def ones(df: DataFrame, *columns) -> DataFrame:
    return df.select("entity_id", *columns)


def meta(spark, sf):
    return FX.normalised(spark, sf)


def ranked(spark, sf, k: int = 20):
    """The best candidates of the three passes, with the Jaccard similarities of their names and addresses."""
    s1, targets, truth = meta(spark, sf)
    best = B.best(s1, targets, B.THREE_PASSES, k, B.OVERLAPS, ("name_tokens", "addr_tokens"))
    return best, s1, targets, truth


def paired(spark, sf, k: int = 20):
    """The best candidates of the three passes with both sides' attributes."""
    best, s1, targets, truth = ranked(spark, sf, k)
    return B.pair_up(best.select("s1_id", "target_id", "s1_ordinal", "ordinal", "score", "rank"), s1, targets), s1, truth


def compared(spark, sf):
    """The best candidates with name_jaccard and addr_jaccard; tokens were counted where the pairs were found."""
    best, s1, _, truth = ranked(spark, sf)
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(f"common_{c}_tokens"), F.col(f"union_{c}_tokens")), F.lit(0.0)), 9).alias(f"{c}_jaccard")
    return best.select("s1_id", "target_id", "s1_ordinal", "ordinal", "score", "rank", share("name"), share("addr")), s1, truth


def probable(spark, sf):
    x, s1, truth = compared(spark, sf)
    p = ML.scored(x, {"name_jaccard": 6.0, "addr_jaccard": 3.0}, -4.0).withColumn("prob", F.round("prob", 6))
    return p, s1.select(F.col("entity_id").alias("s1_id"), "entity_id", "ordinal", "country"), truth


# scans, sets and samples
@query(f"with {O.E} select country, count(*) n, count(distinct entity_id) n_ids from e where entity_id not like 'S1-%' group by 1")
def scan_union_sources(spark, sf):
    e = FX.entities(spark, sf)
    two, three = (e.where(F.startswith("entity_id", F.lit(p))) for p in ("S2-", "S3-"))
    return IO.union_sources(two, three).withColumn("country", X.country("country")).groupBy("country").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("n_ids"))


@query(f"with {O.M} select entity_id, business_name from e where entity_id in (select target_id from truth where s1_id like '%7')")
def semi_needed(spark, sf):
    e = FX.entities(spark, sf)
    needed = FX.truth(e).where(F.endswith("s1_id", F.lit("7"))).select("target_id")
    return IO.select_rows(e, needed).select("entity_id", "business_name")


@query(f"with {O.M} select entity_id from e where entity_id like 'S1-%' and entity_id not in (select s1_id from truth)")
def anti_missing(spark, sf):
    e = FX.entities(spark, sf)
    return FX.split(e)[0].join(FX.truth(e), F.col("entity_id") == F.col("s1_id"), "left_anti").select("entity_id")


@query(f"with {O.M} select entity_id from e where entity_id in (select target_id from truth where s1_id like '%7') or ordinal in (select ordinal from e order by ordinal limit 100)")
def needed_or_first_n(spark, sf):
    e = FX.entities(spark, sf)
    return IO.select_rows(e, FX.truth(e).where(F.endswith("s1_id", F.lit("7"))).select("target_id"), first=100).select("entity_id")


@query(f"with {O.E} select entity_id from e where entity_id like 'S1-%' order by md5(entity_id || ':42'), entity_id limit 200")
def sample_hash_n(spark, sf):
    return IO.hash_sample(FX.split(FX.entities(spark, sf))[0], 200).select("entity_id")


@query(f"with {O.E} select country, min(ordinal) first_ordinal from e group by 1")
def countries_first_seen(spark, sf):
    return IO.countries(FX.entities(spark, sf))


@query(f"with {O.E} select distinct country from e where lower(country) = 'en' or upper(country) like 'EN%' union select 'en' where not exists (select 1 from e where lower(country) = 'en' or upper(country) like 'EN%')")
def country_argument(spark, sf):
    return IO.resolve_country(FX.entities(spark, sf), "en")


@query(f"with {O.E} select entity_id, business_name from e where upper(trim(country)) = 'DE'")
def scan_country(spark, sf):
    return IO.select_rows(FX.entities(spark, sf), country="DE").select("entity_id", "business_name")


@query(f"with {O.E} select entity_id, business_name, coalesce(business_address, '') business_address, coalesce(country, '') country from e where entity_id not like '%3'")
def scan_tsv(spark, sf):
    """A written file read back: lines with another number of fields are dropped."""
    line = F.concat_ws("\t", "entity_id", "business_name", F.coalesce("business_address", F.lit("")), F.coalesce("country", F.lit("")))
    e = FX.entities(spark, sf).select(F.when(F.endswith("entity_id", F.lit("3")), F.concat(line, F.lit("\tmore"))).otherwise(line).alias("line"))
    folder = scratch(spark)
    spark.createDataFrame([("\t".join(IO.RECORD.names),)], "line string").union(e).write.text(folder)
    return IO.read_tsv(spark, folder)


@query(f"with {O.E}, f as (select * from e where entity_id like 'S2-%' order by ordinal limit 1000) select true valid, (select count(*) from e where entity_id like 'S2-%') n_rows, count(*) n_checked, (select string_agg(c, ',' order by c) from (select country || '=' || count(*) c from f group by country)) countries from f")
def source_check(spark, sf):
    """The report on a written source."""
    e = FX.entities(spark, sf).where(F.startswith("entity_id", F.lit("S2-")))
    line = F.concat_ws("\t", "entity_id", "business_name", F.coalesce("business_address", F.lit("")), "country")
    folder = scratch(spark)
    head = spark.createDataFrame([("\t".join(IO.RECORD.names), -1)], "line string, ordinal long")
    # one file in order, as a source is
    head.union(e.select(line, "ordinal")).repartition(1).sortWithinPartitions("ordinal").select("line").write.text(folder)
    report = Q.source_report(spark, folder, IO.RECORD.names, "S2-")
    counts = F.array_sort(F.transform(F.map_entries("country_counts"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))))
    return report.select("valid", "n_rows", F.col("n_checked"), F.array_join(counts, ",").alias("countries"))


@query(f"with {O.E} select (select count(*) from e) n_rows, count(distinct entity_id) n_ids from e")
def scan_ids(spark, sf):
    folder = scratch(spark)
    FX.entities(spark, sf).select(F.concat_ws("\t", "entity_id", "business_name").alias("line")).union(spark.createDataFrame([("entity_id\tbusiness_name",)], "line string")).write.text(folder)
    return IO.count_rows(spark, folder).crossJoin(IO.read_ids(spark, folder).agg(F.count("*").alias("n_ids")))  # one row each


@query(f"with {O.M} select distinct entity_id from (select target_id entity_id from truth where s1_id like '%7' union all select s1_id from truth where s1_id like '%7')")
def needed_union(spark, sf):
    t = FX.truth(FX.entities(spark, sf)).where(F.endswith("s1_id", F.lit("7")))
    return IO.needed_ids(t.select("target_id"), t.select("s1_id"))


@query(f"with {O.E} select country, count(*) n from (select * from e order by ordinal limit 1000) group by 1")
def country_counts_of_first(spark, sf):
    return IO.select_rows(FX.entities(spark, sf), first=1000).groupBy("country").agg(F.count("*").alias("n"))


@query(f"with {O.E} select entity_id, business_name, country from e order by ordinal limit 20")
def preview_rows(spark, sf):
    return SE.preview(FX.entities(spark, sf)).select("entity_id", "business_name", "country")


@query(f"with {O.E} select entity_id, business_name from e where contains(lower(entity_id), 'ltd') or contains(lower(business_name), 'ltd') order by business_name desc, entity_id limit 50")
def preview_search(spark, sf):
    e = FX.entities(spark, sf).select("entity_id", "business_name")
    return SE.searched(e, "LTD").orderBy(F.desc("business_name"), "entity_id").limit(50)


@query(f"with {O.E}, s as (select * from e where entity_id like 'S1-%') select country, count(*) filter (ordinal <= cut) n_fit, count(*) filter (ordinal > cut) n_rest from s, (select quantile_disc(ordinal, 0.7) cut from s) group by 1")
def train_split(spark, sf):
    s1 = FX.split(FX.entities(spark, sf))[0]
    last = quantile(s1, 0.7)
    return s1.groupBy("country").agg(F.count_if(F.col("ordinal") <= last).alias("n_fit"), F.count_if(F.col("ordinal") > last).alias("n_rest"))


# text
@query(f"with {O.E} select entity_id, trim(regexp_replace(regexp_replace(trim(lower(regexp_replace(strip_accents({O.transliterated('business_name')}), '[^\\x00-\\x7F]', '', 'g'))), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) name from e")
def plain_text(spark, sf):
    return ones(FX.entities(spark, sf), X.plain("business_name").alias("name"))


@query(f"with {O.E} select entity_id, {O.clean('business_name')} clean_name from e")
def clean_text(spark, sf):
    return ones(FX.entities(spark, sf), X.clean("business_name").alias("clean_name"))


@query(f"with {O.M} select entity_id, norm_name, array_to_string(core_tokens, '|') core from m")
def norm_name(spark, sf):
    return ones(X.meta(FX.entities(spark, sf)), "norm_name", F.array_join("core_tokens", "|").alias("core"))


@query(f"with {O.M} select entity_id, norm_addr, array_to_string(list_sort(digits), '|') digit_list from m")
def norm_addr(spark, sf):
    return ones(X.meta(FX.entities(spark, sf)), "norm_addr", F.array_join(F.array_sort("digits"), "|").alias("digit_list"))


@query(f"with {O.E} select entity_id, {O.phrases('business_name')} name, {O.phrases('business_address')} addr from e")
def norm_phrases(spark, sf):
    return ones(FX.entities(spark, sf), X.phrases("business_name").alias("name"), X.phrases("business_address").alias("addr"))


# RE2 has word boundaries for ASCII alone: underscores beside the other letters stand in for those
_SAFE = "regexp_replace(business_name, '([^\\x00-\\x7F])', '_\\1_', 'g')"


@query(f"with {O.E} select entity_id, trim(regexp_replace(regexp_replace({_SAFE}, '\\b(pvt ltd|private limited|inc|incorporated|corp|corporation|llc|ltd|limited|co)\\b\\.?', '', 'gi'), '_([^\\x00-\\x7F])_', '\\1', 'g')) bare from e")
def strip_suffix(spark, sf):
    return ones(FX.entities(spark, sf), X.without_suffix(F.col("business_name")).alias("bare"))


@query(f"with {O.E} select entity_id, regexp_extract(lower(business_name), '^[^\\p{{L}}\\p{{N}}_]*([\\p{{L}}\\p{{N}}_]+)', 1) word from e")
def first_word(spark, sf):
    return ones(FX.entities(spark, sf), X.first_word("business_name").alias("word"))


@query(f"with {O.E}, x as (select entity_id, regexp_extract(lower(business_name), '^([\\p{{L}}\\p{{N}}_]+\\s+[\\p{{L}}\\p{{N}}_]+)', 1) two, regexp_extract(lower(business_name), '^([\\p{{L}}\\p{{N}}_]+)', 1) one from e) select entity_id, coalesce(nullif(two, ''), nullif(one, ''), '') words from x")
def first_two_words(spark, sf):
    n = F.lower("business_name")
    two, one = (F.nullif(F.regexp_extract(n, p, 1), F.lit("")) for p in (r"(?U)^(\w+\s+\w+)", r"(?U)^(\w+)"))
    return ones(FX.entities(spark, sf), F.coalesce(two, one, F.lit("")).alias("words"))


@query(f"with {O.E} select entity_id, concat_ws(' [SEP] ', nullif(trim(business_name), ''), nullif(trim(business_address), '')) made from e")
def make_text(spark, sf):
    return ones(FX.entities(spark, sf), X.joined("business_name", "business_address").alias("made"))


@query(f"with {O.M} select entity_id, array_to_string(list_sort({O.grams('norm_name')}), '|') grams from m")
def trigrams(spark, sf):
    return ones(X.meta(FX.entities(spark, sf)), F.array_join(F.array_sort(X.grams(F.col("norm_name"))), "|").alias("grams"))


@query(f"with {O.E} select entity_id, array_to_string(regexp_extract_all(business_address, '[0-9]+'), '|') runs, regexp_extract(business_address, '[0-9]+') house from e")
def digit_runs(spark, sf):
    a = F.col("business_address")
    return ones(FX.entities(spark, sf), F.array_join(F.regexp_extract_all(a, F.lit(r"([0-9]+)"), F.lit(1)), "|").alias("runs"), F.regexp_extract(a, "[0-9]+", 0).alias("house"))


# similarities of pairs: part names of the same brand
PART = "p as (select distinct p_brand brand, p_name name, string_split(p_name, ' ') words from part), pp as (select a.name a, b.name b, a.words x, b.words y, a.brand from p a join p b using (brand) where a.name < b.name)"


def part_pairs(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name")).distinct()
    a, b = p.withColumnRenamed("name", "a"), p.withColumnRenamed("name", "b")
    return a.join(b, "brand").where("a < b").select("brand", "a", "b", F.split("a", " ").alias("x"), F.split("b", " ").alias("y"))


@query(f"with {PART} select brand, a, b, round({O.jaccard('x', 'y')}, 9) sim from pp")
def jaccard_pairs(spark, sf):
    return part_pairs(spark, sf).select("brand", "a", "b", F.round(S.jaccard(F.array_distinct("x"), F.array_distinct("y")), 9).alias("sim"))


@query(f"with {PART} select brand, a, b, round({O.levenshtein('a', 'b')}, 9) sim from pp")
def levenshtein_ratio_pairs(spark, sf):
    return part_pairs(spark, sf).select("brand", "a", "b", F.round(S.levenshtein_ratio(F.col("a"), F.col("b")), 9).alias("sim"))


@query(f"with {PART} select brand, a, b, case when contains(a, b) or contains(b, a) then 1.0 else 0.0 end sim from pp")
def containment_pairs(spark, sf):
    return part_pairs(spark, sf).select("brand", "a", "b", S.containment(F.col("a"), F.col("b")).alias("sim"))


def _fuzzy(name: str, kind: str) -> None:
    def run(spark, sf):
        return part_pairs(spark, sf).select("brand", "a", "b", F.round(S.fuzzy(kind)("a", "b"), 9).alias("sim"))

    QUERIES[name] = run


for _name, _kind in (("fuzz_ratio", "ratio"), ("token_sort", "token_sort"), ("token_set", "token_set"), ("partial_ratio", "partial"), ("wratio", "weighted")):
    _fuzzy(_name, _kind)

@query("with v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings) select a.vec_id a_id, b.vec_id b_id, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 6) cosine from v a join v b using (label) where a.vec_id < b.vec_id and a.vec_id % 3 = 0 and b.vec_id % 3 = 1")
def cosine_pairs(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    a, b = (v.where(F.col("vec_id") % 3 == k).select(F.col("vec_id").alias(f"{n}_id"), "label", F.col("embedding").alias(n)) for n, k in (("a", 0), ("b", 1)))
    return a.join(b, "label").where("a_id < b_id").select("a_id", "b_id", F.round(S.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


KNN = "v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings), c as (select a.vec_id query_id, b.vec_id target_id, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) cosine from v a join v b using (label) where a.vec_id % 5 = 0 and b.vec_id % 5 <> 0)"


def vectors(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    return v.where("id % 5 = 0"), v.where("id % 5 <> 0")


@query(f"with {KNN} select query_id, target_id, round(cosine, 6) cosine, rank from (select *, row_number() over (partition by query_id order by round(cosine, 12) desc, target_id) rank from c) where rank <= 20")
def knn_topk(spark, sf):
    return B.nearest(*vectors(spark, sf)).select("query_id", "target_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


# blocking
@query(f"with {O.M}, {O.blocked(O.THREE)} select s1_id, target_id, score from blocked")
def block_3pass(spark, sf):
    s1, t, _ = meta(spark, sf)
    return B.blocked(s1, t, B.THREE_PASSES).select("s1_id", "target_id", "score")


@query(f"with {O.M}, {O.blocked(O.FOUR)} select s1_id, target_id, score, rank from (select *, row_number() over (partition by s1_id order by score desc, ordinal) rank from blocked) where rank <= 15")
def block_4index_capped(spark, sf):
    s1, t, _ = meta(spark, sf)
    return B.top(B.blocked(s1, t, B.FOUR_CAPPED), 15).select("s1_id", "target_id", "score", F.col("rank").cast("long").alias("rank"))


def hardened(spark, sf):
    e = FX.entities(spark, sf)
    n = e.select("entity_id", "ordinal", X.country("country").alias("country"), X.phrases("business_name").alias("norm_name"), X.phrases("business_address").alias("norm_addr"))
    return FX.split(staged(n.withColumn("clean_name", X.without_suffix(F.col("norm_name")))))


@query(f"with {O.H}, {O.blocked(O.WRITE)} select s1_id, target_id, score, rank from (select *, row_number() over (partition by s1_id order by score desc, ordinal) rank from blocked) where rank <= 20")
def block_write_capped(spark, sf):
    s1, t = hardened(spark, sf)
    return B.best(s1, t, B.WRITE_CAPPED).select("s1_id", "target_id", "score", F.col("rank").cast("long").alias("rank"))


@query()
def block_first_word(spark, sf):
    s1, t = FX.split(FX.entities(spark, sf))
    return B.first_word_pairs(s1, t, S.fuzzy("token_sort")).select("s1_id", "target_id", F.round("score", 9).alias("score"))


@query(f"with {O.TOP} select s1_id, target_id, score, rank from top")
def rescore_topk(spark, sf):
    return ranked(spark, sf)[0].select("s1_id", "target_id", "score", F.col("rank").cast("long").alias("rank"))


# features and models
_C = "array_to_string(list_sort(list_distinct({s}.core_tokens)), ' ')"
_BOTH, _DIG = "a.norm_addr <> '' and b.norm_addr <> ''", "len(a.digits) > 0 and len(b.digits) > 0"
_F16 = {
    "name_jaccard": O.jaccard("a.name_tokens", "b.name_tokens"), "core_jaccard": O.jaccard("a.core_tokens", "b.core_tokens"),
    "name_char3": O.jaccard(O.grams("a.norm_name"), O.grams("b.norm_name")), "name_lev": O.levenshtein("a.norm_name", "b.norm_name"),
    "core_lev": O.levenshtein("a.cs", "b.cs"), "first_core": "case when a.core_tokens[1] = b.core_tokens[1] then 1.0 else 0.0 end",
    "first_token": "case when a.norm_name <> '' and string_split(a.norm_name, ' ')[1] = string_split(b.norm_name, ' ')[1] then 1.0 else 0.0 end",
    "containment": "case when contains(a.norm_name, b.norm_name) or contains(b.norm_name, a.norm_name) then 1.0 else 0.0 end",
    "both_addr": f"case when {_BOTH} then 1.0 else 0.0 end", "addr_jaccard": f"case when {_BOTH} then {O.jaccard('a.addr_tokens', 'b.addr_tokens')} else 0.0 end",
    "addr_char3": f"case when {_BOTH} then {O.jaccard(O.grams('a.norm_addr'), O.grams('b.norm_addr'))} else 0.0 end",
    "addr_lev": f"case when {_BOTH} then {O.levenshtein('a.norm_addr', 'b.norm_addr')} else 0.0 end", "both_digits": f"case when {_DIG} then 1.0 else 0.0 end",
    "digit_jaccard": f"case when {_DIG} then {O.jaccard('a.digits', 'b.digits')} else 0.0 end", "digit_overlap": f"case when {_DIG} and {O.inter('a.digits', 'b.digits')} > 0 then 1.0 else 0.0 end",
    "country_match": "case when a.country = b.country then 1.0 else 0.0 end",
}


@query(f"with {O.TOP}, mm as materialized (select *, {_C.format(s='m')} cs from m) select s1_id, target_id, " + ", ".join(f"round({x}, 6) {c}" for c, x in _F16.items()) + " from top join mm a on a.entity_id = s1_id join mm b on b.entity_id = target_id")
def features16(spark, sf):
    return FT.sixteen(paired(spark, sf)[0]).select("s1_id", "target_id", *(F.round(c, 6).alias(c) for c in FT.SIXTEEN))


@query()
def features11(spark, sf):
    return FT.eleven(paired(spark, sf)[0]).select("s1_id", "target_id", *FT.ELEVEN)


@query()
def features7(spark, sf):
    s1, t = hardened(spark, sf)
    pairs = B.pair_up(B.best(s1, t, B.WRITE_CAPPED), s1, t)
    return FT.seven(pairs).select("s1_id", "target_id", *FT.SEVEN)


def embedded(spark, sf):
    """Records with their vectors, S1 and targets."""
    e = staged(FX.entities(spark, sf))
    return FX.split(staged(IO.with_vectors(e, FX.vectors(spark, sf, e))))


@query()
def features6(spark, sf):
    s1, t = (PL.normalised(d, PL.PRESETS["embedding"]) for d in embedded(spark, sf))
    pairs = PL.candidates(s1, t, PL.PRESETS["embedding"])
    return FT.six(pairs, F.col("score")).select("s1_id", "target_id", *(F.round(c, 6).alias(c) for c in FT.SIX))


@query(f"with {O.TOP} select s1_id, target_id, case when (s1_id, target_id) in (select (s1_id, target_id) from truth) then 1 else 0 end as label from top")
def label_pairs(spark, sf):
    pairs, _, _, truth = ranked(spark, sf)
    return ML.labelled(pairs, truth).select("s1_id", "target_id", "label")


@query(f"with {O.M}, few as (select * from (select *, row_number() over (partition by country order by ordinal) place from m where entity_id not like 'S1-%') where place <= 15), x as (select a.entity_id s1_id, f.entity_id target_id, row_number() over (partition by a.entity_id order by place) n from m a join few f using (country) where a.entity_id like 'S1-%' and (a.entity_id, f.entity_id) not in (select (s1_id, target_id) from truth)) select s1_id, target_id from x where n <= 5")
def negative_sample(spark, sf):
    return ML.negatives(*meta(spark, sf))


@query(f"with {O.M}, few as (select entity_id target_id, ordinal from m where entity_id not like 'S1-%' order by ordinal limit 50), x as (select a.entity_id s1_id, f.target_id, row_number() over (partition by a.entity_id order by f.ordinal) n from m a, few f where a.entity_id like 'S1-%' and (a.entity_id, f.target_id) not in (select (s1_id, target_id) from truth)) select s1_id, target_id, 0 as label from x where n <= 3 union all select s1_id, target_id, 1 from truth")
def training_pairs(spark, sf):
    return ML.training_pairs(*meta(spark, sf), among=50, n=3, by=[])


@query(f"with {O.M}, few as (select * from (select *, row_number() over (partition by country order by ordinal) place from m where entity_id not like 'S1-%') where place <= 15), x as (select a.entity_id s1_id, f.entity_id target_id, row_number() over (partition by a.entity_id order by place) n from m a join few f using (country) where a.entity_id like 'S1-%' and (a.entity_id, f.entity_id) not in (select (s1_id, target_id) from truth)), p as (select 1 y from truth union all select 0 from x where n <= 5) select y label, count(*) n, true near_share from p group by 1")
def held_out_split(spark, sf):
    """Rows of each label, and whether four in five of them are fitted on, but for half a row a bucket."""
    p = ML.held_out(ML.training_pairs(*meta(spark, sf)))
    return p.groupBy("label").agg(F.count("*").alias("n"), (F.abs(F.count_if("train") - 0.8 * F.count("*")) <= 32).alias("near_share"))


@query(f"with {O.PROB} select s1_id, target_id, prob from prob")
def lr_score_fixed_weights(spark, sf):
    return probable(spark, sf)[0].select("s1_id", "target_id", "prob")


@query(f"with {O.PROB} select s1_id, target_id from prob where -4.0 + 6.0 * name_jaccard + 3.0 * addr_jaccard >= ln(0.8 / (1.0 - 0.8))")
def above_threshold(spark, sf):
    return ML.above(compared(spark, sf)[0], {"name_jaccard": 6.0, "addr_jaccard": 3.0}, -4.0, 0.8).select("s1_id", "target_id")


@query()
def tiered_score(spark, sf):
    x = FT.eleven(paired(spark, sf)[0])
    return ML.tiered(x, {"name_ratio": 5.0, "addr_token_set": 3.0, "digit_jaccard": 1.0}, -5.0).select("s1_id", "target_id", F.round("prob", 9).alias("prob"))


def fitted(spark, sf, trees: bool):
    pairs, _, truth = paired(spark, sf)
    x = staged(ML.labelled(FT.sixteen(pairs), truth).select("s1_id", "target_id", "label", *FT.SIXTEEN))
    return ML.predict(ML.fit(x, FT.SIXTEEN, trees), x, FT.SIXTEEN).select("s1_id", "target_id", "label", F.round("prob", 4).alias("prob"))


@query()
def lr_fit_predict(spark, sf):
    return fitted(spark, sf, False)


@query()
def gbt_fit_predict(spark, sf):
    return fitted(spark, sf, True)


# matches and measures
@query(f"with {O.PROB} select s1_id, target_id, prob from best where prob >= {T}")
def assign_unique(spark, sf):
    return R.assigned(probable(spark, sf)[0], T).select("s1_id", "target_id", "prob")


_SWEEP = f"with {O.PROB}, {O.scores('select threshold, s1_id, target_id from best, grid where prob >= threshold', 'threshold,')}, sw as (select threshold, round(avg(precision_), 9) as \"precision\", round(avg(recall_), 9) recall, round(avg(f05), 9) f05 from scores group by 1)"


def swept(spark, sf):
    p, s1, truth = probable(spark, sf)
    return V.sweep(s1.select("s1_id"), truth, R.assigned(p), R.thresholds(p))


@query(f"{_SWEEP} select * from sw")
def threshold_sweep(spark, sf):
    return swept(spark, sf)


@query(f"{_SWEEP} select threshold, f05 from sw order by f05 desc, threshold limit 1")
def best_threshold(spark, sf):
    return V.best_of(swept(spark, sf))


@query(f"with {O.PROB}, l as (select prob, (s1_id, target_id) in (select (s1_id, target_id) from truth) y from prob), n as (select threshold, count(*) filter (prob >= threshold and y) tp, count(*) filter (prob >= threshold and not y) fp, count(*) filter (prob < threshold and y) fn from l, grid group by 1) select *, round(case when 1.25 * tp + 0.25 * fn + fp > 0 then 1.25 * tp / (1.25 * tp + 0.25 * fn + fp) else 0.0 end, 9) fbeta from n")
def pair_fbeta_sweep(spark, sf):
    p, _, truth = probable(spark, sf)
    return V.pair_sweep(ML.labelled(p, truth), R.thresholds(p))


_ENTITY = f"with {O.PROB}, {O.scores(f'select s1_id, target_id from best where prob >= {T}')}"


def entity(spark, sf):
    p, s1, truth = probable(spark, sf)
    return V.entity_scores(s1.select("s1_id"), truth, R.assigned(p, T))


@query(f"{_ENTITY} select s1_id, tp, n_pred, n_true, round(f05, 9) f05 from scores")
def entity_f05(spark, sf):
    return entity(spark, sf).select("s1_id", "tp", "n_pred", "n_true", F.round("f05", 9).alias("f05"))


@query(f"{_ENTITY} select round(avg(precision_), 9) as \"precision\", round(avg(recall_), 9) recall, round(avg(f05), 9) f05 from scores")
def macro_f05(spark, sf):
    return V.macro(entity(spark, sf))


@query(f"{_ENTITY} select count(*) filter (n_true = 0) singletons, count(*) filter (n_true = 0 and n_pred = 0) as \"right\", round(avg(f05) filter (n_true > 0), 9) linked_f05 from scores")
def singleton_accuracy(spark, sf):
    return V.singleton_accuracy(entity(spark, sf))


@query(f"with {O.TOP} select count(t.s1_id) captured, count(*) links, round(count(t.s1_id) * 1.0 / count(*), 9) recall from truth left join top t using (s1_id, target_id)")
def blocking_recall(spark, sf):
    pairs, _, _, truth = ranked(spark, sf)
    return V.blocking_recall(pairs, truth)


@query(f"with {O.TOP}, n as (select m.entity_id, count(t.s1_id) n from m left join top t on t.s1_id = m.entity_id where m.entity_id like 'S1-%' group by 1) select min(n) least, quantile_cont(n, 0.5) median, round(avg(n), 9) mean, round(quantile_cont(n, 0.95), 9) p95, max(n) most from n")
def candidate_distribution(spark, sf):
    s1, targets, _ = meta(spark, sf)
    pairs = B.best(s1, targets, B.THREE_PASSES)  # overlaps move no record's number of candidates
    return V.candidate_distribution(s1.select(F.col("entity_id").alias("s1_id")), pairs)


@query(f"with {O.PROB} select target_id, count(distinct s1_id) claims from prob where prob >= {T} group by 1 having claims > 1")
def collisions(spark, sf):
    return V.collisions(probable(spark, sf)[0].where(F.col("prob") >= T))


@query(f"with {O.TOP} select count(*) n_pairs, count(*) filter (a.country <> b.country) n_cross from top join m a on a.entity_id = s1_id join m b on b.entity_id = target_id")
def cross_country(spark, sf):
    pairs, s1, targets, _ = ranked(spark, sf)
    place = lambda df: df.select("entity_id", "country")
    return B.pair_up(pairs.select("s1_id", "target_id"), place(s1), place(targets)).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("a_country") != F.col("b_country")).alias("n_cross"))


_LIST = f"with {O.PROB}, res as (select s1.s1_id source1_entity_id, any_value(s1.country) country, any_value(s1.ordinal) ordinal, coalesce(string_agg(target_id, ',' order by target_id), '') matched_entity_ids from s1 left join (select * from best where prob >= {T}) b using (s1_id) group by 1)"


def results(spark, sf):
    p, s1, _ = probable(spark, sf)
    return IO.as_lists(s1, R.assigned(p, T)).join(s1.select(F.col("s1_id").alias("source1_entity_id"), "country"), "source1_entity_id")


@query(f"{_LIST} select source1_entity_id, matched_entity_ids from res")
def matching_result(spark, sf):
    return results(spark, sf).select("source1_entity_id", "matched_entity_ids")


@query(f"with {O.TOP} select m.entity_id source1_entity_id, coalesce(string_agg(target_id, ',' order by rank), '') candidate_entity_ids from m left join top on s1_id = m.entity_id where m.entity_id like 'S1-%' group by 1")
def candidate_result(spark, sf):
    pairs, s1, _, _ = ranked(spark, sf)
    return IO.as_lists(s1, pairs, [F.col("rank")], "candidate_entity_ids").drop("ordinal")


@query(f"{_LIST} select country, count(*) n, sum((matched_entity_ids = '')::int)::bigint n_empty, round(avg((matched_entity_ids = '')::int), 9) empty_rate from res group by 1")
def empty_rate_by_country(spark, sf):
    return V.empty_rate(results(spark, sf), F.col("country"), "country")


@query(f"{_LIST}, k as (select *, (row_number() over (order by ordinal) - 1) // 50 chunk from res) select chunk, count(*) n, sum((matched_entity_ids = '')::int)::bigint n_empty, round(avg((matched_entity_ids = '')::int), 9) empty_rate from k group by 1")
def empty_rate_by_chunk(spark, sf):
    return V.empty_rate(numbered(results(spark, sf)), F.floor(F.col("row") / 50), "chunk")


@query(f"with {O.M}, x as (select string_split(norm_name, ' ')[1] word, count(*) n from m where norm_name <> '' group by 1) select *, (select count(*) from x) n_distinct from x order by n desc, word limit 20")
def top_first_words(spark, sf):
    m = X.meta(FX.entities(spark, sf)).where("norm_name <> ''")
    return V.top_values(m, F.element_at(F.split("norm_name", " "), 1), "word")


BROKEN = "case when s1_id like '%3' then target_id || ',' || target_id when s1_id like '%5' then 'S1-1,X9' else target_id end"


@query(f"with {O.PROB}, r as (select s1_id, {BROKEN} l from (select s1_id, target_id from prob where rank <= 2)), e1 as (select s1_id, unnest(string_split(l, ',')) t from r), f as (select 'duplicate_row' as rule, s1_id offender from r group by s1_id having count(*) > 1 union select 'repeat_in_list', s1_id from r where len(string_split(l, ',')) > len(list_distinct(string_split(l, ','))) union select 'claimed_twice', t from e1 group by t having count(distinct s1_id) > 1 union select 'self_match', t from e1 where t like 'S1-%' union select 'bad_prefix', t from e1 where not regexp_matches(t, '^S[123]-') union select 'missing_s1', s1_id from s1 where s1_id not in (select s1_id from r) union select 'unknown_id', t from e1 where regexp_matches(t, '^S[23]-') and t not in (select entity_id from e)) select * from f")
def validate_result_rules(spark, sf):
    p, s1, _ = probable(spark, sf)
    bad = p.where("rank <= 2").select(F.col("s1_id").alias("source1_entity_id"), F.expr(BROKEN).alias("matched_entity_ids"))
    return Q.result_violations(bad, s1, FX.split(FX.entities(spark, sf))[1])


@query(f"with {O.PROB} select s1_id source1_entity_id, string_agg(target_id, ',' order by target_id) extra from prob where rank > 3 and prob >= 0.3 group by 1")
def subset_violations(spark, sf):
    p, s1, _ = probable(spark, sf)
    few = IO.as_lists(s1, p.where("rank <= 3"), [F.col("rank")], "candidate_entity_ids")
    return Q.subset_violations(IO.as_lists(s1, p.where("prob >= 0.3")), few)


_GAPS = "bad as (select source1_entity_id, case when source1_entity_id like '%5' then null else matched_entity_ids end matched_entity_ids from res where source1_entity_id not like '%3' union all select source1_entity_id || 'x', matched_entity_ids from res where source1_entity_id like '%7' union all select source1_entity_id, '' from res where source1_entity_id like '%11')"


@query(f"{_LIST}, {_GAPS} select count(*) n_rows, count(distinct source1_entity_id) n_ids, count(*) filter (matched_entity_ids is null) n_null, (select count(*) from s1 where s1_id not in (select source1_entity_id from bad)) n_missing, count(*) filter (source1_entity_id not in (select s1_id from s1)) n_extra from bad")
def coverage_report(spark, sf):
    r = staged(results(spark, sf).select("source1_entity_id", "matched_entity_ids"))
    r.createOrReplaceTempView("res")
    bad = spark.sql(f"with {_GAPS} select * from bad")
    return Q.coverage(bad, r.select(F.col("source1_entity_id").alias("entity_id")))


@query(f"{_LIST}, {_GAPS} select (select count(*) from s1 where s1_id not in (select source1_entity_id from bad)) missing, (select count(distinct source1_entity_id) from bad where source1_entity_id not in (select s1_id from s1)) unexpected, (select count(*) from (select 1 from bad group by source1_entity_id having count(*) > 1)) repeated")
def completeness(spark, sf):
    r = staged(results(spark, sf).select("source1_entity_id", "matched_entity_ids"))
    r.createOrReplaceTempView("res")
    return IO.completeness(spark.sql(f"with {_GAPS} select * from bad"), r.select(F.col("source1_entity_id").alias("entity_id")))


_RATE = "count(*) n, sum((matched_entity_ids = '')::int)::bigint n_empty, round(avg((matched_entity_ids = '')::int), 9) empty_rate, case when empty_rate > 0.5 then 'fail' when empty_rate > 0.15 then 'warn' else 'ok' end \"class\""


@query(f"{_LIST}, k as (select *, (row_number() over (order by ordinal) - 1) // 50 chunk from res) select 'all' part, 'all' as name, {_RATE} from k union all select 'country', country, {_RATE} from k group by country union all select 'chunk', chunk::varchar, {_RATE} from k group by chunk")
def coverage_diagnosis(spark, sf):
    return Q.coverage_diagnosis(results(spark, sf), FX.entities(spark, sf), 50)


@query(f"{_LIST} select source1_entity_id, matched_entity_ids from res")
def resumed_by_country(spark, sf):
    """The result built country by country, with one country done before."""
    r = staged(results(spark, sf))
    folder = scratch(spark)
    run = lambda country: r.where(F.col("country") == country).select("source1_entity_id", "matched_entity_ids", "ordinal")
    first = r.agg(F.min("country")).first()[0]
    IO.write_by_country(run(first).withColumn("country", F.lit(first)), folder)
    s1 = r.select(F.col("source1_entity_id").alias("entity_id"), "ordinal", "country")
    return IO.resume_by_country(s1, run, folder).drop("ordinal")


@query(f"with {O.PROB}, few as (select s1_id source1_entity_id, string_agg(target_id, ',' order by target_id) matched_entity_ids from prob where prob >= 0.3 group by 1), x as (select rule, offender, row_number() over (partition by rule order by offender) n from (select 'claimed_twice' as rule, target_id offender from prob where prob >= 0.3 group by 2 having count(*) > 1 union all select 'missing_s1', s1_id from s1 where s1_id not in (select source1_entity_id from few) union all select 'no_candidate', s1_id from prob where rank > 3 and prob >= 0.3 group by 2)), y as (select rule, count(*) n, string_agg(offender, ',' order by offender) filter (n <= 5) examples from x group by 1) select case when rule = 'no_candidate' then 'warning' else 'error' end \"level\", * from y union all select 'info', 'empty_rate', 0::bigint, '0.0'")
def result_report(spark, sf):
    p, s1, _ = probable(spark, sf)
    p = staged(p)
    rows = IO.as_lists(s1, p.where("prob >= 0.3")).where("matched_entity_ids <> ''").drop("ordinal")
    return Q.result_report(rows, s1, None, IO.as_lists(s1, p.where("rank <= 3"), [F.col("rank")], "candidate_entity_ids"))


# review
@query(f"with {O.PROB} select count(*) n_candidates, count(*) filter (prob >= {T}) n_links, count(distinct s1_id) filter (prob >= {T}) n_matched, round(avg(prob), 6) mean_prob from prob")
def overview_counts(spark, sf):
    p = probable(spark, sf)[0]
    hit = F.col("prob") >= T
    return p.agg(F.count("*").alias("n_candidates"), F.count_if(hit).alias("n_links"), F.countDistinct(F.when(hit, F.col("s1_id"))).alias("n_matched"), F.round(F.avg("prob"), 6).alias("mean_prob"))


@query(f"with {O.PROB} select s1_id, target_id, prob from (select *, row_number() over (partition by s1_id order by rank) n from prob where prob >= 0.4 and prob < {T}) where n = 1")
def borderline_first(spark, sf):
    return R.first_borderline(probable(spark, sf)[0], T).select("s1_id", "target_id", "prob")


@query(f"with {O.PROB} select s1_id, coalesce(string_agg(target_id, ',' order by rank) filter (prob >= 0.6), '') matched_ids, count(*) filter (prob >= 0.6) n_matched, case when n_matched > 0 then 'MATCHED' else 'SINGLETON' end status from prob group by 1")
def rethreshold(spark, sf):
    return R.rethreshold(probable(spark, sf)[0], 0.6)


@query(f"with {O.PROB} select s1_id, target_id, case when rank = 1 and s1_id like '%3' then true when rank = 2 then false else prob >= {T} end is_match from prob")
def decision_overlay(spark, sf):
    p = staged(probable(spark, sf)[0].select("s1_id", "target_id", "rank", "prob"))
    yes = p.where("rank = 1 and s1_id like '%3'").select("s1_id", "target_id", F.lit("accept").alias("action"), F.lit(2).alias("seq"))
    no = p.where("rank = 2 or (rank = 1 and s1_id like '%3')").select("s1_id", "target_id", F.lit("reject").alias("action"), F.lit(1).alias("seq"))
    return R.decided(p, yes.union(no), T).select("s1_id", "target_id", "is_match")


_DECIDED = f"{O.PROB}, d as (select *, case when rank = 1 and s1_id like '%3' then true when rank = 2 then false else prob >= {T} end is_match from prob)"


def decided_records(spark, sf):
    p, s1, _ = probable(spark, sf)
    p = staged(p)
    yes = p.where("rank = 1 and s1_id like '%3'").select("s1_id", "target_id", F.lit("accept").alias("action"), F.lit(2).alias("seq"))
    no = p.where("rank = 2").select("s1_id", "target_id", F.lit("reject").alias("action"), F.lit(1).alias("seq"))
    e = FX.split(FX.entities(spark, sf))[0]
    return R.review_records(e, R.decided(p, yes.union(no), T)), p


@query(f"with {_DECIDED} select e.entity_id s1_id, coalesce(string_agg(target_id, ',' order by prob desc, rank) filter (is_match), '') matched_ids, case when count(*) filter (is_match) > 0 then 'matched' else 'singleton' end status, count(target_id) n_candidates from e left join d on s1_id = entity_id where entity_id like 'S1-%' group by 1")
def review_records(spark, sf):
    return decided_records(spark, sf)[0].select("s1_id", "matched_ids", "status", F.size("candidates").cast("long").alias("n_candidates"))


@query(f"with {_DECIDED} select (select count(*) from s1) s1_processed, count(*) filter (is_match) confirmed_matches, (select count(*) from s1) - count(distinct s1_id) filter (is_match) singletons, count(*) candidate_pairs, round(avg(prob), 6) mean_prob from d")
def run_counters(spark, sf):
    return R.overview(*decided_records(spark, sf)).withColumn("mean_prob", F.round("mean_prob", 6))


@query(f"with {_DECIDED} select s1_id, to_json(struct_pack(s1_id := s1_id, n := count(*), matched := count(*) filter (is_match))) payload from d group by s1_id")
def json_payload(spark, sf):
    c = decided_records(spark, sf)[0].where(F.size("candidates") > 0)
    n = c.select("s1_id", F.size("candidates").cast("long").alias("n"), F.size(F.filter("candidates", lambda x: x["is_match"])).cast("long").alias("matched"))
    return IO.as_json(n).withColumn("s1_id", F.get_json_object("payload", "$.s1_id"))


@query(f"with {O.PROB} select distinct s1_id from prob where prob >= 0.4 and prob < 0.75 and contains(lower(s1_id), '-1')")
def review_filter(spark, sf):
    p, _, _ = probable(spark, sf)
    names = FX.entities(spark, sf).select(F.col("entity_id").alias("s1_id"), F.lit("").alias("business_name"), F.lit("").alias("business_address"))
    records = R.rethreshold(p, T).withColumn("matched_ids", F.lit("")).join(names, "s1_id")
    return R.reviewed(records, p, "review", "-1").select("s1_id")


@query(f"with {O.PROB} select case when prob >= 0.75 then 'high' when prob >= 0.4 then 'review' else 'low' end band, count(*) n from prob group by 1")
def confidence_bands(spark, sf):
    return probable(spark, sf)[0].groupBy(R.band(F.col("prob")).alias("band")).agg(F.count("*").alias("n"))


def _preset(name: str) -> None:
    def run(spark, sf):
        e = FX.entities(spark, sf)
        s1, targets = FX.split(e)
        model, threshold = PL.train(s1, targets, FX.truth(e), PL.PRESETS[name])
        return PL.link(s1, targets, model, threshold, PL.PRESETS[name])[1].drop("ordinal")

    QUERIES[f"link_{name}"] = run


for _name in ("modular", "full", "fast", "hardened"):
    _preset(_name)


@query()
def link_embedding(spark, sf):
    s1, targets = embedded(spark, sf)
    preset = PL.PRESETS["embedding"]
    model, threshold = PL.train(s1, targets, FX.truth(s1.unionByName(targets)), preset)
    return PL.link(s1, targets, model, threshold, preset)[1].drop("ordinal")


@query()
def link_first_word(spark, sf):
    """The embedding preset without vectors."""
    s1, targets = FX.split(FX.entities(spark, sf))
    return PL.link(s1, targets, *PL.train(s1, targets, FX.truth(targets), PL.PRESETS["embedding"]), PL.PRESETS["embedding"])[1].drop("ordinal")
