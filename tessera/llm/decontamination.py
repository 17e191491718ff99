"""Benchmark decontamination with DataFrame functions alone.

The windows of the benchmark's items (``n`` consecutive normalised words; a shorter item is one
window) become a set of numbered windows with 64-bit hashes. The set, without the items, is broadcast only after its rows have been
counted and found to be at most ``BROADCAST_ROWS`` (a window has ``n`` words). Documents are scanned once into token windows by
hash, and what hits is verified word for word. Only hits and one mark for each document, which carries its number of words, are
shuffled, so a hot passage costs one row a document and place; the items of a window are joined to the documents that it hits. Beyond
``BROADCAST_ROWS`` the hashes of all token windows, without their texts, are shuffled first to find the documents that any window can hit, and only those
are shuffled with their words.

Nulls and edge cases: a null text has no words; items and documents without words hit nothing;
equal items are all reported; a window that stands in several items counts for each; a repeated
document id gets the hits of its own row (rows are told apart by their text, and equal rows get the same); texts of any length are
scanned whole; empty tables give empty or clean results; other columns, whatever their names, are ignored or carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows up to which their set is broadcast.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """The words of a text, A to Z in lower case: runs of ASCII letters, digits and non-ASCII characters."""
    text = F.coalesce(text, F.lit(""))
    # bytes alone tell an ASCII text, whose lower case needs no look at characters
    small = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(small, GAP), lambda w: w != "")


def windows(items: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(number, size, gram, h) of the different windows of ``items (item, w)``, and (number, item) of where they stand."""
    size = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    every = items.where(F.size("w") > 0).select("item", size.alias("size"), F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("gram")).distinct()
    kinds = every.select("size", "gram").distinct().withColumn("number", F.monotonically_increasing_id())
    grams = cut(kinds.withColumn("h", F.xxhash64(F.transform("gram", lambda w: F.xxhash64(w)))))
    return grams, every.join(grams, ["size", "gram"]).select("number", "item")


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, doc_key, copies, n_words, at, items): for each document its hit word positions from 1 and the items.

    Rows of equal id and text are one, with their number as ``copies``.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    grams, owners = windows(items, n)
    # sizes of windows are between 1 and n, and so are the rows that come back
    found = {r["size"]: r["rows"] for r in grams.groupBy("size").agg(F.count("*").alias("rows")).collect()}
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("doc_key"), words(F.col(text_col)).alias("w"))
    scanned = base.withColumn("hw", F.transform("w", lambda w: F.xxhash64(w)))

    def hashed(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("w") - (size - 1))
        return F.when(F.size("w") >= size, F.transform(starts, lambda i: F.xxhash64(F.slice("hw", i, size)))).otherwise(F.array().cast("array<bigint>"))

    # the mark of a document stands at 0; then come the windows of one size after those of another
    before, start = F.lit(0), F.lit(None).cast("int")
    for size in sorted(found):
        start = F.when(F.col("size") == size, F.col("p") - before).otherwise(start)
        before = before + F.greatest(F.size("w") - (size - 1), F.lit(0))
    nothing, every = F.array().cast("array<bigint>"), [hashed(s) for s in sorted(found)]
    if sum(found.values()) <= BROADCAST_ROWS:
        grams = F.broadcast(grams)
        places = F.concat(nothing, *every)
    else:
        hashes = scanned.select("id", "doc_key", F.explode(F.concat(nothing, *every)).alias("h"))
        touched = hashes.join(grams.select("h").distinct(), "h", "left_semi").select(F.col("id").alias("own"), F.col("doc_key").alias("own_key"), F.lit(True).alias("touched")).distinct()
        scanned = scanned.join(touched, scanned.id.eqNullSafe(F.col("own")) & (F.col("doc_key") == F.col("own_key")), "left")
        places = F.when(F.col("touched"), F.concat(nothing, *every)).otherwise(nothing)
    met = (
        scanned.select("id", "doc_key", "w", F.posexplode(F.concat(F.array("doc_key"), places)).alias("p", "h"))
        .join(grams, "h", "left")
        .where((F.col("p") == 0) | F.col("number").isNotNull())
        .withColumn("start", F.when(F.col("p") > 0, start))
        .where((F.col("p") == 0) | ((F.col("start") >= 1) & (F.slice("w", F.greatest("start", F.lit(1)), F.col("size")) == F.col("gram"))))
    )
    hit = F.col("start").isNotNull()
    marked = (
        met.select("id", "doc_key", F.size("w").cast("long").alias("n_words"), (F.col("p") == 0).cast("int").alias("mark"), F.when(hit, F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at"), F.when(hit, F.col("number")).alias("number"))
        .groupBy("id", "doc_key")
        .agg(
            F.sum("mark").cast("int").alias("copies"),
            F.max("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("at")))).alias("at"),
            F.collect_set("number").alias("numbers"),
        )
    )
    # windows that hit are few and so are the documents that they do; equal sets of windows have equal items
    marked = cut(marked)
    sets = marked.where(F.size("numbers") > 0).select(F.array_sort("numbers").alias("set")).distinct()
    named = sets.select("set", F.explode("set").alias("number")).join(owners, "number").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return marked.join(named, F.array_sort("numbers") == F.col("set"), "left").select("id", "doc_key", "copies", "n_words", "at", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, doc_key, at, items): for documents with hits, the hit word positions from 1 and the items."""
    return scan(docs, benchmark, n, id_col, text_col, item_col).where(F.size("at") > 0).select("id", "doc_key", "at", "items")


def judged(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, doc_key, n_words, n_hit, items, contaminated) for every row."""
    hit = F.size("at").cast("long")
    return (
        scan(docs, benchmark, n, id_col, text_col)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("id", "doc_key", "n_words", hit.alias("n_hit"), "items", ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"))
    )


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the hit words taken out of their texts; the gaps around the words stay."""
    at, key, own, own_key, word, gap = (fresh(docs, c) for c in ("hit_at", "text_key", "hit_id", "hit_key", "hit_words", "hit_gaps"))
    met = hits(docs, benchmark, n, id_col, text_col).select(F.col("id").alias(own), F.col("doc_key").alias(own_key), F.col("at").alias(at))
    both = docs.withColumn(key, F.xxhash64(text_col)).join(met, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(key) == F.col(own_key)), "left")
    # the runs of hit words, as few as they are: a word goes if it lies in one
    begin = F.filter(at, lambda x, i: (i == 0) | (F.get(F.col(at), i - 1) != x - 1))
    end = F.filter(at, lambda x, i: F.coalesce(F.get(F.col(at), i + 1) != x + 1, F.lit(True)))
    pattern = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
    both = both.withColumns({at: F.arrays_zip(begin.alias("s"), end.alias("e")), word: F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1)), gap: F.split(text_col, pattern)})
    left = F.transform(word, lambda w, i: F.when(F.exists(at, lambda r: (r["s"] <= i + 1) & (i + 1 <= r["e"])), F.lit("")).otherwise(w))
    clean = F.array_join(F.transform(F.arrays_zip(F.col(gap).alias("g"), F.concat(left, F.array(F.lit(""))).alias("w")), lambda z: F.concat(z["g"], z["w"])), "")
    return both.withColumn(text_col, F.when(F.col(at).isNull(), F.col(text_col)).otherwise(clean)).select(*docs.columns)


def filtered(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    own, own_key = fresh(docs, "bad_id"), fresh(docs, "bad_key")
    bad = judged(docs, benchmark, n).where("contaminated").select(F.col("id").alias(own), F.col("doc_key").alias(own_key)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(own_key)), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op9_decontamination": op9_decontamination}
ORACLE_SQL = {
    "op9_decontamination": f"""
with items as (select cast(item_id as varchar) item, {_WORDS} w from benchmark),
sized as (select item, w, least(len(w), 13) size from items where len(w) > 0),
grams as (select distinct item, size, array_to_string(list_slice(w, s, s + size - 1), ' ') gram
          from (select item, w, size, unnest(range(1, len(w) - size + 2)) s from sized)),
docs as (select doc_id, {_WORDS} w from documents),
wins as (select doc_id, size, s, array_to_string(list_slice(w, s, s + size - 1), ' ') gram
         from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) s
               from docs, (select distinct size from sized) where len(w) >= size)),
met as (select doc_id, s, size, item from wins join grams using (size, gram)),
places as (select doc_id, count(distinct p) n_hit
           from (select doc_id, unnest(range(s, s + size)) p from met) group by doc_id),
named as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) ids
          from met group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from docs left join places using (doc_id) left join named using (doc_id)
"""
}
