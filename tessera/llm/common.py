"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps the bytes of a UTF-8 text so that ``.translate(...).split()`` yields its lower-cased
#: alphanumeric words: ASCII letters and digits and every byte of a non-ASCII character are kept.
ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where none is set in a local session, as in tests, is a temporary one chosen.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    The files go when the result is no longer referenced, if the session has
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of which the texts are taken out of a batch at a time.
ROWS_AT_ONCE = 500


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that few texts at a time become objects."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(at, ROWS_AT_ONCE)


def text_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column's values; null as empty."""
    return [v.encode() if v is not None else b"" for v in column.to_pylist()]


#: Tasks that the edges of one node are dealt to.
SALTS = 16


def joined(edges: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """``edges`` joined with ``least`` on ``key``; a node with many edges is dealt to ``SALTS`` tasks."""
    own = edges.withColumn("salt", F.pmod(F.xxhash64(*edges.columns), F.lit(SALTS)))
    every = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return own.join(every, [key, "salt"]).drop("salt")


def connected(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges (a, b)`` by alternating large and small stars.

    Returns ``(node, root)`` for every node that has an edge and is not itself the smallest of its
    component. Each round is two aggregations and two joins over the edges, whose number never
    grows; the number of rounds is logarithmic in practice. Self loops, repeated edges and null
    ends are ignored.
    """
    e = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = None
    while True:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = joined(both, low, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            joined(large, least, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("p"))
            .select("p.u", F.col("p.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        e = cut(small)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes (node, rep, ...)`` with class, the least node reachable over ``links (a, b)``, and component, the least rep in it."""
    root = connected(links)
    # only nodes that have a link
    linked = cut(root.select("node", F.col("root").alias("class")).union(root.select("root", "root").distinct()).join(nodes.select("node", "rep"), "node"))
    told = joined(linked, linked.groupBy("class").agg(F.min("rep").alias("component")), "class").select("node", "class", "component")
    return nodes.join(told, "node", "left").withColumns({"class": F.coalesce("class", "node"), "component": F.coalesce("component", "rep")})


def labelled(seen: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """``seen (id, ...)`` with the class and the component that ``told`` has for its ``key``; rows without an id have none."""
    own = seen.join(told, key, "left")
    return own.withColumns({c: F.when(F.col("id").isNotNull(), F.col(c)) for c in ("class", "component")})


_HELD: dict = {}


def held(name: str | None, make=None):
    """What a worker keeps from task to task for the operator ``name``; it forgets that of others, and all of it for None."""
    if name not in _HELD:
        _HELD.clear()
        if name is not None:
            _HELD[name] = make()
    return _HELD.get(name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_of_each(docs: DataFrame, seen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each class; rows without an id stay.

    ``seen (id, key, class)`` has a row for each of ``docs``; key is the xxhash64 of its text. The row that stays is one of
    the class's least id and, of these, least key.
    """
    key, own_id, own_key = (fresh(docs, n) for n in ("text_key", "own_id", "own_key"))
    kinds = cut(seen.where("id is not null").groupBy("class", "id", "key").agg(F.count("*").alias("n")))
    first = kinds.groupBy("class").agg(F.min(F.struct("id", "key")).alias("first"))
    known = cut(kinds.join(first, "class").select(F.col("id").alias(own_id), F.col("key").alias(own_key), "n", (F.struct("id", "key") == F.col("first")).alias("stays")))
    spare, many = known.where("not stays").select(own_id, own_key), known.where("stays and n > 1").select(own_id, own_key)
    on = (F.col(id_col).cast("long") == F.col(own_id)) & (F.col(key) == F.col(own_key))
    left = docs.withColumn(key, F.xxhash64(text_col)).join(spare, on, "left_anti")
    if not many.limit(1).count():  # no row that stays is repeated
        return left.drop(key)
    once = left.join(many, on, "left_semi").dropDuplicates([id_col, key])
    return left.join(many, on, "left_anti").unionByName(once).drop(key)
