"""WARC fixity audit with Merkle trees.

Records are WARC response records made of pages. The hash of its id and url places a record: the hashes' space is cut into
files and each file into ``FAN ** 2`` ranges, so the records of a range lie side by side, and a file's ranges one after another, each an
offset range of the file. The bounds are bounds of hashes: a lost, longer or inserted record
changes its own range and none behind it. A range hashes its records in order, each with its offset in the range, length, digest and number of
copies; a node hashes its ``FAN`` children in order, each with its offset in the node and length, up to the
root of the file. Replicas are audited by their roots: only of files whose roots differ are the trees fetched, and only below
mismatching nodes are the children compared, down to ranges. Of the records of mismatching ranges alone, those that
stand on both sides are taken away; what is left is a damaged record where both sides have one of that id, else a missing or a surplus one.
Files are bounded (``FILE_ROWS`` different records on average), so the hot host of a crawl spreads over files; equal
records are one with a number of copies until they are placed.

Nulls and edge cases: a null url or html is an empty one; null and repeated ids are records of their own; records of equal
id and url lie side by side, ordered by their digest; equal records follow each other, and of these the last ones count as missing or surplus; an empty
table has no files; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, partitions, table

#: Children of a node, and different records that a file has on average.
FAN, FILE_ROWS = 16, 4096
RANGES = FAN**2
_BITS = 52


def records(pages: DataFrame, files: int, id_col: str = "page_id") -> DataFrame:
    """(file, range, seq, id, offset, length, digest): the records of every file with their offset ranges."""
    body = F.coalesce("html", F.lit(""))
    size = F.octet_length(body)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"),
    )
    made = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long"), F.coalesce("url", F.lit(""))), 64 - _BITS).alias("key"),
        (F.octet_length(head) + size + 4).cast("long").alias("length"),
        F.sha2(F.concat(head, body, F.lit("\r\n\r\n")), 256).alias("digest"),
    )
    one = made.groupBy("id", "key", "length", "digest").agg(F.count("*").alias("copies"))
    place = F.floor(F.col("key") * F.lit(float(files * RANGES) / (1 << _BITS)))
    dealt = one.withColumns({"file": F.floor(place / RANGES).cast("int"), "range": F.pmod(place, F.lit(RANGES)).cast("int")})
    inside = Window.partitionBy("file").orderBy("key", "id", "digest").rowsBetween(Window.unboundedPreceding, 0)
    upto = lambda c: F.sum(c).over(inside) - c
    placed = dealt.repartition(partitions(pages.sparkSession), "file").withColumns({"first": upto(F.col("copies")), "begin": upto(F.col("copies") * F.col("length"))})
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return placed.withColumn("copy", copy).select(
        "file", "range", (F.col("first") + F.col("copy")).alias("seq"), "id", (F.col("begin") + F.col("copy") * F.col("length")).alias("offset"), "length", "digest"
    )


def digest(kind: bytes, parts: list[tuple]) -> bytes:
    """The hash of an ordered range; ``kind`` tells ranges of records from nodes."""
    return hashlib.sha256(kind + b"".join(str(p).encode() + b"\n" for p in parts)).digest()


def tree(own: pa.Table) -> pa.Table:
    """(file, root, nodes) of one file: the hashes of its ranges, of the nodes above them, and of the root, one after another."""
    ranges: list[list[tuple]] = [[] for _ in range(RANGES)]
    for r in sorted(own.to_pylist(), key=lambda r: r["seq"]):
        ranges[r["range"]].append((r["copies"], r["length"], r["digest"], r["id"]))
    level, sizes = [], []
    for held in ranges:
        at, parts = 0, []
        for copies, length, *rest in held:
            parts.append((at, copies, length, *rest))
            at += copies * length
        level.append(digest(b"\0", parts))
        sizes.append(at)
    nodes = b"".join(level)
    while len(level) > 1:
        parts = [[(sum(sizes[i:k]), sizes[k], level[k].hex()) for k in range(i, i + FAN)] for i in range(0, len(level), FAN)]
        level, sizes = [digest(b"\1", p) for p in parts], [sum(sizes[i : i + FAN]) for i in range(0, len(sizes), FAN)]
        nodes += b"".join(level)
    return pa.table({"file": own.column("file")[:1].cast(pa.int32()), "root": pa.array(level, pa.binary()), "nodes": pa.array([nodes], pa.binary())})


def descended(ours: bytes | None, theirs: bytes | None) -> tuple[list[int], int]:
    """The mismatching ranges of a file, and how many nodes were compared; None is a file that a replica lacks."""
    bounds, width = [], RANGES
    while width:
        bounds.append((sum(w for _, w in bounds), width))
        width //= FAN
    look, compared = [0], 0
    for start, _ in reversed(bounds):
        compared += len(look)
        differ = [k for k in look if ours is None or theirs is None or ours[32 * (start + k) : 32 * (start + k + 1)] != theirs[32 * (start + k) : 32 * (start + k + 1)]]
        look = differ if not start else [k * FAN + j for k in differ for j in range(FAN)]
    return look, compared


def audited(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file, seq, kind, compared): records in which the replicas differ, found from the roots down.

    kind is damaged, missing (from ``right``) or surplus; file and seq are those of a surplus record in ``right``, else in
    ``left``; compared counts the nodes looked at in the file.
    """

    def collapsed(own: DataFrame) -> DataFrame:
        one = own.groupBy("file", "range", "id", "length", "digest").agg(F.min("seq").alias("seq"), F.count("*").alias("copies"))
        return cut(one.repartition(partitions(own.sparkSession), "file"))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for file, ours, theirs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ranges, compared = descended(ours, theirs)
                out += [(file, r, compared) for r in ranges]
            if out:
                kinds = [pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["file", "range", "compared"])

    a, b = collapsed(left), collapsed(right)
    x, y = (cut(t.groupBy("file").applyInArrow(lambda t: tree(t), "file int, root binary, nodes binary")) for t in (a, b))
    roots = x.select("file", F.col("root").alias("x")).join(y.select("file", F.col("root").alias("y")), "file", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("file")
    trees = roots.join(x.select("file", F.col("nodes").alias("x")), "file", "left").join(y.select("file", F.col("nodes").alias("y")), "file", "left")
    ranges = cut(trees.select("file", "x", "y").mapInArrow(descend, "file int, range int, compared long"))
    own, other = (
        t.join(ranges, ["file", "range"]).select("file", F.coalesce(F.col("id").cast("string"), F.lit("-")).alias("name"), "length", "digest", F.col("seq").alias(f"{n}_seq"), F.col("copies").alias(n), F.col("compared").alias(f"{n}_compared"))
        for t, n in ((a, "x"), (b, "y"))
    )
    met = own.join(other, ["file", "name", "length", "digest"], "full").fillna(0, ["x", "y"]).where("x <> y")
    ours, least = F.col("x") > F.col("y"), F.least("x", "y")
    alone = met.select(
        "file", "name", ours.alias("ours"), F.coalesce("x_compared", "y_compared").alias("compared"),
        F.explode(F.transform(F.sequence(least, F.greatest("x", "y") - 1), lambda i: F.when(ours, F.col("x_seq")).otherwise(F.col("y_seq")) + i)).alias("seq"),
    )
    # a record is damaged if its id is left on both sides, wherever its url placed it
    number = F.row_number().over(Window.partitionBy("name", "ours").orderBy("file", "seq"))
    side = lambda c, mine: F.max(F.when(F.col("ours") == F.lit(mine), F.col(c)))
    paired = alone.withColumn("n", number).groupBy("name", "n").agg(*(side(c, mine).alias(f"{c}_{'xy'[not mine]}") for mine in (True, False) for c in ("file", "seq", "compared")))
    kind = F.when(F.col("seq_x").isNull(), "surplus").when(F.col("seq_y").isNull(), "missing").otherwise("damaged")
    return paired.select(F.coalesce("file_x", "file_y").alias("file"), F.coalesce("seq_x", "seq_y").alias("seq"), kind.alias("kind"), F.coalesce("compared_x", "compared_y").alias("compared"))


def damaged(pages: DataFrame, rot: int = 997, lost: int = 1499, added: int = 1999) -> DataFrame:
    """A replica as a stand-in for a second store: one in so many pages begins with another character, or is cut to half; is lost; or has a second
    version, under a negative id."""
    one = lambda name, n: F.pmod(F.xxhash64("page_id", F.lit(name)), F.lit(n)) == 0
    half = F.substring("html", 1, F.length("html") / 2)
    other = F.when(one("half", 2), F.concat(F.lit("\u0001"), F.substring("html", 2, 1 << 30))).otherwise(half)
    kept = pages.where(~F.coalesce(one("lost", lost), F.lit(False))).withColumn("html", F.when(one("rot", rot), other).otherwise(F.col("html")))
    return kept.union(pages.where(one("added", added)).withColumn("page_id", -1 - F.col("page_id")))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of ``pages``, and those that only the replica has, with its range and digest, and what the audit says."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    files = max(1, -(-pages.count() // FILE_ROWS))
    own, other = cut(records(pages, files)), cut(records(damaged(pages), files))
    found = cut(audited(own, other).select("file", "seq", "kind"))
    ours = own.join(found.where("kind <> 'surplus'"), ["file", "seq"], "left").withColumn("kind", F.coalesce("kind", F.lit("intact")))
    theirs = other.join(found.where("kind = 'surplus'"), ["file", "seq"])
    return ours.unionByName(theirs).select(F.col("id").alias("page_id"), "file", "seq", "offset", "length", "digest", F.col("kind").alias("status"))


QUERIES = {"op5_warc_fixity": op5_warc_fixity}
ORACLE_SQL: dict[str, str] = {}
