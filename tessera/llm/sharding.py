"""Sharding by sampled splitters.

Records are ordered by the hash of their text and then by their place in the input, so equal texts
are neighbours and yet a hot text can be cut anywhere. A size-weighted sample of these keys gives
quantile boundaries that range-partition the records; the exact bytes of every range are then added
up, and ranges that came out overfull are sampled anew and subdivided, until none is left that holds more than one
record. Running sizes
inside the ranges and the sums of the ranges before place each record exactly, so the shards' bytes
differ by at most about one record whatever the sample was. There are at most ``RANGES`` ranges, however many the records are,
so the driver sees a sample of a fixed size (about ``PER_RANGE`` keys a range) and a row for each range.

Nulls and edge cases: a null text has no bytes (size 1, CRC-32 of nothing); null and repeated ids and
equal rows are placed like any other; a text larger than a range is a range of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

#: Sample keys drawn for a range, rows that a range should hold, ranges at most, and the excess that makes one overfull.
PER_RANGE, ROWS, RANGES, OVERFULL = 64, 50_000, 4096, 1.5
KEYED = "id long, size long, crc long, key long, n long, range int"


def ranged(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with ``range``: how many of the sorted ``splitters (key, n)`` are at or before each."""
    keys = np.array([k for k, _ in splitters], np.int64)
    ties = np.array([n for _, n in splitters], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n = b.column("key").to_numpy(), b.column("n").to_numpy()
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            at = low.copy()
            for k in np.unique(key[low < high]):
                own = key == k
                s, e = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
                at[own] = s + np.searchsorted(ties[s:e], n[own], "right")
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(at, pa.int32())], [*b.schema.names[:5], "range"])

    return rows.select("id", "size", "crc", "key", "n").mapInArrow(run, KEYED)


def drawn(placed: DataFrame, over: dict[int, int], most: float, turn: int) -> list[tuple[int, int]]:
    """Quantiles of a size-weighted sample of the ranges ``over`` (to their bytes) that cut them into parts of ``most`` bytes.

    The sample has about ``PER_RANGE`` keys for each part, and so at most as many as there are parts of the whole. A record
    of more than ``most`` bytes, of which there are no more than parts, is drawn always and gets a part of its own.
    """
    uniform = F.pmod(F.xxhash64("key", "n", F.lit(turn)), F.lit(1 << 31)) / float(1 << 31)
    met = placed.where(F.col("range").isin(sorted(over))).where(uniform < F.col("size") * (PER_RANGE / most))
    sample: dict[int, list[tuple[int, int]]] = {}
    out = []
    for r in met.select("range", "key", "n", "size").collect():
        sample.setdefault(r["range"], []).append((r["key"], r["n"]))
        if r["size"] > most:
            out += [(r["key"], r["n"]), (r["key"], r["n"] + 1)]
    for r, keys in sample.items():
        keys.sort()
        parts = max(2, round(over[r] / most))
        out += [keys[len(keys) * i // parts] for i in range(1, parts)]
    return out


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, crc, shard, slot): shards of near equal bytes, slots without gaps in each."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.xxhash64(text).alias("key"),
            F.monotonically_increasing_id().alias("n"),
        )
    )
    whole = rows.agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).first()
    total = whole["bytes"] or 1
    ranges = min(max(8 * shards, -(-whole["rows"] // ROWS)), max(8 * shards, RANGES))
    most = total / ranges  # bytes that a range should hold
    splitters: list[tuple[int, int]] = []
    sums, over, turn = {0: (whole["rows"], whole["bytes"] or 0)}, [0], 0
    placed = ranged(rows, splitters)
    while over:
        more = set(drawn(placed, {r: sums[r][1] for r in over}, most, turn)).difference(splitters)
        if not more:
            break
        splitters, turn = sorted({*splitters, *more}), turn + 1
        placed = ranged(rows, splitters)
        sums = {r["range"]: (r["rows"], r["bytes"]) for r in placed.groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()}
        over = [r for r, (n, b) in sums.items() if n > 1 and b > OVERFULL * most]
    before, at, start = [], 0, 0
    for r in sorted(sums):
        before.append((r, at, start))
        at, start = at + sums[r][0], start + sums[r][1]
    # a row for each range, of which there are about rows / ROWS
    offsets = F.broadcast(spark.createDataFrame(before, "range int, rank0 long, byte0 long"))
    inside = Window.partitionBy("range").orderBy("key", "n")
    ordered = placed.select(
        "id", "size", "crc", "range", F.row_number().over(inside).alias("rn"), F.sum("size").over(inside).alias("upto")
    ).join(offsets, "range")
    dealt = cut(
        ordered.select(
            "id",
            "size",
            "crc",
            (F.col("rank0") + F.col("rn") - 1).alias("rank"),
            F.least(F.floor((F.col("byte0") + F.col("upto") - F.col("size") / 2) * shards / F.lit(total)), F.lit(shards - 1)).cast("int").alias("shard"),
        )
    )
    # a row for each shard
    first = F.broadcast(dealt.groupBy("shard").agg(F.min("rank").alias("first")))
    return dealt.join(first, "shard").select("id", "size", "crc", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), 8).select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op4_sharding": op4_sharding}
ORACLE_SQL: dict[str, str] = {}
