"""SimHash near-duplicate groups by tiled exact comparison.

Every text gets a 64-bit fingerprint; texts whose fingerprints differ in at most ``radius`` bits are
linked, and linked texts form groups. Equal fingerprints collapse first, so a group of copies costs
one fingerprint. Distinct fingerprints meet in buckets: the 64 bits are cut into more blocks than the
radius, and two fingerprints within the radius agree wholly on some ``blocks - radius`` of them, so
comparing only inside buckets of equal blocks loses no pair. Inside a bucket the fingerprints are
sorted by population count, cut into tiles and compared tile by tile with an exclusive or and a bit
count; tile pairs whose population counts differ by more than the radius are skipped. A bucket that
holds more than ``TILE`` fingerprints is dealt over several tasks, a task for each pair of its
parts. What leaves a task is a spanning forest of the links that it found, never all pairs.

Copies of a given similarity (``near_groups``): two texts whose sets of five-word shingles have a
Jaccard similarity of 0.8 lie about 10 of 64 majority bits apart, with a wide spread, and no buckets
of equal blocks exist for such a radius. There a fingerprint has ``BITS`` bits, each the hashed least
value of the shingle set under one of as many hash functions, so two texts differ in a share
``(1 - similarity) / 2`` of them. Buckets are by ``BANDS`` bands of ``ROWS`` least values: a pair at
0.8 shares none with a probability of 7e-6. Inside a bucket the tiles are compared as above. The
fingerprints give candidates only, at a radius of ``WIDE`` standard errors beyond the similarity (a
pair at 0.8 is farther apart with a probability of 3e-7). What the candidates connect is a cell; each
text of a cell is fetched once, and pairs of a cell within the radius are linked only if the exact
Jaccard similarity of their shingle sets (of 64-bit hashes) is reached. Equal sets collapse first. A
cell of more than ``TILE`` texts or ``HELD`` bytes is dealt over several tasks like a bucket.

Nulls and edge cases: a null text counts as empty; a text without words has fingerprint zero and is
linked like any other; rows without an id keep their fingerprint, link nothing and have a null
component. Repeated rows link with each other. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ALNUM, connected, cut, held, joined, labelled, named, one_of_each, partitions, sliced, table, text_bytes

#: Fingerprints of one bucket that one task compares with each other.
TILE = 4096
#: Bits of a fingerprint of least values, and the bands and least values a band for its buckets.
BITS, BANDS, ROWS = 1024, 30, 5
#: Standard errors that the radius of candidates is wide, and bytes of text in one part of a cell.
WIDE, HELD = 5, 32 << 20
#: Elements of a comparison first held against all others: their copies need no comparing among themselves.
PIVOTS = 32
#: Edge of a block of comparisons inside a task.
BLOCK = 512


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority vote of the bits of the XXH64 (seed 42) of the word shingles of lower-cased text."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(42)), dtype="<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp): the hash and the signed 64-bit fingerprint of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        for b in sliced(batches):
            fps = [fingerprint(t, shingle) for t in text_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(fps, pa.int64())], ["id", "key", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("t")).mapInArrow(
        run, "id long, key long, fp long"
    )


def merged(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unite the classes of a[i] and b[i]; labels[x] is the least member of x's class."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := labels[labels], labels):
            labels = up
    return labels


def linked(fps: np.ndarray, radius: int) -> np.ndarray:
    """Class labels (least position) of fingerprints joined by distances of at most ``radius``."""
    fps = fps.astype(np.uint64, copy=False)
    pop = np.bitwise_count(fps)
    order = np.argsort(pop, kind="stable")
    fps, pop = fps[order], pop[order].astype(np.int64)
    labels = np.arange(len(fps))
    for i in range(0, len(fps), BLOCK):
        one, top = fps[i : i + BLOCK], pop[min(i + BLOCK, len(fps)) - 1]
        for j in range(i, len(fps), BLOCK):
            if pop[j] - top > radius:
                break
            near = np.bitwise_count(one[:, None] ^ fps[None, j : j + BLOCK]) <= radius
            x, y = np.nonzero(near)
            labels = merged(labels, x + i, y + j)
    least = np.full(len(fps), len(fps))
    np.minimum.at(least, labels, order)
    out = np.empty(len(fps), dtype=np.int64)
    out[order] = least[labels]
    return out


def blocks_for(rows: int, radius: int) -> int:
    """Blocks to cut 64 bits into: the fewest whose bucket keys have more values than there are rows."""
    for n in range(radius + 1, 2 * radius + 4):
        if 64 * (n - radius) // n >= rows.bit_length():
            return n
    return 2 * radius + 3


def links(nodes: DataFrame, rows: int, radius: int) -> DataFrame:
    """Edges (a, b) whose classes are those of all pairs of ``nodes (fp)`` within ``radius`` bits."""
    n = blocks_for(rows, radius)
    ends = [64 * i // n for i in range(n + 1)]
    masks = [
        sum(((1 << ends[i + 1]) - (1 << ends[i])) for i in kept)
        for kept in itertools.combinations(range(n), n - radius)
    ]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(k).alias("way"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)))
    dealt = nodes.select("fp", F.inline(keys))
    many = dealt.groupBy("way", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = (
        dealt.join(many, ["way", "key"])
        .withColumn("parts", parts)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .groupBy("way", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
        .agg(F.collect_list("fp").alias("fps"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).offsets.to_numpy()
            reps = b.column(0).values.to_numpy(zero_copy_only=False)
            fps = reps.view(np.uint64)
            ends_a, ends_b = [], []
            for s, e in itertools.pairwise(at):
                if e - s == 2:
                    if int(fps[s] ^ fps[s + 1]).bit_count() <= radius:
                        ends_a.append(reps[s : s + 1])
                        ends_b.append(reps[s + 1 : e])
                elif e - s > 2:
                    label = linked(fps[s:e], radius)
                    x = np.flatnonzero(label != np.arange(e - s))
                    ends_a.append(reps[s + x])
                    ends_b.append(reps[s + label[x]])
            if ends_a:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(ends_a)), pa.array(np.concatenate(ends_b))], ["a", "b"]
                )

    return met.select("fps").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp, class, component) for every row; component is the least id reachable over links.

    class tells groups apart whose least ids are the same, as ids may be repeated.
    """
    fps = cut(fingerprints(docs, shingle, id_col, text_col))
    nodes = cut(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    told = named(nodes.withColumnRenamed("fp", "node"), links(nodes, nodes.count(), radius)).select(F.col("node").alias("fp"), "class", "component")
    return labelled(fps, told, "fp").select("id", "key", "fp", "class", "component")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of each group, of the least id, and of these of the least hash of the text; rows without an id stay."""
    return one_of_each(docs, groups(docs, shingle, radius))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's set of word shingles; never empty.

    Words are lower-cased runs of ASCII letters, digits and other characters than ASCII, so marks make no difference; a text
    without any is taken by white space.
    """
    words = text.translate(ALNUM).split() or text.lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words, itertools.repeat(42)), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    x = np.full(n if words else 1, len(words) < shingle, np.uint64)
    for k in range(min(shingle, len(words))):
        x = (x ^ (x >> np.uint64(31))) * _MIX + h[k : k + n]
    return np.unique((x ^ (x >> np.uint64(29))) * _MIX)


def least_values(values: np.ndarray) -> tuple[bytes, list[int]]:
    """The fingerprint of least values of a set of shingles, and its band keys."""
    x = np.unique((values >> np.uint64(32)).astype(np.uint32))
    least = np.full(BITS, 2**32 - 1, np.uint32)
    for i in range(0, len(x), BLOCK):
        np.minimum(least, np.multiply.outer(_FACTORS, x[i : i + BLOCK]).min(axis=1), out=least)
    bits = ((least ^ (least >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(31)
    bands = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)]
    return np.packbits(bits.astype(np.uint8)).tobytes(), np.array(keys, np.uint64).view(np.int64).tolist()


_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(42).integers(0, 2**31, BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def wide_linked(fps: np.ndarray, radius: int) -> np.ndarray:
    """Class labels (least position) of fingerprints, rows of 64-bit words, joined by at most ``radius`` bits.

    A few pivots come first. What they join lies side by side then, and blocks of one class are skipped.
    """
    labels, pop = np.arange(len(fps)), np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    for _ in range(min(PIVOTS, len(fps))):
        alone = np.flatnonzero(labels == np.arange(len(fps)))
        p = alone[_ % len(alone)]
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[p]).sum(axis=1, dtype=np.int64) <= radius)
        labels = merged(labels, np.full(len(near), p), near)
    order = np.lexsort((pop, labels))
    for i in range(0, len(fps), BLOCK):
        one = order[i : i + BLOCK]
        for j in range(i, len(fps), BLOCK):
            two = order[j : j + BLOCK]
            apart = max(pop[two].min() - pop[one].max(), pop[one].min() - pop[two].max())
            both = np.union1d(labels[one], labels[two])
            if apart > radius or len(both) == 1:
                continue
            far = np.zeros((len(one), len(two)), np.int16)
            for k in range(fps.shape[1]):
                far += np.bitwise_count(fps[one, k][:, None] ^ fps[None, two, k])
            x, y = np.nonzero(far <= radius)
            labels = merged(labels, one[x], two[y])
    return labels


def verified(sets: list[np.ndarray], fps: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """Class labels (least position) of sets joined by a Jaccard similarity of at least ``similarity``.

    Only pairs within ``radius`` bits are looked at, and none whose sets are of one class already.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    labels, mark = np.arange(len(sets)), np.zeros(len(kinds), bool)
    for i in range(len(sets) - 1):
        rest = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
        rest = rest[np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i])]
        rest = rest[np.bitwise_count(fps[rest] ^ fps[i]).sum(axis=1, dtype=np.int64) <= radius]
        if not len(rest):
            continue
        mark[own[i]] = True
        starts = np.cumsum(sizes[rest]) - sizes[rest]
        common = np.add.reduceat(mark[np.concatenate([own[j] for j in rest])], starts, dtype=np.int64)
        mark[own[i]] = False
        rest = rest[common >= similarity * (sizes[rest] + sizes[i] - common)]
        labels = merged(labels, np.full(len(rest), i), rest)
    return labels


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, class, component) for every row, key being the hash of its text: texts linked at the given Jaccard similarity of their shingle sets or more."""
    share = (1 - similarity) / 2
    radius = int(BITS * share + WIDE * (BITS * share * (1 - share)) ** 0.5)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        for b in sliced(batches):
            sets = [shingle_set(t, shingle) for t in text_bytes(b.column(2))]
            found = [least_values(s) for s in sets]
            kin = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            columns = [kin, pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *columns], ["id", "key", "kin", "fp", "keys"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        for b in sliced(batches):
            ends_a, ends_b = [], []
            for fps, reps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                label = wide_linked(np.frombuffer(b"".join(fps), np.uint64).reshape(len(fps), -1), radius)
                reps, x = np.array(reps, np.int64), np.flatnonzero(label != np.arange(len(fps)))
                ends_a.append(reps[x])
                ends_b.append(reps[label[x]])
            if ends_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ends_a)), pa.array(np.concatenate(ends_b))], ["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come ordered by cell and parts; a repeated row lies beside its first copy
        place, met = None, {}
        held(None)
        for b in sliced(batches):
            for cell, p, q, node, fp, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if place != (cell, p, q):
                    yield from solved(met)
                    place, met = (cell, p, q), {}
                if node not in met:
                    met[node] = fp, shingle_set((t or "").encode(), shingle)
        yield from solved(met)

    def solved(met: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        if len(met) > 1:
            own = np.array(list(met), np.int64)
            fps = np.frombuffer(b"".join(fp for fp, _ in met.values()), np.uint64).reshape(len(met), -1)
            label = verified([x for _, x in met.values()], fps, radius, similarity)
            x = np.flatnonzero(label != np.arange(len(met)))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(own[x]), pa.array(own[label[x]])], ["a", "b"])

    def dealt_by(rows: DataFrame, parts: Column) -> DataFrame:
        own = rows.withColumn("parts", parts.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return other.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("t"))
    seen = cut(rows.mapInArrow(sketch, "id long, key long, kin binary, fp binary, keys array<long>"))
    # equal sets have equal fingerprints and band keys
    alike = seen.where("id is not null").groupBy("kin").agg(F.min(F.struct("id", "key", "fp", "keys")).alias("f"))
    nodes = cut(alike.select("kin", F.col("f.id").alias("rep"), F.col("f.key").alias("text"), F.col("f.fp").alias("fp"), F.col("f.keys").alias("keys"), F.monotonically_increasing_id().alias("node")))
    dealt = nodes.select("node", F.explode("keys").alias("key"))
    many = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = (
        dealt_by(dealt.join(many, "key").join(nodes.select("node", "fp"), "node"), F.ceil(F.col("n") / F.lit(TILE)))
        .groupBy("key", "p", "q")
        .agg(F.collect_list("fp").alias("fps"), F.collect_list("node").alias("nodes"))
    )
    near = connected(met.select("fps", "nodes").mapInArrow(compare, "a long, b long"))
    cells = cut(near.select("node", F.col("root").alias("cell")).union(near.select("root", "root").distinct()))
    asked = nodes.join(cells, "node").select("rep", "text", "node", "fp", "cell")
    # a text is fetched once, by its id and hash
    fetched = cut(rows.join(asked, (F.col("id") == F.col("rep")) & (F.col("key") == F.col("text"))).select("cell", "node", "fp", "t"))
    sizes = fetched.groupBy("cell").agg(F.ceil(F.greatest(F.count("*") / F.lit(TILE), F.sum(F.octet_length("t")) / F.lit(HELD))).alias("parts"))
    pairs = dealt_by(joined(fetched, sizes, "cell"), F.greatest(F.col("parts"), F.lit(1)))
    exact = (
        pairs.select("cell", "p", "q", "node", "fp", "t")
        .repartition(partitions(docs.sparkSession), "cell", "p", "q")
        .sortWithinPartitions("cell", "p", "q", "node")
        .mapInArrow(verify, "a long, b long")
    )
    told = named(nodes.select("node", "rep", "kin"), exact).select("kin", "class", "component")
    return labelled(seen.select("id", "key", "kin"), told, "kin").select("id", "key", "class", "component")


def keep_one_near(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies, of the least id, and of these of the least hash of the text; rows without an id stay."""
    return one_of_each(docs, near_groups(docs, shingle, similarity))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


QUERIES = {"op1_simhash": op1_simhash}
ORACLE_SQL: dict[str, str] = {}
