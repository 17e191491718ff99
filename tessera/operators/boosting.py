"""Gradient-boosted trees over histograms, grown leaf by leaf.

The trees are fitted where the rows are: equal rows of bins become one row with its counts, these are dealt to as many tasks as can
run at once (one barrier stage), and each task keeps its own in files of its local folder. For a split the first task says which
leaf is cut where, every task counts the smaller of the new leaves, and the first adds the histograms up. No row goes to the
driver, and all rows are counted. Every feature is cut into at most ``BINS`` bins at exact quantiles; a tree splits the leaf with
the largest gain until it has its leaves.
"""

from __future__ import annotations

import os
import pickle
import secrets
import socket
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.connection import Client, Connection, Listener

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.stage import staged

#: Bins of a feature; rows and weight that a leaf needs.
BINS, LEAF_ROWS, LEAF_HESSIAN = 255, 20, 1e-3
#: Values that features packed into one column may take together; rows that are counted at once.
PACKED, CHUNK = 1024, 1 << 16
#: Different rows of bins that are worth a task of their own.
TASK_ROWS = 20_000


@dataclass
class Tree:
    """Nodes as arrays: rows with ``x[feature] <= bound`` go left; a leaf has feature -1 and a value."""

    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int32), np.arange(len(x))
        while len(rows):
            own = at[rows]
            rows = rows[self.feature[own] >= 0]
            own = at[rows]
            at[rows] = np.where(x[rows, self.feature[own]] <= self.bound[own], self.left[own], self.right[own])
        return self.value[at]

    def masks(self, bounds: list[np.ndarray]) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """For each feature and bin the leaves (bits, from the left) that it leaves open, and the leaves' values; at most 64 leaves."""
        values: list[float] = []
        open_ = {int(f): np.full(len(bounds[f]) + 1, -1, np.int64).view(np.uint64) for f in np.unique(self.feature[self.feature >= 0])}

        def walk(node: int) -> None:
            f = int(self.feature[node])
            if f < 0:
                values.append(self.value[node])
                return
            first = len(values)
            walk(self.left[node])
            gone = np.uint64(((1 << len(values)) - (1 << first)) ^ (2**64 - 1))
            open_[f][np.searchsorted(bounds[f], self.bound[node]) + 1 :] &= gone
            walk(self.right[node])

        walk(0)
        return list(open_.items()), np.array(values)


@dataclass
class Trees:
    features: list[str]
    base: float
    trees: list[Tree]

    def prepared(self) -> tuple[list[np.ndarray], list[tuple[list[tuple[int, np.ndarray]], np.ndarray]]]:
        """The bounds that the trees use, and each tree's masks over their bins."""
        bounds = [np.unique(np.concatenate([[], *(t.bound[t.feature == f] for t in self.trees)])) for f in range(len(self.features))]
        return bounds, [t.masks(bounds) for t in self.trees]

    def probability(self, x: np.ndarray, prepared: tuple | None = None) -> np.ndarray:
        """A row's leaf is the first one that none of its bins closes, so a tree takes one look a feature and not one a level."""
        bounds, trees = prepared or self.prepared()
        bins = [np.searchsorted(b, x[:, f], "left") for f, b in enumerate(bounds)]
        z = np.full(len(x), self.base)
        for masks, values in trees:
            left = np.full(len(x), -1, np.int64).view(np.uint64)
            for f, mask in masks:
                left &= mask[bins[f]]
            lowest = (left & (~left + np.uint64(1))).astype(np.float64)  # a power of two
            z += values[(lowest.view(np.int64) >> 52) - 1023]
        return 1 / (1 + np.exp(-z))

    def predict(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with ``prob``."""

        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            prepared = self.prepared()
            for columns in batches:
                yield pd.Series(self.probability(np.column_stack([c.to_numpy(np.float64) for c in columns]), prepared))

        return pairs.withColumn("prob", run(*(F.col(c).cast("double") for c in self.features)))


def ranks(n: int) -> np.ndarray:
    """Places, from 0, of the ``BINS`` quantiles of ``n`` sorted rows."""
    return (2 * (n - 1) * np.arange(BINS) + BINS - 1) // (2 * (BINS - 1))


def halfway(values: np.ndarray) -> np.ndarray:
    return (values[1:] + values[:-1]) / 2


def bounds_of(column: np.ndarray) -> np.ndarray:
    """Upper bounds of bins, halfway between neighbouring values, or quantiles where there are more than ``BINS``."""
    values = np.unique(column)
    return halfway(values if len(values) <= BINS else np.unique(np.sort(column)[ranks(len(column))]))


def cuts_of(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    """``bounds_of`` each feature over all rows: different values are counted, sorted into ranges, and numbered from where a range begins."""
    each = rows.select(F.inline(F.array(*(F.struct(F.lit(j).alias("j"), F.col(c).cast("double").alias("v")) for j, c in enumerate(features)))))
    counts = each.where("v is not null and not isnan(v)").groupBy("j", "v").agg(F.count("*").alias("n"))
    ranged = staged(counts.repartitionByRange("j", "v").withColumn("part", F.spark_partition_id()))
    # a row for each range and feature
    sizes = sorted((r["j"], r["part"], r["n"], r["d"]) for r in ranged.groupBy("j", "part").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect())
    total, different, starts = [0] * len(features), [0] * len(features), []
    for j, part, n, d in sizes:
        starts.append((j, part, total[j]))
        total[j] += n
        different[j] += d
    if not starts:
        return [np.empty(0) for _ in features]
    starts = [(*s, total[s[0]], different[s[0]]) for s in starts]
    begin = F.broadcast(rows.sparkSession.createDataFrame(starts, "j int, part int, begin long, total long, different long"))
    upto = F.sum("n").over(Window.partitionBy("j", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("begin")
    # ``ranks`` that lie below a place
    below = lambda place: F.expr(f"least({BINS}, greatest(0, ({2 * (BINS - 1)} * {place} - {BINS - 1} + 2 * greatest(1, total - 1) - 1) div (2 * greatest(1, total - 1))))")
    # at most BINS values a feature
    picked = ranged.join(begin, ["j", "part"]).withColumn("upto", upto).where((F.col("different") <= BINS) | (below("upto") > below("(upto - n)"))).select("j", "v").collect()
    return [halfway(np.array(sorted(r["v"] for r in picked if r["j"] == j))) for j in range(len(features))]


def packs_of(widths: list[int]) -> list[list[int]]:
    """Features that share a column, narrow ones together; such with a single bin are in none."""
    packs: list[list[int]] = []
    for f in sorted((f for f, w in enumerate(widths) if w > 1), key=lambda f: (widths[f], f)):
        if packs and np.prod([widths[g] for g in packs[-1]]) * widths[f] <= PACKED:
            packs[-1].append(f)
        else:
            packs.append([f])
    return packs


class Part:
    """The rows of one task: packed bins by column, how many of either label a row stands for, their scores, and the leaves they are in.

    Whatever has a value a row is in files, so that memory is bounded by a few bytes a row.
    """

    def __init__(self, widths: list[int], weights: tuple[float, float], base: float, folder: str | None = None):
        self.packs = packs_of(widths)
        self.radices = [[widths[f] for f in p] for p in self.packs]
        self.sizes = [int(np.prod(r)) for r in self.radices]
        self.weights, self.base, self.folder, self.n = weights, base, folder, 0
        self.files = [tempfile.TemporaryFile(dir=folder) for _ in range(len(self.packs) + 2)]

    def add(self, bins: np.ndarray, no: np.ndarray, yes: np.ndarray) -> None:
        """Rows of bins, with the weighted number of rows of either label."""
        for file, pack, radix in zip(self.files, self.packs, self.radices, strict=False):
            file.write(np.ravel_multi_index([bins[:, f] for f in pack], radix).astype(np.uint16).tobytes())
        for file, counts in zip(self.files[-2:], (no, yes), strict=True):
            file.write(counts.astype(np.float64).tobytes())
        self.n += len(bins)

    def room(self, dtype: type, fill: float | None = None) -> np.ndarray:
        out = np.memmap(tempfile.TemporaryFile(dir=self.folder), dtype, "w+", shape=self.n) if self.n else np.empty(0, dtype)
        if fill is not None:
            out[:] = fill
        return out

    def ready(self) -> Part:
        def held(file, dtype: type) -> np.ndarray:
            file.flush()
            return np.memmap(file, dtype, "r", shape=self.n) if self.n else np.empty(0, dtype)

        self.columns = [held(f, np.uint16) for f in self.files[:-2]]
        self.no, self.yes = (held(f, np.float64) for f in self.files[-2:])
        self.z, self.grad, self.hess = self.room(np.float64, self.base), self.room(np.float64), self.room(np.float64)
        return self

    def counted(self, rows: np.ndarray | None) -> np.ndarray:
        """Sums of gradients, of hessians, and numbers of rows, by packed bin."""
        out = [np.zeros((3, size)) for size in self.sizes]
        for at in range(0, self.n if rows is None else len(rows), CHUNK):
            own = slice(at, at + CHUNK) if rows is None else rows[at : at + CHUNK]
            grad, hess, n = self.grad[own], self.hess[own], self.no[own] + self.yes[own]
            for column, size, sums in zip(self.columns, self.sizes, out, strict=True):
                bins = column[own].astype(np.intp)
                for k, weight in enumerate((grad, hess, n)):
                    sums[k] += np.bincount(bins, weight, size)
        return np.concatenate(out, axis=1) if out else np.zeros((3, 0))

    def begin(self) -> np.ndarray:
        """A new tree: its gradients, and its first leaf."""
        for at in range(0, self.n, CHUNK):
            s = slice(at, at + CHUNK)
            prob = 1 / (1 + np.exp(-self.z[s]))
            no, yes = self.no[s] * self.weights[0], self.yes[s] * self.weights[1]
            self.grad[s] = no * prob - yes * (1 - prob)
            self.hess[s] = (no + yes) * prob * (1 - prob)
        self.own = {0: None}
        return self.counted(None)

    def split(self, node: int, f: int, at: int, new: int, small: int) -> np.ndarray:
        """Cuts a leaf into ``new`` and ``new + 1``, and counts the one that is told to be smaller."""
        k = next(k for k, p in enumerate(self.packs) if f in p)
        place = self.packs[k].index(f)
        low = np.arange(self.sizes[k]) // int(np.prod(self.radices[k][place + 1 :])) % self.radices[k][place] <= at
        rows = self.own.pop(node)
        rows = np.arange(self.n) if rows is None else rows
        left = low[self.columns[k][rows]]
        self.own[new], self.own[new + 1] = rows[left], rows[~left]
        return self.counted(self.own[new + small])

    def end(self, values: dict[int, float]) -> None:
        """Adds a tree's values to the scores."""
        for node, rows in self.own.items():
            self.z[slice(None) if rows is None else rows] += values[node]

    def unpacked(self, sums: np.ndarray, features: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Histograms, features by bins, of what ``counted`` gives."""
        out, at = np.zeros((3, features, width)), 0
        for pack, radix, size in zip(self.packs, self.radices, self.sizes, strict=True):
            cube = sums[:, at : at + size].reshape(3, *radix)
            for k, f in enumerate(pack):
                out[:, f, : radix[k]] = cube.sum(axis=tuple(i + 1 for i in range(len(radix)) if i != k))
            at += size
        return out[0], out[1], out[2]


def best_split(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split of a leaf from its histograms (features by bins); the first of equal ones."""
    gl, hl, nl = (np.cumsum(a, axis=1)[:, :-1] for a in (grad, hess, rows))
    g, h, n = grad.sum(axis=1, keepdims=True), hess.sum(axis=1, keepdims=True), rows.sum(axis=1, keepdims=True)
    fit = (nl >= LEAF_ROWS) & (n - nl >= LEAF_ROWS) & (hl >= LEAF_HESSIAN) & (h - hl >= LEAF_HESSIAN)
    if not fit.any():
        return 0.0, -1, -1
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fit, gl**2 / hl + (g - gl) ** 2 / (h - hl) - g**2 / h, -np.inf)
    most = gain.max()
    k = int(np.argmax(gain >= most - 1e-9 * abs(most)))  # sums of another order differ in their last digits
    return float(most), k // gain.shape[1], k % gain.shape[1]


def prompt(other: Connection) -> Connection:
    """Small messages are sent at once; else each waits for the acknowledgement of the one before, some 40 ms."""
    with socket.socket(fileno=os.dup(other.fileno())) as s:
        s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
    return other


def asked(part: Part, others: list[Connection], what: str, *args) -> np.ndarray | None:
    """The sum of what every task's part answers."""
    for other in others:
        other.send((what, args))
    out = getattr(part, what)(*args)
    if out is not None:
        for other in others:
            out += np.frombuffer(other.recv_bytes()).reshape(out.shape)
    return out


def answered(part: Part, first: Connection) -> None:
    """Does what the first task asks for, until it asks for nothing."""
    while (order := first.recv()) is not None:
        out = getattr(part, order[0])(*order[1])
        if out is not None:
            first.send_bytes(out.tobytes())


def grow(part: Part, cuts: list[np.ndarray], leaves: int, step: float, others: list[Connection]) -> Tree:
    """A tree, whose values are added to the scores."""
    shape = len(cuts), max(map(len, cuts)) + 1
    feature, bound, left, right, value = [-1], [0.0], [0], [0], [0.0]
    held = {0: part.unpacked(asked(part, others, "begin"), *shape)}
    found = {0: best_split(*held[0])}
    while len(held) < leaves:
        node = max(found, key=lambda k: (found[k][0], -k))
        gain, f, at = found[node]
        if gain <= 1e-12 or f < 0:
            break
        grad, hess, rows = held.pop(node)
        del found[node]
        new, small = len(feature), int(2 * rows[f, : at + 1].sum() > rows[f].sum())
        counted = part.unpacked(asked(part, others, "split", node, f, at, new, small), *shape)
        rest = grad - counted[0], hess - counted[1], rows - counted[2]
        feature[node], bound[node], left[node], right[node] = f, cuts[f][at], new, new + 1
        for side in (0, 1):
            for column, v in zip((feature, bound, left, right, value), (-1, 0.0, 0, 0, 0.0), strict=True):
                column.append(v)
            held[new + side] = counted if side == small else rest
            found[new + side] = best_split(*held[new + side])
    f = int(np.argmax([len(c) for c in cuts]))  # its bins hold every row
    for k, (grad, hess, _) in held.items():
        value[k] = -step * grad[f].sum() / max(hess[f].sum(), 1e-12)
    asked(part, others, "end", {k: value[k] for k in held})
    return Tree(np.array(feature), np.array(bound), np.array(left), np.array(right), np.array(value))


def grown_all(part: Part, cuts: list[np.ndarray], rounds: int, step: float, leaves: int, others: list[Connection] | None = None) -> list[Tree]:
    trees: list[Tree] = []
    while part.packs and len(trees) < rounds:
        tree = grow(part, cuts, leaves, step, others or [])
        if len(tree.feature) == 1:
            break
        trees.append(tree)
    for other in others or []:
        other.send(None)
    return trees


def log_odds(no: float, yes: float) -> float:
    p = np.clip(yes / (no + yes), 1e-9, 1 - 1e-9)
    return float(np.log(p / (1 - p)))


def slots(spark: SparkSession) -> int:
    """Tasks that the session can run at once; a barrier stage can have no more."""
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))


def fitted(rows: DataFrame, features: list[str], weights: tuple[float, float], base: float, rounds: int = 300, step: float = 0.05, leaves: int = 31) -> Trees:
    """Trees for the log loss of all ``rows (label, features)``, of which each has the weight of its label (0, 1)."""
    cuts = cuts_of(rows, features)
    widths = [len(c) + 1 for c in cuts]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [b.column(j + 1).to_numpy(zero_copy_only=False) for j in range(len(cuts))]
            bins = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x, strict=True)]).astype(np.uint8)
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(cuts)), len(bins), [None, pa.py_buffer(bins.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([keys, b.column(0)], ["bins", "yes"])

    codes = rows.select(F.col("label").cast("long"), *(F.col(c).cast("double") for c in features)).mapInArrow(coded, "bins binary, yes long")
    equal = staged(codes.groupBy("bins").agg(F.sum("yes").alias("yes"), F.count("*").alias("n")))
    tasks = min(slots(rows.sparkSession), 1 + equal.count() // TASK_ROWS)
    key = secrets.token_bytes(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        part = Part(widths, weights, base, os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        for b in batches:
            bins = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, len(cuts))
            yes, n = (b.column(k).to_numpy() for k in (1, 2))
            part.add(bins, n - yes, yes)
        part.ready()
        own = context.getTaskInfos()[context.partitionId()].address.rsplit(":", 1)[0]
        if context.partitionId():
            host, port = context.allGather("")[0].rsplit(" ", 1)
            with Client((host, int(port)), authkey=key) as first:
                first.send(context.partitionId())
                answered(part, prompt(first))
            return
        with Listener((own, 0), backlog=tasks, authkey=key) as door:
            context.allGather(f"{own} {door.address[1]}")
            met = [prompt(door.accept()) for _ in range(tasks - 1)]
        places = [c.recv() for c in met]
        others = [met[k] for k in np.argsort(places)]  # sums have one order
        trees = grown_all(part, cuts, rounds, step, leaves, others)
        yield pa.RecordBatch.from_pydict({"trees": [pickle.dumps(trees)]})

    dealt = equal.repartition(tasks, "bins").sortWithinPartitions("bins")
    # one row, of at most ``rounds`` trees
    return Trees(features, base, pickle.loads(dealt.mapInArrow(run, "trees binary", barrier=True).collect()[0]["trees"]))


def grown(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, leaves: int, step: float) -> tuple[Tree, np.ndarray]:
    """A tree for given gradients, and its value for each row."""
    part = Part([len(c) + 1 for c in cuts], (1.0, 1.0), 0.0)
    part.add(binned, np.ones(len(binned)), np.zeros(len(binned)))
    part.ready()

    def begin() -> np.ndarray:
        part.grad[:], part.hess[:], part.own = grad, hess, {0: None}
        return part.counted(None)

    part.begin = begin
    return grow(part, cuts, leaves, step, []), np.array(part.z)


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, features: list[str], rounds: int = 300, step: float = 0.05, leaves: int = 31) -> Trees:
    """``fitted`` for arrays in memory; rows of a label have one weight."""
    cuts = [bounds_of(x[:, j]) for j in range(x.shape[1])]
    no, yes = (weight[y == k] for k in (0, 1))
    base = log_odds(no.sum(), yes.sum())
    part = Part([len(c) + 1 for c in cuts], tuple(float(w[0]) if len(w) else 0.0 for w in (no, yes)), base)
    part.add(np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]), 1 - y, y)
    return Trees(features, base, grown_all(part.ready(), cuts, rounds, step, leaves))
