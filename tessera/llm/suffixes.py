"""Removal of repeated substrings with suffix arrays.

A byte goes if it lies in a string of ``size`` bytes that starts at two places of the corpus or more.

*Blocks.* Rows are gathered, whole and with all their columns, into blocks of about ``BLOCK`` bytes of text, which
are compressed and written once to the shared folder. A block is what later steps deal and fetch.
*Anchors.* In every window of ``size`` bytes the ``K``-byte string with the least hash (the
rightmost of equals) is its anchor. Equal windows have equal anchors at equal offsets, so a window
can repeat only if its anchor's hash stands twice; a block names each of its anchors once, so a hot one costs a short row
a block. The region of an anchor holds the windows that it anchors; each window is in one.
If all regions of an anchor are equal, there is nothing to tell apart: all their windows repeat, and nothing else has them.
*Suffix arrays.* The regions of all other anchors that stand twice are dealt by anchor to shards of about ``SHARD`` bytes.
Equal regions collapse to one that counts its copies; a block sends each but once. A shard's suffixes are sorted by Larsson-Sadakane
refinement: ranks of prefixes double in length, and only suffixes still in a group are sorted again. Kasai's
method, run over all regions in step, gives the common prefix of neighbours; a window repeats if
that is ``size`` bytes or its region stands for several copies. *Merging.* An anchor with
more than ``PART`` regions is dealt over several shards, by the regions' hash. Such a shard gives the digests of the anchor's
windows as sorted runs, cut at fixed bounds by binary search; a task for each cut range sorts the runs into
one and looks every run up in it by binary search. So no anchor, however hot, gathers in one task, no pairs of
copies are formed, and everything grows in proportion to the corpus.

Nulls and edge cases: a null text is empty; texts shorter than ``size`` bytes lose nothing by
themselves; matches never cross texts and may overlap in one; null or repeated ids and repeated
rows are rows like any other, each judged by its own text; a text longer than a block is a block of its own; empty tables give no rows;
other columns, whatever their names, are carried along. A character that loses some of its bytes keeps the others as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, held, partitions, table

#: Bytes of text in a block, of an anchor, and of a shard of regions; regions of one anchor in a shard; bytes hashed at once.
BLOCK, K, SHARD, PART, CHUNK = 2 << 20, 32, 1 << 20, 1024, 1 << 19
#: Regions that a task remembers to have sent.
SENT = 200_000
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 21) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_UP, _DOWN = _powers(_MUL, CHUNK + 1024), _powers(pow(_MUL, -1, 1 << 64), CHUNK + 1024)


def anchors(raw: np.ndarray, ends: np.ndarray, size: int, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of ``size`` bytes in the texts that lie side by side in ``raw`` up to ``ends``.

    Gives for each region, in order, the anchor's hash, the starts of the first and of the last window, and a hash
    of the region's bytes.
    """
    edge = np.zeros(len(raw) + 1, np.int32)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    long = ends - starts >= size
    edge[starts[long]] += 1
    np.subtract.at(edge, ends[long] - size + 1, 1)
    valid = np.cumsum(edge[:-1]).astype(bool)
    found: list[list[np.ndarray]] = []
    w = size - k + 1
    for at in range(0, len(raw) - size + 1, CHUNK - size + 1):
        part = raw[at : at + CHUNK]
        n = len(part) - size + 1
        own = np.flatnonzero(valid[at : at + n])
        if not len(own):
            continue
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _UP[: len(part)], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * _DOWN[: len(part) - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        ranked = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        blocks = -(-len(h) // w)
        grid = np.full(blocks * w, ~np.uint64(0))
        grid[: len(h)] = ranked
        grid = grid.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])[own]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (own[1:] != own[:-1] + 1)])
        first = own[new]
        last = own[np.append(np.flatnonzero(new)[1:] - 1, len(own) - 1)]
        place = (_LOW - (least[new] & _LOW)).astype(np.int64)
        if found and found[-1][2][-1] + 1 == at + first[0] and found[-1][1][-1] == at + place[0]:  # a region cut by the chunk
            found[-1][2][-1] = at + last[0]
            first, last, place = first[1:], last[1:], place[1:]
        if len(first):
            found.append([h[place], place + at, last + at, first + at])
    if not found:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2, np.zeros(0, np.uint64))
    h, _, high, low = (np.concatenate(c) for c in zip(*found, strict=True))
    return h, low, high, region_hashes(raw, low, high + size)


def region_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches ``raw[begin:end]``, of at least eight bytes each."""
    out = np.empty(len(begin), np.uint64)
    longest = int((end - begin).max(initial=0))
    for at in range(0, len(raw), CHUNK - longest):
        own = slice(*np.searchsorted(begin, [at, at + CHUNK - longest]))
        part = raw[at : at + CHUNK].astype(np.uint64)
        x = np.zeros(max(len(part) - 7, 0), np.uint64)
        for j in range(8):
            x |= part[j : j + len(x)] << np.uint64(8 * j)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * _UP[: len(x)], out=sums[1:])
        s, e = begin[own] - at, end[own] - at
        d = (sums[e - 7] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64)
        d ^= d >> np.uint64(32)
        out[own] = d * np.uint64(0xD6E8FEB86659FD93)
    return out


def suffix_ranks(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, and their ranks.

    Ties beyond ``size`` bytes are refined as well: Kasai's method holds only on a fully sorted array.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n]
    order = np.argsort(key)
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.empty(n, np.int64)
    start = np.flatnonzero(new)
    rank[order] = np.repeat(start, np.diff(np.append(start, n)))
    open_ = _grouped(new)
    # eight bytes of a suffix that ends earlier equal those of one that goes on with zeros: both stay open
    h = 8
    while len(open_):
        own = order[open_]
        after = own + h
        follow = np.where(after < n, rank[np.minimum(after, n - 1)], -(after - n) - 1)
        group = rank[own]
        again = np.argsort(group * np.int64(n + 2 * h + 2) + follow + h + 1)
        own, group, follow = own[again], group[again], follow[again]
        order[open_] = own
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        start = np.flatnonzero(new)
        rank[own] = np.repeat(open_[start], np.diff(np.append(start, len(own))))
        open_ = open_[_grouped(new)]
        h *= 2
    return order, rank


def _grouped(new: np.ndarray) -> np.ndarray:
    """Positions in groups of two or more, where ``new`` marks the first of each group."""
    alone = new & np.append(new[1:], True)
    return np.flatnonzero(~alone)


def common_prefixes(raw: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in ``order``, at most ``size``.

    All regions take their steps together: the prefix of the next suffix is at least one shorter.
    """
    n = len(raw)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    stop = np.empty(n, np.int64)
    stop[:] = np.repeat(ends, np.diff(np.append(starts, n)))
    out = np.zeros(n, np.int64)
    at, length = starts.copy(), np.zeros(len(starts), np.int64)
    live = ends > starts
    while live.any():
        at, length, ends = at[live], length[live], ends[live]
        other = before[at]
        room = np.minimum(np.minimum(ends - at, np.where(other >= 0, stop[other] - other, 0)), size)
        length = np.minimum(length, room)
        going = np.flatnonzero(length < room)
        while len(going):
            same = raw[at[going] + length[going]] == raw[other[going] + length[going]]
            going = going[same]
            length[going] += 1
            going = going[length[going] < room[going]]
        out[at] = length
        at = at + 1
        length = np.maximum(length - 1, 0)
        live = at < ends
    return out


def repeated_windows(regions: list[bytes], copies: list[int], size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each region, the starts of its windows that repeat in the shard, and of the first of each kind."""
    lens = np.array([len(r) for r in regions], np.int64)
    starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    raw = np.frombuffer(b"\xff".join(regions) + b"\xff", np.uint8)  # no byte of a text
    order, _ = suffix_ranks(raw, size)
    prefix = common_prefixes(raw, order, starts, starts + lens, size)
    same = prefix[order] >= size
    near = same | np.append(same[1:], False)
    hit, head = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    hit[order[near]] = True
    head[order[~same]] = True
    found, heads = [], []
    for s, n, c in zip(starts, lens, copies, strict=True):
        windows = max(0, n - size + 1)
        found.append(np.arange(windows) if c > 1 else np.flatnonzero(hit[s : s + windows]))
        heads.append(np.flatnonzero(head[s : s + windows]))
    return found, heads


def runs(starts: np.ndarray, size: int, length: int = -1) -> bytes | None:
    """Begin and end of the spans that windows at ``starts`` cover, as little-endian 32-bit pairs; None for all of a region of ``length`` bytes."""
    if not len(starts):
        return b""
    if len(starts) == length - size + 1:
        return None
    gap = np.flatnonzero(np.diff(starts) > size)
    return np.column_stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + size]).astype("<i4").tobytes()


def blocked(rows: DataFrame, text_col: str) -> DataFrame:
    """(block, data): ``rows`` with all their columns as compressed blocks, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        number, own, room = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            at = 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(text_col)), 0).to_pylist()):
                if room + n > BLOCK and (own or i > at):
                    yield sealed(number, [*own, b.slice(at, i - at)])
                    number, own, room, at = number + 1, [], 0, i
                room += n
            own.append(b.slice(at))
        if any(x.num_rows for x in own):
            yield sealed(number, own)

    def sealed(number: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
            out.write_table(pa.Table.from_batches(rows).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "data"])

    return cut(rows.mapInArrow(run, "block long, data binary"))


def opened(data: bytes, text_col: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of a block, the bytes of their texts side by side, and where each ends."""
    rows = pa.ipc.open_stream(data).read_all().combine_chunks()
    texts = pc.fill_null(rows.column(text_col), "").cast(pa.large_string())
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if not len(texts):
        return rows, np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, offsets, raw = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    return rows, raw, at[1:] - at[0]


def found_spans(blocks: DataFrame, size: int, text_col: str) -> DataFrame:
    """(block, data, found): the blocks with what goes of their regions: anchor, region hash and spans."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _, raw, ends = opened(data.as_buffer(), text_col)
                h, _, _, dig = anchors(raw, ends, size)
                order = np.lexsort((dig, h))
                h, dig = h[order].view(np.int64), dig[order].view(np.int64)
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
                last = np.append(first[1:], len(h))[: len(first)] - 1
                columns = [h[first], np.full(len(first), block), (last - first + 1).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(dig[first], mask=dig[first] != dig[last])], ["h", "block", "n", "dig"])

    every = Window.partitionBy("h")
    shared = (
        blocks.select("block", "data")
        .mapInArrow(mark, "h long, block long, n int, dig long")
        .withColumns({"all": F.sum("n").over(every), "one": (F.min("dig").over(every) == F.max("dig").over(every)) & (F.count("dig").over(every) == F.count("*").over(every))})
        .where("all > 1")
        .select("block", F.struct("h", F.when(F.col("one"), 0).otherwise(F.ceil(F.col("all") / PART)).cast("int").alias("parts")).alias("a"))
    )
    asked = blocks.join(shared.groupBy("block").agg(F.collect_list("a").alias("asked")), "block").select("block", "data", "asked")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple] = set()
        for b in batches:
            for i, block in enumerate(b.column(0).to_pylist()):
                _, raw, ends = opened(b.column(1)[i].as_buffer(), text_col)
                wanted = b.column(2)[i].values
                names, parts = (wanted.field(k).to_numpy() for k in ("h", "parts"))
                order = np.argsort(names)
                names, parts = names[order], parts[order]
                h, low, high, dig = anchors(raw, ends, size)
                h, dig = h.view(np.int64), dig.view(np.int64)
                at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                own = np.flatnonzero(names[at] == h)
                own = own[np.lexsort((dig[own], h[own]))]
                new = np.append(True, (h[own][1:] != h[own][:-1]) | (dig[own][1:] != dig[own][:-1]))
                copies = np.diff(np.append(np.flatnonzero(new), len(own))).astype(np.int32)
                own = own[new]
                parts, h, dig = parts[at[own]], h[own], dig[own]
                text, body = raw.tobytes(), []
                for key, p, s, e in zip(zip(h.tolist(), dig.tolist(), strict=True), parts.tolist(), low[own].tolist(), (high[own] + size).tolist(), strict=True):
                    if not p or key in sent:
                        body.append(None)
                    else:
                        body.append(text[s:e])
                        sent.add(key)
                if len(sent) > SENT:
                    sent.clear()
                columns = [h, (dig % np.maximum(parts, 1)).astype(np.int32), dig, parts, np.full(len(own), block), copies]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(body, pa.binary())], ["h", "part", "dig", "parts", "block", "n", "body"])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        own: list[list] = []  # h, part, dig, parts, blocks, copies, body
        room = 0
        for b in batches:
            whole = pc.equal(b.column(3), 0)
            if (alone := b.filter(whole)).num_rows:
                empty = [pa.nulls(alone.num_rows, k) for k in (pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([alone.column(0), alone.column(2), alone.column(4), empty[0], pa.array(np.full(alone.num_rows, -1, np.int32)), empty[1]], ["h", "dig", "block", "spans", "cut", "run"])
            for h, part, dig, parts, block, n, body in zip(*(c.to_pylist() for c in b.filter(pc.invert(whole)).columns), strict=True):
                if own and own[-1][0] == h and own[-1][2] == dig:
                    last = own[-1]
                    last[4].append(block)
                    last[5] += n
                    if last[6] is None and body is not None:
                        last[6] = body
                        room += len(body)
                    continue
                if room > SHARD and (own[-1][0] != h or own[-1][1] != part):
                    yield from solved(own)
                    own, room = [], 0
                own.append([h, part, dig, parts, [block], n, body])
                room += len(body or b"")
        if own:
            yield from solved(own)

    def solved(rows: list[list]) -> Iterator[pa.RecordBatch]:
        found, heads = repeated_windows([r[6] for r in rows], [r[5] for r in rows], size)
        out = [(r[0], r[2], block, own, -1, None) for r, f in zip(rows, found, strict=True) if len(f) or r[3] > 1 for own in [runs(f, size, len(r[6]))] for block in r[4]]
        hot: dict[tuple, list] = {}
        for r, f, first in zip(rows, found, heads, strict=True):
            if r[3] > 1:
                for s in sorted({*first.tolist(), *f.tolist()}):
                    hot.setdefault((r[0], r[1], r[3]), []).append((xxhash.xxh3_128_digest(r[6][s : s + size]), r[2].to_bytes(8, "little", signed=True), s.to_bytes(4, "little")))
        for (h, part, parts), entries in hot.items():
            entries.sort()
            names = np.array([e[0] for e in entries], "V16").view(">u8")[::2]
            bounds = np.searchsorted(names, np.array([(i << 64) // parts for i in range(1, parts)], np.uint64))
            for i, (s, e) in enumerate(zip([0, *bounds.tolist()], [*bounds.tolist(), len(entries)], strict=True)):
                if e > s:
                    out.append((h, part, None, None, i, b"".join(b"".join(x) for x in entries[s:e])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["h", "dig", "block", "spans", "cut", "run"])

    solved_rows = cut(
        asked.mapInArrow(fetch, "h long, part int, dig long, parts int, block long, n int, body binary")
        .repartition(partitions(blocks.sparkSession), "h", "part")
        .sortWithinPartitions("h", "part", "dig")
        .mapInArrow(shard, "h long, dig long, block long, spans binary, cut int, run binary")
    )
    merged = solved_rows.where("cut >= 0").groupBy("h", "cut").applyInArrow(lambda t: merge(t, size), "h long, dig long, spans binary")
    spans = solved_rows.where("cut < 0 and (spans is null or octet_length(spans) > 0)").select("block", "h", "dig", "spans")
    hot = solved_rows.where("cut < 0 and spans is not null").select("block", "h", "dig").join(merged, ["h", "dig"]).select("block", "h", "dig", "spans")
    found = spans.union(hot).groupBy("block").agg(F.collect_list(F.struct("h", "dig", "spans")).alias("found"))
    return blocks.join(found, "block", "left").select("block", "data", "found")


def merge(part: pa.Table, size: int) -> pa.Table:
    """The windows of sorted runs of one anchor that stand in more than one place of them."""
    h = part.column("h")[0].as_py()
    each = [np.frombuffer(r, np.dtype([("name", "V16"), ("dig", "<i8"), ("at", "<i4")])) for r in part.column("run").to_pylist()]
    keys = [np.ascontiguousarray(e["name"]).view("S16").ravel() for e in each]
    whole = np.sort(np.concatenate(keys))
    out: dict[int, list[int]] = {}
    for e, k in zip(each, keys, strict=True):
        met = np.searchsorted(whole, k, "right") - np.searchsorted(whole, k, "left") > 1
        for d, s in zip(e["dig"][met].tolist(), e["at"][met].tolist(), strict=True):
            out.setdefault(d, []).append(s)
    return pa.table({"h": pa.array([h] * len(out), pa.int64()), "dig": pa.array(list(out), pa.int64()), "spans": pa.array([runs(np.unique(s), size) for s in out.values()], pa.binary())})


def paired(h: np.ndarray, dig: np.ndarray) -> np.ndarray:
    """One 64-bit name for an anchor and a region hash."""
    return h.view(np.uint64) * np.uint64(_MUL) ^ dig.view(np.uint64)


def covered(raw: np.ndarray, ends: np.ndarray, found: pa.ListScalar, size: int) -> np.ndarray:
    """For each byte of a block's texts whether it goes; ``found`` lists (h, dig, spans), null spans standing for a whole region."""
    edge = np.zeros(len(raw) + 1, np.int32)
    if found.is_valid and len(found.values):
        asked = found.values
        names = paired(asked.field("h").to_numpy(), asked.field("dig").to_numpy())
        order = np.argsort(names, kind="stable")
        names, whole = names[order], asked.field("spans").is_null().to_numpy(zero_copy_only=False)[order]
        h, low, high, dig = anchors(raw, ends, size)
        own = paired(h, dig)
        first = np.searchsorted(names, own, "left")
        met = np.flatnonzero((first < len(names)) & (names[np.minimum(first, len(names) - 1)] == own))
        first, last = first[met], np.searchsorted(names, own[met], "right")
        upto = np.concatenate([[0], np.cumsum(whole)])
        all_ = upto[last] > upto[first]
        np.add.at(edge, low[met[all_]], 1)
        np.subtract.at(edge, high[met[all_]] + size, 1)
        spans = asked.field("spans").take(pa.array(order)).to_pylist()
        for i, s, e in zip(met[~all_].tolist(), first[~all_].tolist(), last[~all_].tolist(), strict=True):
            at = int(low[i])
            for k in range(s, e):
                for begin, end in np.frombuffer(spans[k], "<i4").reshape(-1, 2).tolist():
                    edge[at + begin] += 1
                    edge[at + end] -= 1
    return np.cumsum(edge[:-1]) > 0


def pieces(gone: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """For each text where it begins and ends, and its maximal runs of ``gone`` bytes, counted from its begin."""
    edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    at = 0
    for e in ends.tolist():
        s, t = np.searchsorted(end, at, "right"), np.searchsorted(begin, e, "left")
        yield at, e, [(max(b - at, 0), min(x, e) - at) for b, x in zip(begin[s:t].tolist(), end[s:t].tolist(), strict=True)]
        at = e


def deduplicated(docs: DataFrame, size: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept): for every row the removed byte ranges and the bytes that are left."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for i in range(b.num_rows):
                own, raw, ends = opened(b.column("data")[i].as_buffer(), "t")
                gone = covered(raw, ends, b.column("found")[i], size)
                sizes, spans, kept = [], [], []
                for at, end, cuts in pieces(gone, ends):
                    sizes.append(end - at)
                    spans.append([{"begin": s, "end": e} for s, e in cuts])
                    kept.append(raw[at:end][~gone[at:end]].tobytes())
                columns = [own.column("id").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "spans", "kept"])

    return found_spans(blocked(rows, "t"), size, "t").mapInArrow(run, "id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")


def without_repeats(docs: DataFrame, size: int = 200, text_col: str = "text") -> DataFrame:
    """``docs`` with texts that lost their repeated bytes; bytes that no longer form a character go.

    A null text stays null. A long ``n_chars`` is counted anew.
    """
    counted = dict(docs.dtypes).get("n_chars") == "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                own, raw, ends = opened(b.column("data")[i].as_buffer(), text_col)
                gone = covered(raw, ends, b.column("found")[i], size)
                left = [raw[at:end][~gone[at:end]].tobytes().decode(errors="ignore") for at, end, _ in pieces(gone, ends)]
                text = pa.array([t if v else None for t, v in zip(left, own.column(text_col).is_valid().to_pylist(), strict=True)], pa.string())
                changed = {text_col: text} | ({"n_chars": pc.cast(pc.utf8_length(text), pa.int64())} if counted else {})
                yield from pa.table([changed.get(c, own.column(c)) for c in own.column_names], own.column_names).to_batches()

    return found_spans(blocked(docs, text_col), size, text_col).mapInArrow(run, docs.schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
