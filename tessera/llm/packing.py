"""Packing by bounded-space online best fit.

Each partition keeps ``OPEN`` windows. A document's tokens go whole where they fit with the least
room left, of windows with equal room into the one that was changed longest ago. When they fit nowhere, the fullest window is filled to its end with the document's first
tokens and emitted, and the rest is placed again, so an emitted window has no padding. At a
partition's end its open windows are poured together, which leaves at most one partial window; the
partial windows of ``MERGE`` partitions are poured together in turn. What is padded is at most one
window for every ``MERGE`` partitions, however the documents lie. State is a fixed number of windows.

Nulls and edge cases: a null or empty text is a document of the end token alone; documents of any
length are cut; equal rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, held, table
from tessera.llm.tokens import by_bytes, encoder

#: Windows open in a partition, and partitions whose last windows are merged by one task.
OPEN, MERGE = 32, 256
#: Words that a worker remembers, those of them that are not merged yet, and what is cut off words' ends.
REMEMBERED, RECENT, TAIL = 3_000_000, 60_000, b".,!?;:#$%&*"
#: Bytes of texts whose words are looked up together, and words of letters that are encoded in one call.
TEXT_BYTES, TOGETHER = 1 << 21, 1 << 14
SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
FIELDS = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
Piece = tuple  # (id, start, tokens of the document, its ids as bytes)


class Packer:
    """Open windows of ``size`` tokens; emitted windows are lists of pieces."""

    def __init__(self, size: int, windows: int = OPEN):
        self.size, self.limit = size, windows
        self.windows: list[tuple[list[Piece], int]] = []

    def add(self, doc, start: int, total: int, ids: bytes) -> Iterator[list[Piece]]:
        while ids:
            n = len(ids) // 4
            best = max((i for i, (_, used) in enumerate(self.windows) if used + n <= self.size), key=lambda i: self.windows[i][1], default=-1)
            if best >= 0:
                pieces, used = self.windows.pop(best)
                pieces.append((doc, start, total, ids))
                if used + n == self.size:
                    yield pieces
                else:
                    self.windows.append((pieces, used + n))
                return
            if n < self.size and len(self.windows) < self.limit:
                self.windows.append(([(doc, start, total, ids)], n))
                return
            if n >= self.size:
                pieces, used = [], 0
            else:
                pieces, used = self.windows.pop(max(range(len(self.windows)), key=lambda i: self.windows[i][1]))
            room = self.size - used
            yield [*pieces, (doc, start, total, ids[: 4 * room])]
            start, ids = start + room, ids[4 * room :]

    def pour(self) -> Iterator[list[Piece]]:
        """Close all windows: full ones are yielded, the one that is left stays."""
        old, self.windows, self.limit = self.windows, [], 1
        for pieces, _ in sorted(old, key=lambda w: -w[1]):
            for p in pieces:
                yield from self.add(*p)


def rows(pieces: list[Piece], sequence: int, keep_ids: bool) -> Iterator[tuple]:
    at = 0
    for doc, start, total, ids in pieces:
        n = len(ids) // 4
        yield doc, start, n, zlib.crc32(ids), total, sequence, at, ids if keep_ids else None
        at += n


def batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], FIELDS)


class Words:
    """Token ids of words as little-endian 32-bit integers; words once seen are remembered.

    The tokenizer drops white space, ignores ASCII case and starts anew between a letter or digit
    and a mark of punctuation, so words are cut there. Only special strings depend on case: a word that
    holds one in any case is kept as it stands. A word of letters alone has at least one last token,
    marked by its ``</w>``; many of them are encoded in one call, and if there are as many last tokens as
    words, each word has just one and is told apart by it.

    What is remembered is kept in arrays, sorted by the words' 64-bit hashes and told apart by their lengths as well, some 25
    bytes a word; the last ``RECENT`` words are in a dictionary until they are merged.
    """

    def __init__(self, path: str):
        self.tokenizer = encoder(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.recent: dict[bytes, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.names, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self.begin, self.end, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), b""

    def merge(self) -> None:
        if len(self.names) > REMEMBERED:
            self.forget()
        words, ids = list(self.recent), list(self.recent.values())
        end = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) + len(self.pool)
        names = np.concatenate([self.names, np.fromiter(map(hash, words), np.int64, len(words))])
        order = np.argsort(names, kind="stable")
        self.names = names[order]
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, words), np.int64, len(words)).astype(np.uint8)])[order]
        self.begin = np.concatenate([self.begin, np.append(len(self.pool), end[:-1])])[order]
        self.end = np.concatenate([self.end, end])[order]
        self.pool += b"".join(ids)
        self.recent = {}

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of words that are remembered, None for others."""
        found = list(map(self.recent.get, words))
        if len(self.names):
            rest = [i for i, ids in enumerate(found) if ids is None]
            own = [words[i] for i in rest]
            names = np.fromiter(map(hash, own), np.int64, len(own))
            order = np.argsort(names)  # neighbours are looked up side by side
            names = names[order]
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            met = np.flatnonzero((self.names[at] == names) & (self.sizes[at] == np.fromiter(map(len, own), np.int64, len(own)).astype(np.uint8)[order]))
            pool, at = self.pool, at[met]
            for i, s, e in zip(np.array(rest)[order[met]].tolist(), self.begin[at].tolist(), self.end[at].tolist(), strict=True):
                found[i] = pool[s:e]
        return found

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words that are not remembered."""
        units: dict[bytes, str] = {}
        cut = []
        for w in words:
            if w[-1] in TAIL and (core := w.rstrip(TAIL)):
                text = core.decode()
                if text[-1].lower()[-1].isalpha() or core[-1:].isdigit():
                    tail = w[len(core) :]
                    cut.append((w, core, tail))
                    units[core], units[tail] = text, tail.decode()
                    continue
            units[w] = w.decode()
        known = {}
        if parts := list({part for c in cut for part in c[1:]}):
            known = {w: ids for w, ids in zip(parts, self.find(parts), strict=True) if ids is not None}
        new = [(w, t) for w, t in units.items() if w not in known]
        letters, others = [x for x in new if x[1].isalpha()], [x for x in new if not x[1].isalpha()]
        fresh: dict[bytes, bytes] = {}
        for i in range(0, len(letters), TOGETHER):
            self.together(letters[i : i + TOGETHER], fresh)
        self.apart(others, fresh)
        known.update(fresh)
        fresh.update([(w, known[core] + known[tail]) for w, core, tail in cut])
        self.recent.update(fresh)
        return fresh

    def together(self, units: list[tuple[bytes, str]], fresh: dict[bytes, bytes]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join([t for _, t in units])], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) != len(units):
            half = len(units) // 2
            if half < 8:
                return self.apart(units, fresh)
            self.together(units[:half], fresh)
            return self.together(units[half:], fresh)
        raw = ids.tobytes()
        fresh.update([(u[0], raw[s:e]) for u, s, e in zip(units, [0, *ends], ends, strict=False)])

    def apart(self, units: list[tuple[bytes, str]], fresh: dict[bytes, bytes]) -> None:
        at = 0
        for run in by_bytes([t for _, t in units]):
            for (w, _), e in zip(units[at : at + len(run)], self.tokenizer.encode_batch_fast(run, add_special_tokens=False), strict=True):
                fresh[w] = np.array(e.ids, "<u4").tobytes()
            at += len(run)

    def cased(self, raw: str) -> str:
        """A text in lower case but for words that hold a special string."""
        low = raw.encode().lower()
        return b" ".join([r if any(s in w for s in self.special) else w for r, w in zip(raw.encode().split(), low.split(), strict=True)]).decode()

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts side by side, and where each begins and the last ends."""
        low = pc.ascii_lower(texts)
        held = np.zeros(len(texts), bool)
        for s in self.special:
            held |= pc.match_substring(low, s.decode()).to_numpy(zero_copy_only=False)
        if held.any():
            low = pa.array([self.cased(texts[i].as_py()) if h else low[i].as_py() for i, h in enumerate(held.tolist())], pa.string())
        split = pc.ascii_split_whitespace(low)
        kinds = pc.dictionary_encode(split.flatten())
        words = kinds.dictionary.cast(pa.binary()).to_pylist()
        found = self.find(words)
        if missing := [w for w, ids in zip(words, found, strict=True) if ids is None and w]:
            new = self.learn(missing)
            found = [new.get(w) if ids is None else ids for w, ids in zip(words, found, strict=True)]
            if len(self.recent) > RECENT:
                self.merge()
        found = [ids or b"" for ids in found]  # white space at an end makes an empty word
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = kinds.indices.to_numpy()
        each = n[at]
        end = np.cumsum(each)
        ids = np.frombuffer(b"".join(found), "<u4")
        ids = ids[np.repeat((np.cumsum(n) - n)[at] - (end - each), each) + np.arange(end[-1] if len(end) else 0)]
        bounds = split.offsets.to_numpy()
        return ids, np.concatenate([[0], end])[bounds - bounds[0]]

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, bounds = self.encoded(pa.array(texts, pa.string()))
        return [ids[s:e].tobytes() for s, e in itertools.pairwise(bounds.tolist())]


def pack(docs: DataFrame, path: str, end_id: int, size: int = 4096, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the document's id, where the piece starts in it, its ids and its place in a sequence."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the remembered words make no cycles, and looking for some among them again and again is slow
        gc.disable()
        try:
            yield from packed(batches)
        finally:
            gc.enable()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = held(f"words of {path}", lambda: Words(path)), Packer(size)
        base, out = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            found = []
            texts = pc.fill_null(b.column(1), "")
            upto = np.cumsum(pc.binary_length(texts).to_numpy())
            cuts = np.flatnonzero(np.diff(upto // TEXT_BYTES, prepend=0))
            for s, e in itertools.pairwise([0, *cuts[cuts > 0].tolist(), b.num_rows]):
                ids, bounds = words.encoded(texts[s:e])
                raw = ids.tobytes()
                for doc, (i, j) in zip(b.column(0)[s:e].to_pylist(), itertools.pairwise((4 * bounds).tolist()), strict=True):
                    for window in packer.add(doc, 0, (j - i) // 4 + 1, raw[i:j] + end):
                        found += rows(window, base + out, with_ids)
                        out += 1
            if found:
                yield batch(found)
        found = []
        for window in packer.pour():
            found += rows(window, base + out, with_ids)
            out += 1
        for pieces, _ in packer.windows:
            found += rows(pieces, -1 - (base >> 32), True)
        if found:
            yield batch(found)

    def merge(key, part):
        packer, out, found = Packer(size, 1), 0, []
        base = (key[0].as_py() + (1 << 29)) << 32
        left = sorted(part.to_pylist(), key=lambda r: (-r["sequence_id"], r["offset"]))
        for r in left:
            for window in packer.add(r["id"], r["start"], r["doc_tokens"], r["ids"]):
                found += rows(window, base + out, with_ids)
                out += 1
        for pieces, _ in packer.windows:
            found += rows(pieces, base + out, with_ids)
        return pa.Table.from_batches([batch(found)])

    made = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, SCHEMA))
    full, left = made.where("sequence_id >= 0"), made.where("sequence_id < 0")
    return full.union(left.groupBy(F.floor((-1 - F.col("sequence_id")) / MERGE)).applyInArrow(merge, SCHEMA))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(table(spark, sf_dir, "documents"), path, 2, with_ids=False).select(
        F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


QUERIES = {"op3_packing": op3_packing}
ORACLE_SQL: dict[str, str] = {}
