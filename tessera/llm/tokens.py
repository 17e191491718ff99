"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split at safe boundaries: before white space that follows anything else, and between an ideographic mark and a
letter. The pre-tokenizer looks ahead only for the end of white space and never joins white space to what stands before it, so it begins a new piece
there in any script. Pieces of more than ``LONG`` characters are split between letters and digits as well. What is left is a run of one class,
which the pre-tokenizer takes as one piece itself. The pieces' counts add up to the text's, so
a long text never goes to the encoder whole, and a piece that was seen before is looked up. Unknown
pieces are gathered over a batch and encoded in calls balanced by bytes. The memory of a worker is
bounded by the number of pieces it remembers.

Nulls and edge cases: a null text counts as empty (0 bytes, 0 tokens); special strings in a text
are handled as the library does by default (no boundary lies in one); rows with a null or repeated id are counted like any
other; columns that are not asked for are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held, table

#: Bytes of one call of the encoder, pieces that a worker remembers, and characters that make a piece a long one.
CALL_BYTES, REMEMBERED, LONG = 1 << 18, 300_000, 4096
#: A safe boundary. What some definition or other calls white space is none of its left sides.
SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\u180e\u200b\ufeff])(?=[ \t\n\r\f\v\u00a0\u2028\u3000])|(?<=[。！？；，、])(?=[^\W\d_])")
SAFE_ASCII = re.compile(r"(?<=[!-~])(?=[ \t\n])")
CLASSES = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def encoder(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def size_of(text: str) -> int:
    """Bytes of a text in UTF-8."""
    return len(text) if text.isascii() else len(text.encode())


def by_bytes(pieces: list[str], most: int = CALL_BYTES) -> Iterator[list[str]]:
    """Runs of pieces of about ``most`` bytes each, in order; a longer piece is a run of its own."""
    run, size = [], 0
    for p in pieces:
        n = size_of(p)
        if run and size + n > most:
            yield run
            run, size = [], 0
        run.append(p)
        size += n
    if run:
        yield run


def pieces_of(text: str) -> list[str]:
    pieces = (SAFE_ASCII if text.isascii() else SAFE).split(text)
    if len(text) > LONG and max(map(len, pieces)) > LONG:
        return [q for p in pieces for q in (CLASSES.split(p) if len(p) > LONG else [p])]
    return pieces


def lengths(texts: list[str], tokenizer, known: dict[str, int]) -> list[int]:
    """Tokens of each text; ``known`` remembers the counts of pieces between calls."""
    split = [pieces_of(t) for t in texts]
    if len(known) > REMEMBERED:
        known.clear()
    new = list({p for ps in split for p in ps}.difference(known))
    fresh: dict[str, int] = {}
    for run in by_bytes(new):
        for p, e in zip(run, tokenizer.encode_batch_fast(run, add_special_tokens=False), strict=True):
            fresh[p] = len(e)
    known.update(fresh)
    return [sum(map(known.__getitem__, ps)) for ps in split]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row's whole text under the tokenizer file at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = held(f"pieces of {path}", lambda: (encoder(path), {}))
        for b in batches:
            texts, counts, sizes = [t or "" for t in b.column(1).to_pylist()], [], []
            for part in by_bytes(texts):
                counts += lengths(part, tokenizer, known)
                sizes += map(size_of, part)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, "id long, n_bytes long, n_tokens long"
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE_SQL: dict[str, str] = {}
