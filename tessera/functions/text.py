"""Normalisation of names and addresses as column expressions.

All but the Unicode decomposition (an Arrow function that Spark lacks) stays in the JVM. Nulls count as empty.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import words as w


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def without_marks(c: Column) -> Column:
    """Compatibility decomposition without the combining characters."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        # compatibility forms and marks; pure ASCII passes as it is
        return s.map(lambda t: t if t.isascii() else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))

    return run(c)


def transliterated(c: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), w.INDIC_TO_LATIN.items(), c)


def clean(c: Column | str, marks: bool = True) -> Column:
    """Lower case, transliterated, without accents, punctuation as single spaces."""
    x = transliterated(F.lower(text(c)))
    x = without_marks(x) if marks else x
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9\s]", " "), r"\s+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def mapped(raw: Column, table: dict[str, str]) -> Column:
    """Tokens replaced by the table; others stay unless they are stopwords. Order and repeats are kept."""
    known, stop = lookup(table), F.array(*map(F.lit, w.STOPWORDS))
    out = F.transform(raw, lambda t: F.coalesce(F.element_at(known, t), F.when(F.array_contains(stop, t), F.lit("")).otherwise(t)))
    return F.filter(out, lambda t: t != "")


def core(name_tokens: Column) -> Column:
    """Tokens that tell names apart; the first token where there is none."""
    generic = F.array(*map(F.lit, w.GENERIC_NAME_TOKENS))
    own = F.filter(name_tokens, lambda t: (F.length(t) > 1) & ~F.array_contains(generic, t))
    return F.when((F.size(own) == 0) & (F.size(name_tokens) > 0), F.slice(name_tokens, 1, 1)).otherwise(own)


def digit_tokens(raw: Column) -> Column:
    return F.array_distinct(F.filter(raw, lambda t: t.rlike("^[0-9]+[a-z]?$")))


def ascii_only(c: Column | str) -> Column:
    """Transliterated ASCII in lower case, with marks as spaces that do not collapse yet."""
    x = F.trim(F.lower(F.regexp_replace(without_marks(transliterated(text(c))), r"[^\x00-\x7F]", "")))
    return F.regexp_replace(x, r"[^\w\s]", " ")


def plain(c: Column | str) -> Column:
    """Transliterated ASCII words in lower case, one space between them."""
    return F.trim(F.regexp_replace(ascii_only(c), r"\s+", " "))


def phrases(c: Column | str) -> Column:
    """Transliterated ASCII in lower case with phrases abbreviated, longest first, before spaces collapse."""
    x = ascii_only(c)
    for k in sorted(w.PHRASE_ABBREVIATIONS, key=len, reverse=True):
        x = F.regexp_replace(x, rf"(?i)\b{k}\b", w.PHRASE_ABBREVIATIONS[k])
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def without_suffix(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, w.LEGAL_SUFFIX, ""))


def grams(c: Column, n: int = 3) -> Column:
    """The set of character n-grams; a shorter text is its only gram, an empty one has none."""
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(n))))
    return F.when(F.length(c) >= n, own).when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def first_word(c: Column | str) -> Column:
    return F.regexp_extract(F.lower(text(c)), r"(?U)^[^\w]*(\w+)", 1)


def joined(name: Column | str, address: Column | str) -> Column:
    return F.concat_ws(" [SEP] ", F.nullif(F.trim(text(name)), F.lit("")), F.nullif(F.trim(text(address)), F.lit("")))


def country(c: Column | str) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("US"))))


def meta(df, marks: bool = True):
    """The normalised record: country, names, tokens, core tokens, address, its tokens and digits."""
    raw = df.withColumns({"_n": clean("business_name", marks), "_a": clean("business_address", marks)})
    raw = raw.withColumns({"name_tokens": mapped(tokens(F.col("_n")), w.LEGAL_TERMS), "addr_tokens": mapped(tokens(F.col("_a")), w.ADDRESS_ABBREVIATIONS), "digits": digit_tokens(tokens(F.col("_a")))})
    return raw.select(
        "entity_id",
        *(c for c in ("ordinal",) if c in df.columns),
        country("country").alias("country"),
        F.array_join("name_tokens", " ").alias("norm_name"),
        "name_tokens",
        core(F.col("name_tokens")).alias("core_tokens"),
        F.array_join("addr_tokens", " ").alias("norm_addr"),
        "addr_tokens",
        "digits",
    )
