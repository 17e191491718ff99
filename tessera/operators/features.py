"""Feature vectors of candidate pairs as named double columns over a_* and b_* attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.functions.text import grams


def _d(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _first(c: str) -> Column:
    return F.try_element_at(c, F.lit(1))


def _word(c: str) -> Column:
    return F.try_element_at(F.split(c, " "), F.lit(1))


def _sorted(c: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(c)), " ")


def sixteen(pairs: DataFrame) -> DataFrame:
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    addr = (a("norm_addr") != "") & (b("norm_addr") != "")
    digits = (F.size("a_digits") > 0) & (F.size("b_digits") > 0)
    core_a, core_b = _sorted("a_core_tokens"), _sorted("b_core_tokens")
    return pairs.withColumns(
        {
            "name_jaccard": S.jaccard(F.array_distinct("a_name_tokens"), F.array_distinct("b_name_tokens")),
            "core_jaccard": S.jaccard(F.array_distinct("a_core_tokens"), F.array_distinct("b_core_tokens")),
            "name_char3": S.jaccard(grams(a("norm_name")), grams(b("norm_name"))),
            "name_lev": S.levenshtein_ratio(a("norm_name"), b("norm_name")),
            "core_lev": S.levenshtein_ratio(core_a, core_b),
            "first_core": _d(_first("a_core_tokens") == _first("b_core_tokens")),
            "first_token": _d((_word("a_norm_name") == _word("b_norm_name")) & (a("norm_name") != "")),
            "containment": S.containment(a("norm_name"), b("norm_name")),
            "both_addr": _d(addr),
            "addr_jaccard": F.when(addr, S.jaccard(F.array_distinct("a_addr_tokens"), F.array_distinct("b_addr_tokens"))).otherwise(0.0),
            "addr_char3": F.when(addr, S.jaccard(grams(a("norm_addr")), grams(b("norm_addr")))).otherwise(0.0),
            "addr_lev": F.when(addr, S.levenshtein_ratio(a("norm_addr"), b("norm_addr"))).otherwise(0.0),
            "both_digits": _d(digits),
            "digit_jaccard": F.when(digits, S.jaccard(a("digits"), b("digits"))).otherwise(0.0),
            "digit_overlap": F.when(digits, S.overlap(a("digits"), b("digits"))).otherwise(0.0),
            "country_match": _d(a("country") == b("country")),
        }
    )


SIXTEEN = "name_jaccard core_jaccard name_char3 name_lev core_lev first_core first_token containment both_addr addr_jaccard addr_char3 addr_lev both_digits digit_jaccard digit_overlap country_match".split()


def eleven(pairs: DataFrame) -> DataFrame:
    ratio, token_set = S.fuzzy("ratio"), S.fuzzy("token_set")
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    core_a, core_b = (F.array_join(F.array_sort(f"{s}_core_tokens"), " ") for s in "ab")
    addr = (a("norm_addr") != "") & (b("norm_addr") != "")
    digits = (F.size("a_digits") > 0) & (F.size("b_digits") > 0)
    out = pairs.withColumns({"core_a": core_a, "core_b": core_b})
    return out.withColumns(
        {
            "name_ratio": ratio("a_norm_name", "b_norm_name"),
            "name_token_set": token_set("a_norm_name", "b_norm_name"),
            "core_ratio": ratio("core_a", "core_b"),
            "exact_name": _d((a("norm_name") != "") & (a("norm_name") == b("norm_name"))),
            "exact_core": _d((F.col("core_a") != "") & (F.col("core_a") == F.col("core_b"))),
            "prefix4": _d((a("norm_name") != "") & (b("norm_name") != "") & (F.substring("a_norm_name", 1, 4) == F.substring("b_norm_name", 1, 4))),
            "both_addr": _d(addr),
            "addr_token_set": F.when(addr, token_set("a_norm_addr", "b_norm_addr")).otherwise(0.0),
            "both_digits": _d(digits),
            "digit_overlap": F.when(digits, S.overlap(a("digits"), b("digits"))).otherwise(0.0),
            "digit_jaccard": F.when(digits, S.jaccard(a("digits"), b("digits"))).otherwise(0.0),
        }
    ).drop("core_a", "core_b")


ELEVEN = "name_ratio name_token_set core_ratio exact_name exact_core prefix4 both_addr addr_token_set both_digits digit_overlap digit_jaccard".split()


def seven(pairs: DataFrame) -> DataFrame:
    """Over a_/b_ clean_name, norm_name and norm_addr of the phrase normaliser."""
    ratio, sort, part = S.fuzzy("ratio"), S.fuzzy("token_sort"), S.fuzzy("partial")
    house_a, house_b = (F.regexp_extract(f"{s}_norm_addr", r"\d+", 0) for s in "ab")
    return pairs.withColumns(
        {
            "name_ratio": ratio("a_norm_name", "b_norm_name"),
            "name_token_sort": sort("a_norm_name", "b_norm_name"),
            "name_partial": part("a_norm_name", "b_norm_name"),
            "addr_ratio": ratio("a_norm_addr", "b_norm_addr"),
            "addr_token_sort": sort("a_norm_addr", "b_norm_addr"),
            "clean_name_ratio": ratio("a_clean_name", "b_clean_name"),
            "house_number_match": _d((house_a != "") & (house_a == house_b)),
        }
    )


SEVEN = "name_ratio name_token_sort name_partial addr_ratio addr_token_sort clean_name_ratio house_number_match".split()


def six(pairs: DataFrame, cosine: Column) -> DataFrame:
    """Over a_/b_ name and addr, lowered and trimmed."""
    sort, best = S.fuzzy("token_sort"), S.fuzzy("weighted")
    a, b = (F.array_distinct(F.filter(F.split(f"{s}_name", r"\s+"), lambda t: t != "")) for s in "ab")
    return pairs.withColumns(
        {
            "cosine": cosine,
            "name_token_sort": sort("a_name", "b_name"),
            "addr_token_sort": sort("a_addr", "b_addr"),
            "name_weighted": best("a_name", "b_name"),
            "token_jaccard": S.jaccard(a, b),
            "addr_weighted": best("a_addr", "b_addr"),
        }
    )


SIX = "cosine name_token_sort addr_token_sort name_weighted token_jaccard addr_weighted".split()
