import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.functions import text as X
from tessera.functions import words as W

TEXT = st.text(alphabet="ab c", max_size=12)


def dp(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


@given(TEXT, TEXT)
def test_lcs_equals_the_table(a, b):
    assert S.lcs(a, b) == dp(a, b)


@given(TEXT, TEXT)
def test_fuzzy_scores(a, b):
    for f in (S.ratio, S.token_sort, S.token_set, S.weighted):
        assert 0 <= f(a, b) <= 1 and f(a, b) == pytest.approx(f(b, a))
    assert S.ratio(a, a) == 1 and 0 <= S.partial(a, b) <= 1


def test_golden_names_and_addresses(spark):
    names = [
        ("एसएस फूड प्राइवेट लिमिटेड", "ss food pvt ltd", ["ss", "food"]), ("रेड वेंचर्स प्राइवेट लिमिटेड", "red ventures pvt ltd", ["red"]),
        ("होटल एंटरप्राइजेज लिमिटेड", "hotel enterprises ltd", ["hotel"]), ("Chordia &-Pártners Ltd", "chordia partners ltd", ["chordia"]),
        ("Laxmi Golden Investments", "laxmi golden investments", ["laxmi", "golden"]), (None, "", []), ("The LLC", "llc", ["llc"]),
    ]
    addresses = [
        ("AF-0684, NANDGRAM NEAR MOTHER INDIA PUBLIC SCHOOL, उत्तर प्रदेश", "af 0684 nandgram nr mother india public school uttar pradesh", {"0684"}),
        ("WZ-187C SHOP NO.13, DELHI, WEST DELHI, Delhi", "wz 187c shop no 13 delhi w delhi delhi", {"187c", "13"}),
        ("H.NO 1038 SECTOR 9, FARIABAD, Haryana, भारत", "h no 1038 sec 9 fariabad haryana", {"1038", "9"}), ("", "", set()),
    ]
    rows = [(str(i), n[0], None, None) for i, n in enumerate(names)] + [(f"a{i}", None, a[0], " us ") for i, a in enumerate(addresses)]
    got = {r.entity_id: r for r in X.meta(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")).collect()}
    for i, (_, norm, core) in enumerate(names):
        assert (got[str(i)].norm_name, got[str(i)].core_tokens, got[str(i)].country) == (norm, core, "US")
    for i, (_, norm, digits) in enumerate(addresses):
        assert (got[f"a{i}"].norm_addr, set(got[f"a{i}"].digits)) == (norm, digits)


def test_phrases_and_small_texts(spark):
    df = spark.createDataFrame([("Acme Private Limited, North St.",), ("Private, Limited",), (None,)], "t string")
    assert [r[0] for r in df.select(X.phrases("t")).collect()] == ["acme pvt ltd n st", "private ltd", ""]
    assert [r[0] for r in spark.createDataFrame([("",), ("ab",), ("abcd",)], "t string").select(X.grams(F.col("t"))).collect()] == [[], ["ab"], ["abc", "bcd"]]
    keys = list(W.PHRASE_ABBREVIATIONS)
    assert not any(k in v.split() for k in keys for v in W.PHRASE_ABBREVIATIONS.values() if W.PHRASE_ABBREVIATIONS[k] != k)


def test_levenshtein_ratio_and_jaccard(spark):
    rows = [("", "", 1.0), ("", "a", 0.0), ("abc", "abcd", 0.75), ("kitten", "sitting", 1 - 3 / 7), ("a" * 90, "a" * 45 + "b" * 45, None)]
    got = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string").select(S.levenshtein_ratio(F.col("a"), F.col("b"))).collect()
    for (_, _, want), r in zip(rows, got, strict=True):
        assert want is None or r[0] == pytest.approx(want)
    assert got[4][0] == pytest.approx(0.25)


def test_greedy_equals_arg_max():
    rng = random.Random(1)
    for _ in range(300):
        pairs = [(s, t, rng.choice([0.2, 0.5, 0.8])) for s in range(5) for t in range(5) if rng.random() < 0.6]
        claimed, greedy = set(), set()
        for s, t, p in sorted(pairs, key=lambda x: -x[2]):
            if p >= 0.5 and t not in claimed:
                claimed.add(t)
                greedy.add((s, t))
        best = {max((p, -s) for s, u, p in pairs if u == t) + (t,) for t in {t for _, t, _ in pairs}}
        assert greedy == {(-s, t) for p, s, t in best if p >= 0.5}
