import re
from collections import Counter

import numpy as np

from tessera.llm import quality as Q


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(grams)
    hit = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_counts_and_verdicts(spark):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice([f"wörd{k}" for k in range(500)], 80)) for _ in range(60)]
    texts = [*good, None, "", "a b", "x\nx\nx\n \n \ny", "one two three four five six seven eight " * 5, "ab cd e\x1cf g " * 3, *(t.replace(" ", " | ") for t in good[:6]), "é" * 60_000]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {r.id: r for r in Q.judged(docs).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == brute(t), (i, t)
        n, _, _, _, rep = brute(t)
        assert got[i].base_failed == (n < 20 or 100 * rep > 30 * n)
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 72))
    assert Q.filtered(docs).count() == 60
    assert Q.judged(docs.limit(0)).count() == 0


def test_toxic_stems_are_learnt_and_reject(spark):
    rng = np.random.default_rng(1)
    words, bad = [f"w{k}" for k in range(300)], ["Vile,", "awful."]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(120)]
    texts = [t if i % 3 else t + " " + bad[i % 2] for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "vile"), (500, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 90)] + [(500, 0, None), (None, 1, 1), (700, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(Q.toxic_stems(docs, marks)) == [("awfu", 1), ("vile", 1)]
    assert {r.doc_id for r in Q.filtered(docs, marks).collect()} == {i for i in range(120) if i % 3}
    assert Q.toxic_stems(docs, marks.limit(0)) == [] and Q.toxic_stems(docs.limit(0), marks) == []


def test_a_lone_vote_counts_as_labels_tell(spark):
    rng = np.random.default_rng(2)
    plain = [" ".join(rng.choice([f"wörd{k}" for k in range(500)], 80)) for _ in range(200)]
    texts = [t.replace(" ", "### ") if i < 30 else t.upper() if i < 70 else t for i, t in enumerate(plain)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i >= 30), 0) for i in range(0, 200, 3)], "doc_id long, quality int, toxic int")
    assert {r.id for r in Q.judged(docs, marks).where("kept").collect()} == set(range(30, 200))
    none = spark.createDataFrame([(i, 0 if i < 70 else 1, 0) for i in range(0, 200, 3)], "doc_id long, quality int, toxic int")
    assert {r.id for r in Q.judged(docs, none).where("kept").collect()} == set(range(70, 200))


def test_expectation_maximisation_finds_noisy_rules():
    rng = np.random.default_rng(3)
    n, k = 20_000, len(Q.RULES)
    bad_doc = rng.random(n) < 0.15
    rate = np.where(bad_doc[:, None], [0.9, 0.8, 0.7, 0.3, 0.3, 0.3, 0.3, 0.3], [0.01, 0.02, 0.01, 0.3, 0.01, 0.01, 0.01, 0.01])
    votes = np.where(rng.random((n, k)) < rate, -1, 1)
    votes[rng.random((n, k)) < 0.1] = 0
    kinds, own, weight = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, rates = Q.fitted(kinds, weight.astype(float), np.full(len(kinds), -1))
    assert abs(rates[0][3] - 0.3) < 0.03 and max(rates[0][[0, 1, 2, 4, 5, 6, 7]]) < 0.05
    kept = good[own.ravel()] >= 0.5
    assert (kept == ~bad_doc).mean() > 0.97 > 0.8 > ((votes < 0).sum(axis=1) == 0)[~bad_doc].mean()
    one = [1] * k
    one[3] = -1
    assert good[[i for i, v in enumerate(kinds) if v.tolist() == one]] > 0.9
    for share in (0.02, 0.1):  # nothing but noise
        votes = np.where(rng.random((n, k)) < share, -1, 1)
        kinds, weight = np.unique(votes, axis=0, return_counts=True)
        good, _ = Q.fitted(kinds, weight.astype(float), np.full(len(kinds), -1))
        assert weight[good >= 0.5].sum() > 0.85 * n
    assert len(Q.fitted(np.zeros((0, k), int), np.zeros(0), np.zeros(0, int))[0]) == 0


def test_filtered_judges_rows_apart(spark):
    rng = np.random.default_rng(4)
    text = lambda: " ".join(rng.choice([f"w{k}x" for k in range(500)], 60))
    rows = [(1, text(), 1), (1, "too short", 2), (None, text(), 3), (None, "short", 4), (2, None, 5)] + [(9, text(), 6)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    out = Q.filtered(docs)
    assert out.columns == docs.columns and sorted(r.n_words for r in out.collect()) == [1, 3, 6, 6]


def test_no_table_of_labels(spark, tmp_path):
    assert Q.labels(spark, str(tmp_path)) is None
