import itertools

import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.common import connected


def brute(rows, radius=2):
    """Fingerprints by the definition and components over all pairs."""
    fps = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        votes = [sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in sh) for k in range(64)]
        fps[i] = sum(1 << k for k in range(64) if 2 * votes[k] > len(sh))
    least = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(fps, 2):
            if (fps[a] ^ fps[b]).bit_count() <= radius and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return {i: (f"{fps[i]:016x}", least[i]) for i in fps}


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(60):
        base = list(rng.choice(words, 120))
        rows.append((len(rows), " ".join(base)))
        for _ in range(i % 4):
            base[int(rng.integers(120))] = "edit"
            rows.append((len(rows), " ".join(base)))
    rows += [(900, None), (901, ""), (902, "  \n"), (903, "One"), (904, "one"), (905, "É a B"), (906, "a " * 40_000)]
    docs = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], "doc_id long, text string, id string, fp string, component int")
    got = {r.id: (f"{r.fp & (2**64 - 1):016x}", r.component) for r in simhash.groups(docs).collect()}
    assert got == brute(rows)


def test_no_id_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (3, "a b c")], "doc_id long, text string")
    got = sorted((r.id is None, r.id or 0, r.component) for r in simhash.groups(docs).collect())
    assert [g[2] for g in got] == [3, 3, None]
    assert simhash.groups(docs.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(docs).collect()) == [0, 3]


def test_linked_equals_all_pairs():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.concatenate([fps, *(fps ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(20))])
    rows = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    label = np.arange(len(fps))
    for _ in range(20):
        label = np.where(rows, label[None], len(fps)).min(axis=1)
    assert np.array_equal(simhash.linked(fps, 2), label)


def near(rows, share=0.8):
    """Components over all pairs by the Jaccard similarity of the sets of five-word shingles."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}
    least = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if least[a] != least[b] and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                least[a] = least[b] = min(least[a], least[b])
    return least


def test_near_groups_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    words, rows = [f"w{k}" for k in range(500)], []
    for i in range(40):
        base = list(rng.choice(words, 200))
        rows.append((len(rows), " ".join(base)))
        for k in range(i % 4):  # one to three words changed: similarities of 0.86 and more
            base[20 + 50 * k] = "edit"
            rows.append((len(rows), " ".join(base).upper()))
        rows.append((len(rows), " ".join([*base[:120], *rng.choice(words, 80)])))  # 0.4
    rows += [(900, None), (901, ""), (902, "  \n"), (903, "One"), (904, "one"), (905, "one two"), (906, "a " * 40_000), (907, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "x", b"y", 0) for i, t in rows], "doc_id long, text string, id string, fp binary, component int")
    assert {r.id: r.component for r in simhash.near_groups(docs).collect()} == near(rows)
    assert sorted(r.doc_id for r in simhash.keep_one_near(docs).collect()) == sorted(set(near(rows).values()))
    assert simhash.near_groups(docs.limit(0)).count() == 0
    loose = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (3, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in simhash.keep_one_near(loose).collect()) == [0, 3]


def test_wide_linked_equals_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (30, 4), dtype=np.uint64)
    fps = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, (30, 4), dtype=np.uint64)) for _ in range(40))])
    rows = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= 6
    label = np.arange(len(fps))
    for _ in range(30):
        label = np.where(rows, label[None], len(fps)).min(axis=1)
    assert np.array_equal(simhash.wide_linked(fps, 6), label)


def test_similarity_is_exact_round_the_threshold(spark):
    rows, want = [], {}
    for permille in (750, 790, 800, 820):  # shared of 1000 shingles in either text
        for k in range(25):
            i, left = len(rows), (1000 - permille) // 2
            word = [f"{permille}x{k}x{j}" for j in range(permille + left + 4)]
            other = [f"{permille}y{k}y{j}" for j in range(1000 - permille - left)]
            rows += [(i, " ".join(word)), (i + 1, " ".join(word[: permille + 4] + other))]
            want |= {i: i, i + 1: i if permille >= 800 else i + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near(rows[:2]) == {0: 0, 1: 1} and near(rows[100:102]) == {100: 100, 101: 100}
    assert {r.id: r.component for r in simhash.near_groups(docs).collect()} == want


def test_one_row_of_each_group_stays(spark):
    rng = np.random.default_rng(6)
    text = [" ".join(rng.choice([f"w{k}" for k in range(400)], 90)) for _ in range(3)]
    rows = [(4, text[0], 1), (4, text[0], 2), (4, text[1], 3), (4, text[1], 4), (9, text[0].upper(), 5), (None, text[0], 6), (None, text[0], 7), (7, text[2], 8), (8, None, 9), (8, "", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(4)
    for keep in (simhash.keep_one, simhash.keep_one_near):
        left = keep(docs)
        assert left.columns == docs.columns
        got = sorted(r.key for r in left.collect())
        assert [sum(k in own for k in got) for own in ((1, 2, 5), (3, 4), (6, 7), (8,), (9, 10))] == [1, 1, 2, 1, 1] and 5 not in got


def test_marks_and_case_make_no_difference_but_marks_alone_do(spark):
    base = " ".join(f"word{k}" for k in range(40))
    texts = [base, base.upper().replace(" ", ", "), base.replace(" ", "\n- "), "### *** |", "*** ###", "...", ""]
    got = {r.id: r.component for r in simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6}


def test_buckets_of_more_than_one_part(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 7)
    test_groups_equal_brute_force(spark)
    test_near_groups_equal_brute_force(spark)


def test_recall_by_similarity(spark):
    """Pairs at 0.8 and more are found whatever the similarity; none below is."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(240):
        share = 0.7 + 0.3 * k / 240
        n = 60 + k
        base = [f"p{k}x{j}" for j in range(n + 4)]
        other = list(base)
        for j in rng.choice(np.arange(4, n, 9), max(0, round((1 - share) / (1 + share) * n / 5)), replace=False) if share < 1 else []:
            other[int(j)] += "e"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        want |= near(rows[-2:])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component for r in simhash.near_groups(docs).collect()} == want
    assert 40 < sum(i != c for i, c in want.items()) < 240


def test_a_hub_and_a_chain(spark):
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1200)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 400)} | {k: 1000 for k in range(1001, 1201)}
