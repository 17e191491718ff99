from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffixes as S


def brute(texts, size):
    raw = [(t or "").encode() for t in texts]
    n = Counter(t[i : i + size] for t in raw for i in range(len(t) - size + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - size + 1):
            if n[t[i : i + size]] > 1:
                gone[i : i + size] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((len(t), int(gone.sum()), int((edge > 0).sum()), bytes(b for b, g in zip(t, gone, strict=False) if not g)))
    return out


def corpus():
    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    shared, long = text(260), text(230)
    texts = [None, "", "short", "ab" * 400, "x" * 199, "y" * 200, "z" * 201, "q" * 1000]
    texts += [text(int(rng.integers(0, 150))) + shared[: int(rng.integers(150, 260))] + text(int(rng.integers(0, 150))) for _ in range(60)]
    near = text(2000)
    for _ in range(25):
        k = int(rng.integers(0, 1990))
        texts.append(near[:k] + text(3) + near[k + 3 :])
    return texts + [near, near, near] + [text(40) + long + text(40) for _ in range(40)] + [text(3000) * 2]


@pytest.mark.parametrize(("part", "block"), [(1024, 2 << 20), (5, 4000), (1, 700)])
def test_equals_brute_force(spark, monkeypatch, part, block):
    monkeypatch.setattr(S, "PART", part)
    monkeypatch.setattr(S, "BLOCK", block)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").repartition(3)
    got = {r.id: (r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), bytes(r.kept)) for r in S.deduplicated(docs).collect()}
    for i, want in enumerate(brute(texts, 200)):
        assert got[i] == want, i
    left = {r.doc_id: r.text for r in S.without_repeats(docs).collect()}
    assert left[0] is None and left[2] == "short" and left[7] == ""


def test_anchors_cover_every_window(monkeypatch):
    texts = [b"ab" * 300 + b"c" * 500 + "".join(map(str, range(900))).encode(), b"", b"x" * 199, b"y" * 200, bytes(range(1, 250)) * 4]
    raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    whole = S.anchors(raw, ends, 200)
    monkeypatch.setattr(S, "CHUNK", 1000)
    cut = S.anchors(raw, ends, 200)
    for a, b in zip(whole, cut, strict=True):
        assert a.tolist() == b.tolist()
    h, low, high, dig = whole
    want = [e - len(t) + i for t, e in zip(texts, ends, strict=True) for i in range(len(t) - 199)]
    assert [i for s, e in zip(low, high, strict=True) for i in range(s, e + 1)] == want
    same: dict = {}
    for s, e, d in zip(low, high, dig, strict=True):
        same.setdefault(int(d), set()).add(raw[s : e + 200].tobytes())
    assert all(len(v) == 1 for v in same.values()) and len(same) == len({raw[s : e + 200].tobytes() for s, e in zip(low, high, strict=True)})


def test_suffix_order_and_prefixes():
    raw = np.random.default_rng(0).choice(np.frombuffer(b"ab", np.uint8), 700)
    order, _ = S.suffix_ranks(raw, 256)
    t = raw.tobytes()
    assert order.tolist() == sorted(range(700), key=lambda i: t[i:])
    starts, ends = np.array([0]), np.array([700])
    got = S.common_prefixes(raw, order, starts, ends, 256)
    for a, b in zip(order[:-1], order[1:], strict=True):
        n = 0
        while max(a, b) + n < 700 and t[a + n] == t[b + n] and n < 256:
            n += 1
        assert got[b] == n


def test_regions_that_differ_after_256_shared_bytes():
    for seed in range(12):
        rng = np.random.default_rng(seed)
        text = lambda n: bytes(rng.choice(np.frombuffer(b"abcdefghij", np.uint8), n))
        regions = [text(int(rng.integers(200, 369))) for _ in range(200)]
        for _ in range(60):
            head = text(256)
            regions += [head + b"a" + text(100), head + b"b" + text(100)]
        regions = [regions[i] for i in rng.permutation(len(regions))]
        n = Counter(r[i : i + 200] for r in regions for i in range(len(r) - 199))
        found, heads = S.repeated_windows(regions, [1] * len(regions), 200)
        for r, f in zip(regions, found, strict=True):
            assert f.tolist() == [i for i in range(len(r) - 199) if n[r[i : i + 200]] > 1]
        assert sum(map(len, heads)) == len(n)


def test_texts_longer_than_a_chunk(spark):
    rng = np.random.default_rng(5)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    long, shared = text(S.CHUNK + 70_000), text(500)
    texts = [long, shared + text(300), long[-900:] + "é" + shared, long[S.CHUNK - 400 : S.CHUNK + 400]]
    got = {r.id: (r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), bytes(r.kept)) for r in S.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(4)] == brute(texts, 200)


def test_null_and_repeated_ids_and_clashing_columns(spark):
    a, b, c = "a" * 150 + "b" * 150, "".join(map(str, range(400))), "lone " * 30
    rows = [(None, a, 1, "x", 0), (None, c, 2, None, 0), (7, a, 3, "y", 0), (7, b, 4, "z", 0), (7, b, 4, "z", 0), (8, None, 5, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int, found string, h long").repartition(3)
    left = S.without_repeats(docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(None, "", 1, "x", 0), (None, c, 2, None, 0), (7, "", 3, "y", 0), (7, "", 4, "z", 0), (7, "", 4, "z", 0), (8, None, 5, "", 0)], key=str)


def test_empty_table(spark):
    assert S.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert S.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
