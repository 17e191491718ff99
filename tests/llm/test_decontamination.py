import pytest

from tessera.llm import decontamination as D


def item(k, n=13):
    return " ".join(f"b{k}x{i}" for i in range(n))


@pytest.mark.parametrize("rows", [D.BROADCAST_ROWS, 0])
def test_rules(spark, monkeypatch, rows):
    monkeypatch.setattr(D, "BROADCAST_ROWS", rows)
    bench = spark.createDataFrame([(1, item(1)), (2, item(2, 15)), (3, "Short é-Item"), (4, None), (5, "!?"), (6, item(1).upper())], "item_id long, text string")
    docs = spark.createDataFrame(
        [
            (1, "pre " + item(1) + " post", 0), (2, item(2, 15)[:-5], 0), (3, "a SHORT, É? short é item b", 0), (4, None, 0), (5, "", 0),
            (6, "clean words only", 0), (7, item(1) + " z" * 400, 0), (1, "other row", 0), (None, item(1), 0), (8, item(1).replace(" ", "\n--"), 0),
        ],
        "doc_id long, text string, n_hit int",
    )
    got = sorted(((r.id or 0), r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in D.judged(docs, bench).collect())
    assert got == sorted([
        (1, 15, 13, "1,6", True), (2, 14, 14, "2", True), (3, 7, 3, "3", True), (4, 0, 0, "", False), (5, 0, 0, "", False),
        (6, 3, 0, "", False), (7, 413, 13, "1,6", False), (1, 2, 0, "", False), (0, 13, 13, "1,6", True), (8, 13, 13, "1,6", True),
    ])
    kept = sorted((r.doc_id or 0, r.n_hit) for r in D.filtered(docs, bench).collect())
    assert [k for k, _ in kept] == [1, 4, 5, 6, 7]
    spans = {(r.doc_id, r.text) for r in D.without_spans(docs, bench).collect()}
    assert (1, "other row") in spans and (4, None) in spans
    assert any(i == 1 and t.split() == ["pre", "post"] for i, t in spans if t)


def test_spans_with_clashing_columns_and_long_texts(spark):
    bench = spark.createDataFrame([(1, item(1)), (2, item(2))], "item_id long, text string")
    long = "word " * 30_000 + item(1) + "!? " + "tail " * 30_000 + item(2)
    rows = [(1, f"a {item(1)} b", 5, "x", 0), (2, long, 6, "y", 0), (None, item(1), 7, "z", 0), (2, None, 8, None, 0), (2, "", 9, "", 0), (1, f"a {item(1)} b", 5, "x", 0), (4, " ".join(item(1) for _ in range(2000)), 1, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int, __w string, hit_at int")
    left = D.without_spans(docs, bench)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.at, r.text if r.text is None else " ".join(r.text.split())) for r in left.collect()), key=str)
    want = [(1, 5, "a b"), (1, 5, "a b"), (2, 6, ("word " * 30_000 + "!? " + "tail " * 30_000).strip()), (0, 7, ""), (2, 8, None), (2, 9, ""), (4, 1, "")]
    assert got == sorted(want, key=str)
    assert sorted((r.doc_id or 0, r.at) for r in D.filtered(docs, bench).collect()) == [(2, 6), (2, 8), (2, 9)]


def test_a_window_of_every_item(spark):
    bench = spark.createDataFrame([(k, item(0) + f" only{k}") for k in range(200)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "pre " + item(0)) for k in range(50)] + [(99, item(0) + " only7")], "doc_id long, text string")
    got = {r.id: (len(r["items"]), r.n_hit) for r in D.judged(docs, bench).collect()}
    assert got == {k: (200, 13) for k in range(50)} | {99: (200, 14)}


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in D.judged(docs, bench).collect()] == [(2, 0, [])]
    assert D.judged(docs.limit(0), bench).count() == 0
