import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.operators import blocking as B
from tessera.operators import evaluate as V
from tessera.plans import fixture as FX
from tessera.plans import oracle as O
from tessera.plans import queries as P
from tessera.sources.stage import quantile

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 10, 41, 600_000])
def test_quantile_is_exact(spark, n):
    rows = spark.range(n).select((F.col("id") + 10**12).alias("ordinal")).repartition(12)
    want = duckdb.connect().sql(f"select quantile_disc(i, 0.7::double) from range({n}) r(i)").fetchall()[0][0]
    assert quantile(rows, 0.7) - 10**12 == want


def test_quantile_without_rows(spark):
    assert quantile(spark.range(0).withColumnRenamed("id", "ordinal"), 0.7) is None


@pytest.mark.parametrize("blocks", [(B.OWN, B.OTHER), (37, 23)])
@pytest.mark.parametrize("k", [1, 20])
def test_best_is_top_of_all_pairs(spark, blocks, k):
    columns = ("s1_id", "target_id", "s1_ordinal", "ordinal", "score", "rank")
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    s1, t, _ = P.meta(spark, SF)
    every = B.rescored(B.blocked(s1, t, B.THREE_PASSES), s1, t)
    assert rows(B.best(s1, t, B.THREE_PASSES, k, B.OVERLAPS, blocks=blocks)) == rows(B.top(every, k))
    assert rows(B.best(s1, t, B.FOUR_CAPPED, k, blocks=blocks)) == rows(B.top(B.blocked(s1, t, B.FOUR_CAPPED), k))


def test_best_counts_repeats_and_shared_tokens(spark):
    """Repeated tokens count m times n; most targets share an address word; records without keys stay out."""
    schema = "entity_id string, ordinal long, country string, name_tokens array<string>, core_tokens array<string>, addr_tokens array<string>, digits array<string>"
    own = lambda i, name, country="DE": (i, int(i[3:]), country, name, [x for x in name if len(x) > 1], ["road"] + name[:1], ["12"])
    s1 = spark.createDataFrame([own("S1-1", ["anna", "anna", "bert"]), own("S1-2", []), own("S1-3", ["anna"], "FR")], schema)
    t = spark.createDataFrame([own(f"S2-{i}", ["anna"] * (i % 4) + ["carl"]) for i in range(1, 90)] + [own("S2-0", [])], schema)
    got = B.best(s1, t, B.THREE_PASSES, 5, B.OVERLAPS, ("name_tokens", "addr_tokens"), (2, 40))
    want = B.top(B.rescored(B.blocked(s1, t, B.THREE_PASSES), s1, t), 5)
    rows = lambda df: sorted(tuple(r) for r in df.select("s1_id", "target_id", "score", "rank").collect())
    assert rows(got) == rows(want) and len(rows(got)) == 5
    assert {tuple(r) for r in got.select("common_name_tokens", "union_name_tokens", "common_addr_tokens", "union_addr_tokens").collect()} == {(1, 3, 2, 2)}


@pytest.mark.parametrize("name", ["above_threshold", "assign_unique", "blocking_recall", "candidate_result", "block_write_capped", "features16", "features7"])
def test_pairs_are_not_exchanged_before_the_best_are_taken(spark, name):
    assert "FlatMapCoGroupsInArrow" in P.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_scanned_once(spark):
    """Three scans of the texts, each cutting whole texts for a few words, took more CPU than the search."""
    assert FX.entities(spark, SF)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_entities_are_those_of_the_sql(spark, tmp_path):
    texts = [None, "", " ", "\n", "\na b", "a\n", "a b c d e f g", "a b c d e f g ", "a b c d e f g h i", "a\t\tb \r\n c", "ß a", "a\u00a0b c", "  lead in", "  \n p q", "a\x0bb c"]
    rows = [(i * 7 + n, t, lang) for i, t in enumerate(texts * 3) for n, lang in enumerate(("en", " de ", None))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(f"with {O.E} select entity_id, business_name, business_address, country, ordinal from e").fetchall()
    null_last = lambda rs: sorted((tuple(r) for r in rs), key=lambda r: [(x is None, x) for x in r])
    assert null_last(FX.entities(spark, str(tmp_path)).collect()) == null_last(want)


def test_number_of_candidates_needs_no_overlaps(spark, monkeypatch):
    """The counts are those of the rescored best; features that move no count are not packed for them."""
    pairs, s1, _, _ = P.ranked(spark, SF)
    want = V.candidate_distribution(s1.select(F.col("entity_id").alias("s1_id")), pairs).collect()
    asked, best = [], B.best
    monkeypatch.setattr(B, "best", lambda s1, t, passes, k=20, overlaps=(), *more: asked.append(overlaps) or best(s1, t, passes, k, overlaps, *more))
    assert P.QUERIES["candidate_distribution"](spark, SF).collect() == want
    assert asked == [()]


@pytest.mark.parametrize("name", ["decision_overlay", "entity_f05"])
def test_pairs_are_found_once(spark, name):
    """A second plan of the best pairs deals and meets all blocks again, as its columns or filters differ."""
    assert P.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") <= 1


def test_records_are_dealt_once_and_targets_packed(spark):
    """What is exchanged for a block does not grow with the blocks it meets: S1 rows stand once for many slices of targets, and targets are packed before they are repeated."""
    schema = "entity_id string, ordinal long, country string, name_tokens array<string>, core_tokens array<string>, addr_tokens array<string>, digits array<string>"
    own = lambda p, i: (f"{p}-{i}", i, "DE", w := [f"name{i * j % 97}" for j in range(1, 9)], w, w, [f"{i % 31}"])
    s1, t = (spark.createDataFrame([own(p, i) for i in range(200)], schema).coalesce(1) for p in ("S1", "S2"))
    met = B.best(s1, t, B.THREE_PASSES, 20, B.OVERLAPS, blocks=(50, 20))
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("FlatMapCoGroupsInArrow") < plan.index("MapInArrow _packed")
    one, two = (plan[at:].split("\n")[0] for at in (plan.index("RepartitionByExpression [a_group"), plan.index("RepartitionByExpression [b_group")))
    assert one.endswith(", 4") and two.endswith(", 4")  # four blocks of records, not forty pairs of blocks
    rows = lambda df: sorted(tuple(r) for r in df.select("s1_id", "target_id", "score", "rank").collect())
    assert rows(met) == rows(B.top(B.rescored(B.blocked(s1, t, B.THREE_PASSES), s1, t)))


def test_packed_targets_are_small_and_whole():
    f = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)[np.random.default_rng(2).zipf(1.3, (20_000, 30)) % 3000]
    names = [f"S2-{i}" for i in range(20_000)]
    rows = pa.record_batch({"b_group": ["DE", "FR"] * 10_000, "b_parts": pa.array([2] * 20_000, pa.int32()), "b_other": pa.array([0] * 20_000, pa.int32()), "target_id": names, "ordinal": range(20_000), "f": list(f)})
    (out,) = B._packed(iter([rows.slice(0, 7000), rows.slice(7000)]))
    assert out.column("b_group").to_pylist() == ["DE", "FR"] and out.column("b_parts").to_pylist() == [2, 2]
    assert sum(len(x.as_py()) for x in out.column("pack")) < f.nbytes / 3
    slices = list(B._unpacked(pa.chunked_array([out.column("pack").slice(0, 1)]), 4096))
    assert [x.num_rows for x in slices] == [4096, 4096, 1808]
    assert {x["target_id"]: x["f"] for s in slices for x in s.to_pylist()} == {n: x for n, x in zip(names[::2], f[::2].tolist())}


def test_nearest_searches_equal_vectors_once(spark):
    """Many copies, ties between different vectors and several blocks: the same as all pairs sorted."""
    own = lambda n, m, g: [(i, "x" if i % 5 else "y", [float(v) for v in np.random.default_rng(i % m).integers(-2, 3, 4)]) for i in range(g, g + n)]
    a, b = own(300, 40, 1000), own(900, 60, 5000)
    q, t = (spark.createDataFrame(x, "id long, label string, vector array<float>") for x in (a, b))
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    want = []
    for i, g, v in a:
        best = sorted((-round(float(unit(v) @ unit(w)), 12), j) for j, h, w in b if h == g)[:7]
        want += [(i, j, n) for n, (_, j) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in B.nearest(q, t, 7, block=2).select("query_id", "target_id", "rank").collect()) == want
    found = B.nearest(q, t, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in found


def test_many_ratios_are_each_ratio():
    r = np.random.default_rng(3)
    some = ["", " ", "a", "a a", "b a a", "\0a", "a\0", "ß é", "x" * 64, "x" * 65, "ab cd " * 50] + ["".join(r.choice(list("abc é"), r.integers(0, 90))) for _ in range(40)]
    a, b = [x for x in some for _ in some], some * len(some)
    for one, many in ((S.ratio, S.ratios), (S.partial, S.partials), (S.token_sort, S.token_sorts), (S.token_set, S.token_sets), (S.weighted, S.weighteds)):
        assert many(a, b).tolist() == [one(x, y) for x, y in zip(a, b, strict=True)]
