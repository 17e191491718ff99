import glob
import os
import zipfile

import duckdb
import numpy as np
import pytest

from tessera.operators import boosting as BO
from tessera.operators import evaluate as V
from tessera.operators import model as ML
from tessera.operators import resolve as R
from tessera.operators import validate as Q
from tessera.plans import fixture as FX
from tessera.plans import pipeline as PL
from tessera.plans import queries as P
from tessera.plans import session as SE
from tessera.sources import records as IO
from tessera.sources.stage import numbered

SF = "/root/testdata/sf0.001"


def norm(v):
    return "null" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", ["norm_name", "norm_addr", "strip_suffix", "knn_topk", "block_4index_capped", "features16", "threshold_sweep", "matching_result", "validate_result_rules", "rethreshold", "decision_overlay", "norm_phrases", "block_write_capped", "coverage_report", "coverage_diagnosis", "result_report", "resumed_by_country", "review_records", "training_pairs", "scan_tsv", "empty_rate_by_chunk"])
def test_query_equals_its_sql(spark, duck, name):
    rows = P.QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    want = duck.sql(P.ORACLE_SQL[name])
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(norm(r[c]) for c in columns) for r in rows.collect()) == sorted(tuple(norm(r[i]) for i in order) for r in want.fetchall())


def test_features7_describes_every_written_candidate(spark):
    pairs = lambda name: sorted((r.s1_id, r.target_id) for r in P.QUERIES[name](spark, SF).select("s1_id", "target_id").collect())
    assert pairs("features7") == pairs("block_write_capped")


def test_golden_scores(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "s1_id string")
    truth = spark.createDataFrame([("c", "x"), ("d", "x"), ("e", "S2-00047"), ("e", "S3-00812")], "s1_id string, target_id string")
    predicted = spark.createDataFrame([("b", "x"), ("d", "y"), ("e", "S2-00047"), ("e", "S2-00193"), ("e", "S3-00812"), ("other", "z")], "s1_id string, target_id string")
    got = {r.s1_id: (round(r.precision, 3), r.recall, round(r.f05, 3)) for r in V.entity_scores(ids, truth, predicted).collect()}
    assert got == {"a": (1, 1, 1), "b": (0, 0, 0), "c": (0, 0, 0), "d": (0, 0, 0), "e": (0.667, 1, 0.714)}


def test_invariants_of_a_run(spark):
    matched = {r.source1_entity_id: [x for x in r.matched_entity_ids.split(",") if x] for r in P.matching_result(spark, SF).collect()}
    candidates = {r.source1_entity_id: set(r.candidate_entity_ids.split(",")) for r in P.candidate_result(spark, SF).collect()}
    assert len(matched) == 200 and set(matched) == set(candidates)
    every = [t for ts in matched.values() for t in ts]
    assert len(every) == len(set(every)) and all(set(ts) <= candidates[s] for s, ts in matched.items())


def test_files(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\ta "b\t\tus\nS1-2\tc\td\tFrance\n')
    read = IO.read_tsv(spark, str(tmp_path / "s.tsv"))
    assert [tuple(r) for r in read.collect()] == [("S1-1", 'a "b', "", "us"), ("S1-2", "c", "d", "France")]
    (tmp_path / "p.tsv").write_text("entity_id\tbusiness_name\nS1-1\ta\nS1-2\tb\tc\t fr \n")
    assert [tuple(r) for r in IO.read_positional(spark, str(tmp_path / "p.tsv")).collect()] == [("S1-1", "a", "", "US"), ("S1-2", "b", "c", "FR")]
    pairs = spark.createDataFrame([("S1-2", "S3-1"), ("S1-2", "S2-9")], "s1_id string, target_id string")
    IO.write_tsv(IO.as_lists(IO.with_ordinal(read), pairs), str(tmp_path / "out"))
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/out/part-*")))
    assert text.split("\n")[:3] == ["source1_entity_id\tmatched_entity_ids", "S1-1\t", "S1-2\tS2-9,S3-1"]
    truth = spark.createDataFrame([("a", " x , ,y,x", 1), ("a", "z", 2), ("b", "", 3)], "source1_entity_id string, matched_entity_ids string, ordinal int")
    assert [tuple(r) for r in IO.truth_pairs(truth).collect()] == [("a", "z")]
    assert R.thresholds(read).count() == 19


def lines(path, *rows):
    path.write_text("\n".join(rows) + "\n" if rows else "")
    return str(path)


def test_source_reports(spark, tmp_path):
    head = "\t".join(IO.RECORD.names)
    report = lambda *rows, **k: Q.source_report(spark, lines(tmp_path / "s.tsv", *rows), IO.RECORD.names, "S1-", **k).first()
    good = report(" Entity_ID\tbusiness_name\tbusiness_address\tcountry", "S1-1\ta\tb\tUS", "", "X-2\tc\td\t ", "S1-3\te\tf\tUS")
    assert good.valid and good.n_rows == 4 and good.n_checked == 3 and good.country_counts == {"US": 2, "Unknown": 1}
    assert good.warnings == ["row 4 has the id X-2"] and len(good.sample_rows) == 3
    bad = report(head, *["S1-1\ta\tb"] * 7, "S1-2\ta\tb\tUS")
    assert not bad.valid and len(bad.errors) == 5 and bad.errors[0] == "row 2 has 3 fields" and bad.n_checked == 1
    few = report(head, *[f"S1-{k}\ta\tb\tUS" for k in range(30)], "broken", check=10)
    assert few.valid and few.n_checked == 10 and few.n_rows == 31 and len(few.sample_rows) == 10
    assert report("a,b,c").errors == ["commas for tabs"] and report().errors == ["file is empty"]
    assert report("id\tname").errors == ["columns are id, name, not entity_id, business_name, business_address, country"]
    assert Q.source_report(spark, str(tmp_path / "none.tsv"), IO.RECORD.names).first().errors == ["file not found"]


def test_scans_drop_lines_of_another_width(spark, tmp_path):
    path = lines(tmp_path / "s.tsv", "\t".join(IO.RECORD.names), 'S1-1\ta "b"\t\tus', "S1-2\tc\td", "S1-3\te\tf\tg\th", "S1-4\te\tf\tg")
    assert [r.entity_id for r in IO.read_tsv(spark, path).collect()] == ["S1-1", "S1-4"]
    assert sorted(r.entity_id for r in IO.read_ids(spark, path).collect()) == ["S1-1", "S1-2", "S1-3", "S1-4"]
    assert IO.count_rows(spark, path).first().n_rows == 4 and IO.count_rows(spark, lines(tmp_path / "e.tsv")).first().n_rows == 0


def test_vectors_are_kept_and_chosen_by(spark, tmp_path):
    path = str(tmp_path / "v")
    assert IO.read_vectors(spark, path) is None
    IO.write_vectors(spark.createDataFrame([("S1-1", [3.0, 4.0]), ("S1-2", [0.0, 0.0])], "entity_id string, vector array<double>"), path)
    got = {r.entity_id: [round(x, 6) for x in r.vector] for r in IO.read_vectors(spark, path).collect()}
    assert got == {"S1-1": [0.6, 0.8], "S1-2": [0.0, 0.0]}
    df = spark.createDataFrame([("S1-1",)], "entity_id string")
    assert IO.with_vectors(df, None).columns == ["entity_id"] and IO.with_vectors(df, IO.read_vectors(spark, path)).columns == ["entity_id", "vector"]


def test_resume_runs_only_what_is_missing(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-1", 1, "US"), ("S1-2", 2, "DE"), ("S1-3", 3, "DE")], "entity_id string, ordinal long, country string")
    ran = []

    def run(country):
        ran.append(country)
        return s1.where(s1.country == country).selectExpr("entity_id source1_entity_id", "concat('S2-', ordinal) matched_entity_ids")

    path = str(tmp_path / "done")
    for _ in range(2):
        out = IO.resume_by_country(s1, run, path)
        assert [tuple(r) for r in out.orderBy("ordinal").collect()] == [("S1-1", "S2-1", 1), ("S1-2", "S2-2", 2), ("S1-3", "S2-3", 3)]
    assert ran == ["DE", "US"] and IO.done_countries(spark, path) == ["DE", "US"]
    with pytest.raises(ValueError, match="1 records missing, 1 unexpected, 1 repeated"):
        IO.assert_complete(spark.createDataFrame([("S1-1",), ("S1-1",), ("S1-2",), ("x",)], "id string"), s1)


def test_result_report_levels(spark):
    s1 = spark.createDataFrame([(f"S1-{k}",) for k in range(9)], "entity_id string")
    full = spark.createDataFrame([(f"S1-{k}", f"S2-{k}") for k in range(9)], "source1_entity_id string, matched_entity_ids string")
    candidates = full.withColumnRenamed("matched_entity_ids", "candidate_entity_ids").where("source1_entity_id <> 'S1-3'")
    assert [tuple(r) for r in Q.result_report(full, s1, None, candidates).orderBy("rule").collect()] == [("info", "empty_rate", 0, "0.0"), ("warning", "no_candidate", 1, "S1-3")]
    empty = full.selectExpr("source1_entity_id", "case when source1_entity_id < 'S1-6' then '' else matched_entity_ids end matched_entity_ids")
    got = {r.rule: r.level for r in Q.result_report(empty, s1).collect()}
    assert got == {"empty_rate": "error", "no_candidates": "warning"}
    many = spark.createDataFrame([(f"S1-{k}", "S1-0,S2-1") for k in range(8)] + [("S1-1", None)], "source1_entity_id string, matched_entity_ids string")
    got = {r.rule: (r.n, r.examples) for r in Q.result_report(many, s1, spark.createDataFrame([("S3-1",)], "entity_id string")).collect()}
    assert got["self_match"] == (1, "S1-0") and got["unknown_id"] == (1, "S2-1") and got["missing_s1"] == (1, "S1-8") and got["duplicate_row"] == (1, "S1-1") and got["claimed_twice"] == (2, "S1-0,S2-1")


def test_rows_are_numbered_over_ranges(spark):
    df = spark.range(500).selectExpr("(id * 7919) % 500 ordinal").repartition(7)
    assert [(r.ordinal, r.row) for r in numbered(df).orderBy("row").collect()] == [(k, k) for k in range(500)]
    assert numbered(df.limit(0)).count() == 0


def test_training_without_a_true_pair_falls_back(spark):
    e = FX.entities(spark, SF)
    s1, targets = FX.split(e)
    none = FX.truth(e).limit(0)
    for name in ("modular", "hardened"):
        assert PL.train(s1, targets, none, PL.PRESETS[name], 0.6) == (None, 0.6)
    pairs, lists, _ = PL.link(s1, targets, None, 0.6, PL.PRESETS["modular"])
    assert lists.count() == s1.count() and 0 <= pairs.agg({"prob": "min"}).first()[0] <= pairs.agg({"prob": "max"}).first()[0] <= 1


def test_the_fallback_keeps_all_that_its_similarities_let_through(spark):
    s1 = IO.with_ordinal(spark.createDataFrame([("S1-1", "Acme Bakery", "1 Main Street", "US")], IO.RECORD))
    targets = IO.with_ordinal(spark.createDataFrame([(f"S2-{k}", "ACME bakery" + "s" * (k % 2), f"{k} main street", "US") for k in range(60)], IO.RECORD))
    pairs, lists, _ = PL.link(s1, targets, *PL.train(s1, targets, spark.createDataFrame([], "s1_id string, target_id string"), PL.PRESETS["embedding"]), PL.PRESETS["embedding"])
    assert pairs.count() == 60
    first = lists.first().matched_entity_ids.split(",")
    score = {r.target_id: r.prob for r in pairs.collect()}
    assert len(first) == 60 and first[0] == "S2-10" and [score[t] for t in first] == sorted(score.values(), reverse=True)


def test_held_out_pairs_are_stratified(spark):
    pairs = spark.range(4000).selectExpr("concat('S1-', id) s1_id", "concat('S2-', id) target_id", "cast(id % 10 = 0 as int) label")
    n = {(r.label, r.train): r["count"] for r in ML.held_out(pairs).groupBy("label", "train").count().collect()}
    assert abs(n[1, True] - 320) <= 32 and abs(n[0, True] - 2880) <= 32 and sum(n.values()) == 4000
    assert ML.held_out(pairs).where("train").exceptAll(ML.held_out(pairs.repartition(5)).where("train")).count() == 0


def test_boosting_splits_where_the_gain_is_best():
    rng = np.random.default_rng(1)
    x = rng.random((300, 3)).round(2)
    y = (x[:, 1] > 0.6).astype(float)
    grad, hess = 0.5 - y, np.full(300, 0.25)
    cuts = [BO.bounds_of(x[:, j]) for j in range(3)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    tree, value = BO.grown(binned, cuts, grad, hess, 2, 1.0)
    best = max(
        (((g := grad[(low := x[:, j] <= c)].sum()) ** 2 / hess[low].sum() + (grad.sum() - g) ** 2 / hess[~low].sum()), j, c)
        for j in range(3) for c in cuts[j] if 20 <= (x[:, j] <= c).sum() <= 280
    )
    assert (tree.feature[0], tree.bound[0]) == best[1:] and np.allclose(tree(x), value)
    model = BO.boosted(x, y, np.ones(300), ["a", "b", "c"], rounds=300)
    assert ((model.probability(x) > 0.5) == (y > 0.5)).all() and len(model.trees) <= 300
    assert max((t.feature < 0).sum() for t in model.trees) <= 31


def test_trees_learn_held_out_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.random((4000, 4))
    y = (x[:, 0] * x[:, 1] + x[:, 2] ** 2 > 0.7).astype(int)
    rows = [(f"S1-{i}", f"S2-{i}", int(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    pairs = ML.held_out(spark.createDataFrame(rows, "s1_id string, target_id string, label int, a double, b double, c double, d double"))
    model = ML.fit(pairs.where("train"), list("abcd"), True)
    rest = ML.predict(model, pairs.where("not train"), list("abcd"))
    assert rest.where("(prob >= 0.5) = (label = 1)").count() > 0.95 * rest.count()


def test_trees_learn_from_every_pair(spark):
    """Twenty rows of 300,000 make a leaf only where all of them are counted; a share by hash had some thirteen."""
    label = "case when id % 15000 = 7 then 1 when id % 9 = 0 then 1 else 0 end"
    pairs = spark.range(300_000).selectExpr("concat('S1-', id) s1_id", "concat('S2-', id) target_id", f"{label} label", "double(id % 15000 = 7) a", "double(id % 3) b")
    assert pairs.where("a = 1").count() == 20
    prob = {(r.a, r.b): r.prob for r in ML.predict(ML.fit(pairs, ["a", "b"], True, 30), pairs.select("a", "b").distinct(), ["a", "b"]).collect()}
    assert min(p for (a, _), p in prob.items() if a == 1) > max(p for (a, _), p in prob.items() if a == 0)


def test_trees_of_many_tasks_are_those_of_one(spark, monkeypatch):
    """Bounds are the quantiles of all rows, and histograms of the tasks add up."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.random(6000), (rng.random(6000) ** 3 * 400).round(), rng.integers(0, 5, 6000), rng.integers(0, 2, 6000), np.ones(6000)])
    y = (x[:, 0] + x[:, 3] * (x[:, 1] > 50) + x[:, 2] / 8 > 1).astype(int)
    rows = spark.createDataFrame([(f"S1-{i}", f"S2-{i}", int(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "s1_id string, target_id string, label int, a double, b double, c double, d double, e double")
    cuts = BO.cuts_of(rows, list("abcde"))
    assert all(np.array_equal(c, BO.bounds_of(x[:, j])) for j, c in enumerate(cuts)) and [len(c) for c in cuts[2:]] == [4, 1, 0]
    monkeypatch.setattr(BO, "TASK_ROWS", 1500)
    model = ML.fit(rows, list("abcde"), True, 40)
    alone = BO.boosted(x, y.astype(float), np.where(y == 1, 3000 / y.sum(), 3000 / (6000 - y.sum())), list("abcde"), 40)
    assert len(model.trees) == 40 and np.allclose(model.probability(x), alone.probability(x), atol=1e-6)
    walked = model.base + sum(t(x) for t in model.trees)
    assert np.allclose(model.probability(x), 1 / (1 + np.exp(-walked)))
    given = {r.a: r.prob for r in ML.predict(model, rows, list("abcde")).collect()}
    assert np.allclose([given[v] for v in x[:, 0]], model.probability(x))


def test_a_session(spark, tmp_path):
    head = "\t".join(IO.RECORD.names)
    (tmp_path / "train").mkdir()
    firms = ["Acme Bakery", "Blue River Hotel", "Cobalt Mining", "Delta Farms"]
    lines(tmp_path / "train/train_source1.tsv", head, *(f"S1-{k}\t{n}\t{k} Main Street\tUS" for k, n in enumerate(firms)))
    lines(tmp_path / "train/train_source2.tsv", head, *(f"S2-{k}\t{n.upper()} Ltd\t{k} Main St\tUS" for k, n in enumerate(firms[:3])))
    lines(tmp_path / "train/train_source3.tsv", head, "S3-9\tDelta Fish\t77 Harbour Road\tUS")
    lines(tmp_path / "train/train_ground_truth.tsv", "\t".join(IO.TRUTH.names), *(f"S1-{k}\tS2-{k}" for k in range(3)), "S1-3\t")
    s = SE.Session(spark)
    with pytest.raises(ValueError):
        s.register("source1", "x.csv")
    with pytest.raises(ValueError):
        s.load_preset(str(tmp_path), "dev")
    assert all(r["valid"] for r in s.load_preset(str(tmp_path), "train").values())
    assert [(r.source, r.status, r.n_rows) for r in s.summary().collect()] == [("source1", "valid", 4), ("source2", "valid", 3), ("source3", "valid", 1), ("ground_truth", "valid", 4)]
    assert [r.entity_id for r in s.preview("source2").collect()] == ["S2-0", "S2-1", "S2-2"]
    n = s.run()
    assert s.status == "done" and n["s1_processed"] == 4 and n["confirmed_matches"] >= 3
    matched = {r.s1_id: r.matched_ids for r in s.reviewed().collect()}
    assert all(matched[f"S1-{k}"] == f"S2-{k}" for k in range(3))
    assert s.decide("S1-0", "S2-0", "reject") == [("S1-0", "S2-0", "reject", 0)]
    assert {r.s1_id: r.status for r in s.reviewed().collect()}["S1-0"] == "singleton"
    assert s.rethreshold(1.1)["confirmed_matches"] == 0 and s.audit == []
    s.rethreshold(0.0)
    s.export(tmp_path / "out.zip", {"notes.md": "x"})
    with zipfile.ZipFile(tmp_path / "out.zip") as z:
        assert set(z.namelist()) == {"notes.md", "output/matching_results.tsv", "output/candidate_pairs.tsv"}
        assert z.read("output/matching_results.tsv").decode().startswith("source1_entity_id\tmatched_entity_ids\nS1-0\tS2-0")
    assert [r.entity_id for r in SE.searched(s.source("source1"), "HOTEL").collect()] == ["S1-1"]
    assert [r.entity_id for r in SE.searched(s.source("source1"), "main", "business_name", True).collect()] == ["S1-3", "S1-2", "S1-1", "S1-0"]
    s.status = "running"
    with pytest.raises(RuntimeError):
        s.run()
