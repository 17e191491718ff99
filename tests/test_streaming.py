from tessera.plans import fixture as FX
from tessera.plans import pipeline as PL
from tessera.streaming import files


def test_stream_equals_batch(spark, tmp_path):
    e = FX.entities(spark, "/root/testdata/sf0.001").where("ordinal % 1000000000000 < 60")
    s1, targets = FX.split(e)
    preset = PL.PRESETS["modular"]
    model, threshold = PL.train(s1, targets, FX.truth(e), preset)
    columns = ["entity_id", "business_name", "business_address", "country"]
    targets.select(columns).coalesce(1).write.option("sep", "\t").option("quote", "").option("header", True).csv(f"{tmp_path}/in")
    files.link_stream(files.stream(spark, f"{tmp_path}/in"), s1, model, threshold, preset, lambda p, n: p.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/check").awaitTermination(240)
    want = PL.link(s1, targets, model, threshold, preset)[0]
    key = lambda d: sorted((r.s1_id, r.target_id, round(r.prob, 9)) for r in d.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(want)
