import itertools
import re

import numpy as np

import corpus_pipeline
from tests.llm import test_packing, test_quality, test_simhash, test_suffixes


def test_stages_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a, b in itertools.product("ka lo mi ne pu ra so ti".split(), repeat=2)] + [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    item, passage = text(30), text(60)
    texts = [text(120) for _ in range(40)]
    texts += [texts[0], texts[1] + " extra", texts[2].replace(texts[2].split()[60], "other"), None, "", "a b c", "x y z u v w s t " * 9]
    texts += [text(80) + " " + passage + " " + text(80) for _ in range(4)] + [text(40) + " " + item, item + " " + text(60)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, frame = dict(enumerate(texts)), spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name.startswith("quality"):
            kept = {i: t for i, t in kept.items() if (c := test_quality.brute(t))[0] >= 20 and 100 * c[4] <= 30 * c[0]}
        elif name.startswith("simhash"):
            kept = {i: t for i, t in kept.items() if test_simhash.near(list(kept.items()))[i] == i}
        elif name.startswith("suffix"):
            left = test_suffixes.brute(list(kept.values()), 200)
            kept = {i: w[3].decode(errors="ignore") for i, w in zip(kept, left, strict=True) if w[3]}
        else:
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
            grams = {tuple(words(item)[k : k + 13]) for k in range(18)}
            for i, t in list(kept.items()):
                w = words(t)
                hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in grams for p in range(k, k + 13)}
                if hit and 20 * len(hit) >= len(w):
                    del kept[i]
        assert {r.doc_id: r.text for r in frame.collect()} == kept, name
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = test_packing.encoder(test_packing.PATH)
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    assert {i: sum(r.length for r in rows if r.doc_id == i) for i in want} == want and {r.doc_id for r in rows} == set(want)


def written(spark, folder, docs, columns):
    spark.createDataFrame(docs, columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_null_and_repeated_ids_and_clashing_columns(spark, tmp_path):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(rng.choice([f"w{k}" for k in range(600)], n))
    a, b, c, d = (text(70) for _ in range(4))
    rows = [(None, a, 1), (None, b, 2), (5, c, 3), (5, c, 3), (5, d, 4), (6, None, 5), (6, "", 6), (7, "short", 7)]
    docs = [(i, t, "en", "s", len(t or ""), k, 0, "x", "y", 0, 0.5) for i, t, k in rows]
    written(spark, tmp_path, docs, "doc_id long, text string, lang string, source string, n_chars long, row int, key int, component string, found string, at int, posterior double")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = frame.columns
    for _, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == columns
        assert sorted(r.row for r in frame.collect()) in ([1, 2, 3, 3, 4], [1, 2, 3, 4])
    assert sorted((r.row, r.text) for r in frame.collect()) == [(1, a), (2, b), (3, c), (4, d)]


def test_empty_tables(spark, tmp_path):
    written(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
