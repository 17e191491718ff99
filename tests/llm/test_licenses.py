import random
import re

from tessera.llm import licenses


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for p, label in licenses.PHRASES.items() for q in [p.split()] for i in range(len(w)) if w[i : i + len(q)] == q]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_against_brute_force(spark):
    texts = [
        "Released under the MIT License.", "mit-LICENSE mit license, apache\nlicense", "GNU General Public License v3 general public, license", None, "",
        "Licensed under CC BY-NC 4.0.", "the mit of license", "é MIT Licensé mit license", "word " * 50_000 + "Apache License, Version 2.0",
        "Redistribution and use in source and binary forms, with or without modification, are permitted", "licensed under the moon",
    ]
    docs = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)] + [(None, "mit license", "l"), (0, texts[0], "l")], "doc_id long, text string, labels string")
    rows = licenses.scanned(docs).collect()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute("mit license" if r.id is None else texts[r.id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    got = {r.id: r.labels for r in rows}
    assert (got[5], got[9], got[10], got[8]) == ("cc-by-nc", "bsd", "", "apache")
    assert len(rows) == 13 and licenses.scanned(docs.limit(0)).count() == 0


def scan_all(words, index):
    """Labels and score by trying every template at every place."""
    labels, best = set(), 0.0
    for t in index.templates:
        for start in range(-len(t.words), len(words) + 1):
            at = lambda i: words[start + i] if 0 <= start + i < len(words) else None  # noqa: B023, E731
            if sum(at(i) == t.words[i] for i in t.anchors) < t.agree:
                continue
            slack = 0 if t.plain else licenses.SLACK
            if not all(any(words[k : k + len(key)] == key for k in range(max(0, start + i - slack), start + i + slack + 1)) for i, key in t.keys):
                continue
            share = sum(w for i, w in enumerate(t.weight) if at(i) == t.words[i]) / sum(t.weight)
            if share >= licenses.ENOUGH:
                labels.add(t.label)
                best = max(best, share)
    return ",".join(sorted(labels)), min(best, 1.0)


def test_labels_and_score_equal_every_template_at_every_place():
    rng = random.Random(5)
    index = licenses.Index({w: 1 + rng.random() * 5 for _, t, _ in licenses.NOTICES for w in licenses.normal(t)})
    texts = [t for _, t, _ in licenses.NOTICES]
    for _ in range(150):
        words = []
        for t in rng.sample(texts, rng.randint(1, 3)):
            own = licenses.normal(t)
            k = rng.randrange(len(own))
            edit = rng.choice(["none", "cut", "add", "change", "head"])
            own = {"none": own, "cut": own[:k] + own[k + 1 :], "add": own[:k] + [b"new"] * rng.randint(1, 15) + own[k:], "change": own[:k] + [b"other"] + own[k + 1 :], "head": own[k:]}[edit]
            words += [b"filler", b"software"][: rng.randint(0, 2)] + own
        want = scan_all(words, index)
        got = index.scan(words)
        assert got[4] == want[0] and abs(got[5] - want[1]) < 1e-9


def test_every_template_finds_itself_and_a_lone_anchor_nothing():
    index = licenses.Index({})
    for label, text, _ in licenses.NOTICES:
        assert label in index.scan(licenses.normal("Copyright 2020 A. Author. " + text + " Thank you."))[4].split(",")
    for t in index.templates[len(licenses.PHRASES) :]:
        lone = [b"x"] * (t.anchors[0] + 3) + [t.words[t.anchors[0]]] + [b"x"] * 300
        assert index.candidates(lone) == [] and index.scan(lone)[4] == ""


def test_templates_that_tie_give_all_their_labels():
    index = licenses.Index({})
    both = licenses.normal("licensed under CC BY 4.0 and licensed under CC BY-SA 4.0")
    n, _, _, _, labels, score = index.scan(both)
    assert (n, labels, score) == (0, "cc-by,cc-by-sa", 1.0)
