import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm import warc


def test_audit_finds_exactly_the_damage(spark):
    rows = [(i, f"http://h/{i}", "é" * (i % 70) + f"page {i}") for i in range(700)] + [(None, None, None), (5, "http://h/5", "again"), (5, "http://h/5", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    own = warc.records(pages, 3)
    by_file = defaultdict(list)
    for r in own.collect():
        by_file[r.file].append(r)
    assert sum(map(len, by_file.values())) == 703
    for part in by_file.values():
        at = 0
        for r in sorted(part, key=lambda r: r.seq):
            assert r.offset == at
            at += r.length
    first = next(r for p in by_file.values() for r in p if r.id == 7)
    body = "é" * 7 + "page 7"
    raw = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://h/7\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode()
    assert (first.length, first.digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    rotten = pages.withColumn("html", F.when(F.col("page_id").isin(70, 350), F.concat(F.lit("X"), F.substring("html", 2, 9999))).otherwise(F.col("html")))
    found = warc.audited(own, warc.records(rotten, 3)).collect()
    place = {(r.file, r.seq): r.id for p in by_file.values() for r in p}
    assert {(place[r.file, r.seq], r.kind) for r in found} == {(70, "damaged"), (350, "damaged")}
    assert all(r.compared < 150 for r in found)
    last = max(r.seq for r in by_file[0])
    gone = own.where(~((F.col("file") == 0) & (F.col("seq") == int(last))))
    assert [(r.file, r.seq, r.kind) for r in warc.audited(own, gone).collect()] == [(0, last, "missing")]
    assert [(r.kind) for r in warc.audited(gone, own).collect()] == ["surplus"]
    assert warc.audited(own, own).count() == 0


def test_records_that_shift_others_are_found_alone(spark):
    rows = [(i, f"http://h/{i}", "é" * (i % 70) + f"page {i}") for i in range(700)] + [(None, None, None), (5, "http://h/5", "again"), (5, "http://h/5", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    own = warc.records(pages, 3).cache()
    rotten = pages.withColumn("html", F.when(F.col("page_id").isin(3, 400), F.concat(F.lit("X"), F.substring("html", 2, 9999))).otherwise(F.col("html")))
    extra = spark.createDataFrame([(-50, "u", "new"), (5, "http://h/5", "again")], pages.schema)
    other = warc.records(rotten.where("page_id is null or page_id not in (10, 333)").union(extra), 3).cache()
    ours, theirs = ({(r.file, r.seq): r.id for r in d.collect()} for d in (own, other))
    got = sorted(((theirs if r.kind == "surplus" else ours)[r.file, r.seq], r.kind) for r in warc.audited(own, other).collect())
    assert got == [(-50, "surplus"), (3, "damaged"), (5, "surplus"), (10, "missing"), (333, "missing"), (400, "damaged")]
    back = sorted(((ours if r.kind == "surplus" else theirs)[r.file, r.seq], r.kind) for r in warc.audited(other, own).collect())
    assert back == [(-50, "missing"), (3, "damaged"), (5, "missing"), (10, "surplus"), (333, "surplus"), (400, "damaged")]


def test_equals_brute_force(spark):
    rng = random.Random(6)
    url = lambda i: f"http://h/{i % 40}"
    rows = [(rng.choice([None, *range(300)]), url(rng.randrange(300)), rng.choice(["", None, "long " * 5000, f"body {rng.randrange(50)}"]), "x") for _ in range(500)]
    rows += [(1, "same", "same", "x")] * 90
    other = [r for r in rows if rng.random() > 0.05]
    other = [(i, u, f"rotten {rng.random()}", x) if rng.random() < 0.05 else (i, u, t, x) for i, u, t, x in other]
    other += [(rng.choice([None, 7, 900 + k]), url(k), f"new {k}", "x") for k in range(20)]
    a, b = (warc.records(spark.createDataFrame(r, "page_id long, url string, html string, seq string"), 2).cache() for r in (rows, other))
    name = lambda r: (r[0], r[1] or "", r[2] or "")
    mine, theirs = Counter(map(name, rows)) - Counter(map(name, other)), Counter(map(name, other)) - Counter(map(name, rows))
    want = Counter()
    x, y = Counter(n[0] for n in mine.elements()), Counter(n[0] for n in theirs.elements())
    for i in {*x, *y}:
        both = min(x[i], y[i])
        want += Counter({(i, "damaged"): both, (i, "missing"): x[i] - both, (i, "surplus"): y[i] - both})
    ours, others = ({(r.file, r.seq): r.id for r in d.collect()} for d in (a, b))
    assert len(ours) == len(rows) and len(others) == len(other)
    assert Counter(((others if r.kind == "surplus" else ours)[r.file, r.seq], r.kind) for r in warc.audited(a, b).collect()) == want


def test_a_file_that_a_replica_lacks(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "t") for i in range(50)], "page_id long, url string, html string")
    own = warc.records(pages, 4).cache()
    left = own.where("file <> 2")
    assert {(r.file, r.kind) for r in warc.audited(own, left).collect()} == {(2, "missing")}
    assert warc.audited(own, left).count() == own.where("file = 2").count() == warc.audited(left, own).where("kind = 'surplus'").count()


def test_only_mismatching_branches_are_descended():
    parts = [bytes([k]) * 32 for k in range(256)]
    nodes = b"".join(parts) + bytes(16 * 32) + bytes(32)
    other = b"".join(p if k != 37 else b"x" * 32 for k, p in enumerate(parts)) + b"".join(bytes(32) if k != 2 else b"y" * 32 for k in range(16)) + b"z" * 32
    assert warc.descended(nodes, nodes) == ([], 1)
    assert warc.descended(nodes, other) == ([37], 33)
    assert warc.descended(nodes, None) == (list(range(256)), 1 + 16 + 256)


def test_empty_table(spark):
    empty = warc.records(spark.createDataFrame([], "page_id long, url string, html string"), 2)
    assert warc.audited(empty, empty).count() == 0
