"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. A document is good, malformed or offensive;
expectation-maximisation over the counts of the vote patterns estimates how frequent each of the three is and how often each rule
votes bad on each, so a rule that errs loses its weight and a verdict is the posterior probability of good, not the absence of bad
votes. An abstention says nothing. It starts from beliefs (``BELIEF``, ``SHARE``) that weigh no more than ``PRIOR`` votes. A
labelled document counts for the class of its label; that tells the classes apart where the rules alone could not, and so
unlabelled ones together weigh at most ``UNLABELLED`` of it. Its own verdict comes from its votes like any other.
The counts cover all documents; what reaches the driver is one row for each vote pattern and label, at most
``4 * 3 ** len(RULES)`` of them whatever the corpus holds. A hard floor (too few words, or too many of
them in repeated windows) rejects before any vote.

One rule needs beginnings of words that give toxic texts away (beginnings, as words are inflected).
They are learnt as a decision list from labelled rows: of the beginnings that occur almost only in
toxic texts, or that at least two or three different words of a text share only there, the one that
explains most texts comes first, then the one that explains most of the rest, until one explains too
few. The sample is bounded by ``LABELLED`` rows, of which ``LEARNT`` in five teach the beginnings; there the rule counts as
abstaining, and its accuracy is estimated from the rest. The rule then reads
every whole text. Without labels, or with too few of them to learn from, it abstains.

Nulls and edge cases: a null or empty text has no words and is rejected by the floor; a posterior of exactly 0.5 is kept; rows with
null or repeated ids are judged each on their own; an empty table gives an empty result; columns
with clashing names are ignored, or passed through by ``filtered``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import ALNUM, cut, held, sliced, table
from tessera.llm.decontamination import words

WINDOW = 8
#: Labelled rows that toxic stems are learnt from; the least share of a stem's labelled texts that are
#: toxic; the least share and number of toxic texts that a further stem must explain; its characters; the most
#: words of a text that it is asked to begin.
LABELLED, PRECISION, GAIN, SUPPORT, SHORTEST, LONGEST, TIMES = 50_000, 0.98, 0.01, 5, 4, 12, 3
#: Of five labelled rows, those that stems are learnt from.
LEARNT = 4
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bars", "n_unique", "n_lines", "n_toxic"]
SYMBOLS = b"#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of consecutive words found more than once in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h *= _BASE
        h += ids[k : k + n]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.zeros(n, bool)
    starts[order[1:][same]] = starts[order[:-1][same]] = True
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + window] -= 1
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def counts(text: str, toxic: dict[int, dict[bytes, int]] | None = None) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    wide = sum(map(len, words)) - (len(raw) - len(text))  # bytes that only continue a character stand in words
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    bad = 0
    if toxic:
        alnum = set(raw.translate(ALNUM).split())
        for n, stems in toxic.items():
            met = Counter(b for b in [w[:n] for w in alnum] if b in stems)
            bad += sum(met[b] >= stems[b] for b in met)
    return len(words), wide, symbols, dup, repeated_words(words), upper, raw.count(b"|"), len(set(words)), lines, bad


_UPPER = bytes(range(0x41, 0x5B))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The table of labels, or None where the folder has none."""
    try:
        return table(spark, sf_dir, "labels")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def sampled(labelled: DataFrame) -> DataFrame:
    """(doc_id, label, learnt, toxic): about ``LABELLED`` rows of ``labelled (doc_id, toxic[, quality])``, one for each id.

    label is 0 for good, 1 for malformed, 2 for toxic, null where neither column tells; learnt rows teach the stems.
    """
    quality = F.min("quality") if "quality" in labelled.columns else F.lit(None).cast("int")
    marks = labelled.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"), quality.alias("quality"))
    share = min(1.0, LABELLED / max(1, marks.count()))
    if share < 1:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    label = F.when(F.col("quality") == 0, 1).when(F.col("toxic") == 1, 2).when((F.col("quality") == 1), 0)
    return cut(marks.select("doc_id", label.alias("label"), (F.pmod(F.xxhash64("doc_id", F.lit("learnt")), F.lit(5)) < LEARNT).alias("learnt"), "toxic"))


def toxic_stems(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """The decision list of toxic beginnings of words and of how many words begin so, from the rows of ``marks (doc_id, toxic)``."""
    told = marks.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    # about LABELLED rows of 12 bytes
    seen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(F.broadcast(told), "id")
    seen = cut(seen.groupBy(F.xxhash64("t").alias("text")).agg(F.max("toxic").alias("toxic"), F.first(F.array_distinct(words(F.col("t")))).alias("w")))
    least = max(SUPPORT, GAIN * seen.where("toxic = 1").count())

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for text, toxic, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                met = Counter(w[:k] for w in found for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
                rows = [(text, toxic, stem, times) for stem, c in met.items() for times in range(1, min(c, TIMES) + 1)]
                if rows:
                    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["text", "toxic", "stem", "times"])

    def each(rows: DataFrame) -> DataFrame:
        return rows.select("text", F.col("toxic").cast("int"), "w").mapInArrow(begin, "text long, toxic int, stem string, times int")

    # a text's stems are counted where it stands; only sums by stem are shuffled
    tells = each(seen).groupBy("stem", "times").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where((F.col("bad") >= least) & (F.col("bad") >= PRECISION * F.col("n")))
    # toxic texts of the sample only, with the stems that tell: a text names at most LONGEST - SHORTEST + 1 for each of its words
    left = [{(x["stem"], x["times"]) for x in r["told"]} for r in each(seen.where("toxic = 1")).join(tells, ["stem", "times"]).groupBy("text").agg(F.collect_set(F.struct("stem", "times")).alias("told")).collect()]
    found = []
    while left:
        best, gain = min(Counter(x for told in left for x in told).items(), key=lambda x: (-x[1], x[0]))
        if gain < least:
            break
        found.append(best)
        left = [told for told in left if best not in told]
    return found


def measured(rows: DataFrame, toxic: list[tuple[str, int]] = (), text: Callable[[pa.RecordBatch], pa.Array] = lambda b: b.column("t"), names: list[str] | None = None) -> DataFrame:
    """``rows`` with COUNTS of every whole text, which ``text`` takes from a batch; ``names`` are the columns that stay, all by default."""
    stems = [(w.encode(), times) for w, times in toxic]
    bad = {n: {w: times for w, times in reversed(stems) if len(w) == n} for n in {len(w) for w, _ in stems}}
    names = rows.columns if names is None else names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        for b in sliced(batches):
            columns = zip(*[counts(t or "", bad) for t in text(b).to_pylist()], strict=True)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(c, pa.int64()) for c in columns)], [*names, *COUNTS])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


#: The rules. Their bounds are the usual ones of public rule sets for web text.
RULES = ["symbols", "repeats", "lines", "word_length", "capitals", "tables", "variety", "toxicity"]


#: The classes good, malformed and offensive: shares, and rates of bad votes of each rule, that are believed at first; the
#: votes that such a belief weighs.
SHARE = np.array([0.85, 0.1, 0.05])
BELIEF = np.array([[0.02] * 8, [0.3] * 7 + [0.05], [0.02] * 7 + [0.9]])
PRIOR = 5.0
#: Weight of all unlabelled documents together, at most, in that of the labelled ones, if there are any.
UNLABELLED = 0.5


def votes_of(toxicity: bool) -> dict[str, Column]:
    """Rule to vote. A function, as columns need a session and workers import this module."""
    return {
        "symbols": vote(ratio("n_symbols", "n_words") < 0.02, ratio("n_symbols", "n_words") > 0.1),
        "repeats": vote(ratio("n_repeat_words", "n_words") < 0.1, ratio("n_repeat_words", "n_words") > 0.2),
        "lines": vote(ratio("n_dup_lines", "n_lines") < 0.1, (F.col("n_dup_lines") >= 3) & (ratio("n_dup_lines", "n_lines") > 0.3)),
        "word_length": vote(ratio("word_chars", "n_words").between(3, 10), ~ratio("word_chars", "n_words").between(2, 14)),
        "capitals": vote(ratio("n_upper", "word_chars") < 0.1, ratio("n_upper", "word_chars") > 0.3),
        "toxicity": vote(F.col("n_toxic") == 0, F.col("n_toxic") > 0) if toxicity else F.lit(0),
        "tables": vote(ratio("n_bars", "n_words") < 0.02, ratio("n_bars", "n_words") > 0.1),
        "variety": vote(
            (F.col("n_words") >= 20) & (ratio("n_unique", "n_words") > 0.3),
            (F.col("n_words") >= 20) & (F.col("n_words") <= 2000) & (ratio("n_unique", "n_words") < 0.1),
        ),
    }


def floor() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def fitted(votes: np.ndarray, weight: np.ndarray, label: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probability of good for each vote pattern, by expectation-maximisation, and the rates of bad votes by class and rule.

    Patterns (rows of -1, 0, 1) come with their counts and labels: a class, or -1 for none. The first estimate is that of
    the beliefs and the labelled rows alone.
    """
    bad, good = (votes < 0).astype(float), (votes > 0).astype(float)
    known = (label >= 0)[:, None]
    told = (label[:, None] == np.arange(len(SHARE))).astype(float)
    if known.any():  # else the many would soon drown what the labels say
        mass = weight[~known[:, 0]].sum()
        weight = np.where(known[:, 0], weight, weight * min(1.0, UNLABELLED * (weight.sum() - mass) / max(mass, 1.0)))
    post = np.zeros((len(votes), len(SHARE)))
    for _ in range(rounds):
        w = weight[:, None] * np.where(known, told, post)
        n_bad, n_good = w.T @ bad, w.T @ good
        rate = (n_bad + PRIOR * BELIEF) / (n_bad + n_good + PRIOR)
        share = (w.sum(axis=0) + PRIOR * SHARE) / (w.sum() + PRIOR)
        log = np.log(share) + bad @ np.log(rate).T + good @ np.log(1 - rate).T
        new = np.exp(log - log.max(axis=1, keepdims=True, initial=-1e300))
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post[:, 0], rate


def posteriors(seen: DataFrame, marks: DataFrame | None) -> DataFrame:
    """(votes, posterior) of the vote patterns in ``seen (id, base_failed, votes)``: at most 3 ** len(RULES) rows."""
    spark, names = seen.sparkSession, [f"v_{n}" for n in RULES]
    both = seen.where("not base_failed").select("id", *names)
    if marks is None:
        both = both.withColumn("label", F.lit(-1))
    else:
        # about LABELLED rows of 13 bytes
        both = both.join(F.broadcast(marks.where("label is not null").select(F.col("doc_id").alias("id"), "label", "learnt")), "id", "left")
        both = both.withColumns({"v_toxicity": F.when(F.coalesce("learnt", F.lit(False)), 0).otherwise(F.col("v_toxicity")), "label": F.coalesce("label", F.lit(-1))})
    told = both.groupBy(*names, "label").agg(F.count("*").alias("n")).orderBy(*names, "label").collect()
    met = [tuple(r[n] for n in names) for r in told]
    # a pattern may stand only with the vote that learnt rows lose
    every = sorted({*met, *((*m[: (i := RULES.index("toxicity"))], v, *m[i + 1 :]) for m in met for v in (-1, 0, 1))})
    votes = np.array([*met, *every], int).reshape(-1, len(names))
    weight, label = (np.array([r[c] for r in told] + [d] * len(every), int) for c, d in (("n", 0), ("label", -1)))
    good, _ = fitted(votes, weight.astype(float), label)
    rows = [(*map(int, v), float(g)) for v, g in zip(every, good[len(met) :], strict=True)]
    return F.broadcast(spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", posterior double"))


def voted(rows: DataFrame, toxic: list[tuple[str, int]], **kwargs) -> DataFrame:
    """``measured`` with the floor's verdict and the votes."""
    return measured(rows, toxic, **kwargs).select("*", floor().alias("base_failed"), *(v.cast("int").alias(f"v_{n}") for n, v in votes_of(bool(toxic)).items()))


def learnt(docs: DataFrame, labelled: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame | None, list[tuple[str, int]]]:
    """The sample of labelled rows and the toxic stems that its learnt rows teach."""
    if labelled is None:
        return None, []
    marks = sampled(labelled)
    return marks, toxic_stems(docs, marks.where("learnt"), id_col, text_col)


def judged(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *COUNTS, base_failed, posterior, kept) for every row."""
    marks, toxic = learnt(docs, labelled, id_col, text_col)
    seen = cut(voted(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), toxic, names=["id"]))
    both = seen.join(posteriors(seen, marks), [f"v_{n}" for n in RULES], "left")
    return both.select("id", *COUNTS, "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"))


def filtered(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, each judged by its own text: read once for the patterns and once more for the verdict."""
    marks, toxic = learnt(docs, labelled)
    known = posteriors(voted(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t")), toxic, names=["id"]), marks)
    place = docs.columns.index("text")
    seen = voted(docs.select(F.struct(*docs.columns).alias("row")), toxic, text=lambda b: b.column("row").field(place))
    return seen.where("not base_failed").join(known, [f"v_{n}" for n in RULES]).where("posterior >= 0.5").select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), labels(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), *COUNTS[:5], "base_failed", "kept", "posterior")


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLE_SQL: dict[str, str] = {}
