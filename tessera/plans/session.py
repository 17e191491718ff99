"""An interactive linkage session: registered sources, a run, its review and what is handed over.

The session holds paths, reports and tables; records stay in Spark. What a user looks at (previews, summaries, counts) is
a small DataFrame or a dictionary.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import resolve as R
from tessera.operators import validate as Q
from tessera.plans import pipeline as PL
from tessera.sources import records as IO
from tessera.sources.stage import staged

#: Source to the prefix of its ids.
SOURCES = {"source1": "S1-", "source2": "S2-", "source3": "S3-", "ground_truth": ""}
#: Rows of a preview and of the last decisions that are shown.
PREVIEW, SHOWN = 20, 10


@dataclass(frozen=True)
class Run:
    """What a run may take: S1 records, candidates of each, and the threshold where there is no truth to tune one on."""

    max_s1_records: int | None = 20_000
    candidate_cap: int = 20
    confidence_threshold: float = 0.75


def preview(df: DataFrame, n: int = PREVIEW) -> DataFrame:
    """The first ``n`` rows, by ordinal if there is one."""
    return (df.orderBy("ordinal") if "ordinal" in df.columns else df).limit(n)


def searched(df: DataFrame, text: str = "", by: str | None = None, descending: bool = False) -> DataFrame:
    """Rows of which some column holds ``text``, whatever the case, sorted by one column."""
    if text:
        hit = F.lit(False)
        for c in df.columns:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower()))
        df = df.where(hit)
    return df if by is None else df.orderBy(F.desc(by) if descending else F.asc(by))


@dataclass
class Session:
    spark: SparkSession
    paths: dict[str, str] = field(default_factory=dict)
    reports: dict[str, dict] = field(default_factory=dict)
    preset_name: str | None = None
    status: str = "idle"
    metrics: dict = field(default_factory=dict)
    records: DataFrame | None = None
    pairs: DataFrame | None = None
    threshold: float = 0.75
    audit: list[tuple[str, str, str, int]] = field(default_factory=list)

    def register(self, key: str, path: str) -> dict:
        """Checks a tab-separated file and keeps it as a source, valid or not; the report says which."""
        if key not in SOURCES:
            raise ValueError(f"no source {key}")
        if not path.endswith((".tsv", ".txt")):
            raise ValueError("a source is a .tsv or .txt file")
        columns = (IO.TRUTH if key == "ground_truth" else IO.RECORD).names
        self.reports[key] = Q.source_report(self.spark, path, columns, SOURCES[key]).first().asDict()
        self.paths[key] = path
        return self.reports[key]

    def load_preset(self, folder: str, split: str) -> dict[str, dict]:
        """Registers the files ``{split}_{source}.tsv`` of ``folder/{split}``; a truth only where the split is ``train``."""
        if split not in ("train", "test"):
            raise ValueError("a split is train or test")
        self.paths.clear()
        self.reports.clear()
        for key in SOURCES:
            if key != "ground_truth" or split == "train":
                report = self.register(key, f"{folder}/{split}/{split}_{key}.tsv")
                if "file not found" in report["errors"]:
                    del self.paths[key], self.reports[key]
        self.preset_name = split
        return dict(self.reports)

    def summary(self) -> DataFrame:
        """(source, path, status, n_rows, countries): a row for each source."""
        rows = []
        for key in SOURCES:
            report = self.reports.get(key)
            status = "none" if report is None else "valid" if report["valid"] else "invalid"
            rows.append((key, self.paths.get(key), status, report["n_rows"] if report else 0, dict(report["country_counts"]) if report else {}))
        return self.spark.createDataFrame(rows, "source string, path string, status string, n_rows long, countries map<string,long>")

    def source(self, key: str) -> DataFrame:
        if key not in SOURCES:
            raise ValueError(f"no source {key}")
        if key == "ground_truth":
            return IO.read_tsv(self.spark, self.paths[key], IO.TRUTH)
        return IO.with_ordinal(IO.read_tsv(self.spark, self.paths[key]))

    def preview(self, key: str) -> DataFrame:
        return preview(self.source(key))

    def run(self, config: Run = Run(), preset: PL.Preset = PL.PRESETS["modular"]) -> dict:  # noqa: B008
        """Links the first S1 records; the counters of the run."""
        if self.status == "running":
            raise RuntimeError("a run is under way")
        self.status = "running"
        try:
            s1 = IO.select_rows(self.source("source1"), first=config.max_s1_records)
            targets = IO.union_sources(*(self.source(k) for k in ("source2", "source3") if k in self.paths))
            return self.linked(s1, targets, IO.truth_pairs(self.source("ground_truth")) if "ground_truth" in self.paths else None, config, preset)
        except Exception:
            self.status = "error"
            raise

    def linked(self, s1: DataFrame, targets: DataFrame, truth: DataFrame | None, config: Run, preset: PL.Preset) -> dict:
        preset = PL.Preset(**{**preset.__dict__, "top": config.candidate_cap})
        model, self.threshold = None, config.confidence_threshold
        if truth is not None:
            model, self.threshold = PL.train(s1, targets, truth, preset, config.confidence_threshold)
        self.pairs = PL.link(s1, targets, model, self.threshold, preset)[0]
        self.records, self.audit = staged(s1), []
        self.status = "done"
        return self.counted()

    def counted(self) -> dict:
        n = R.overview(self.reviewed(), self.pairs).first()
        self.metrics = {**n.asDict(), "threshold": self.threshold, "status": self.status}
        return self.metrics

    def decisions(self) -> DataFrame:
        """All decisions, the last of a pair being the one that counts."""
        return self.spark.createDataFrame(self.audit, "s1_id string, target_id string, action string, seq int")

    def reviewed(self) -> DataFrame:
        """A record for each S1 id with its matches after the decisions, its status and its candidates, best first."""
        return R.review_records(self.records, R.decided(self.pairs, self.decisions(), self.threshold))

    def rethreshold(self, threshold: float) -> dict:
        """Matches at another threshold, without another run; decisions go."""
        self.threshold, self.audit = threshold, []
        return self.counted()

    def decide(self, s1_id: str, target_id: str, action: str) -> list[tuple[str, str, str, int]]:
        """Accepts a pair, or rejects it with any other action; the last decisions."""
        self.audit.append((s1_id, target_id, action, len(self.audit)))
        return self.audit[-SHOWN:]

    def export(self, path: str, documents: dict[str, str] | None = None) -> None:
        """A zip of both result files and ``documents``; for results that fit a file on the driver, as a review does."""
        order = [F.col("rank")]
        own = R.decided(self.pairs, self.decisions(), self.threshold)
        both = IO.as_lists(self.records, own.where("is_match"), order), IO.as_lists(self.records, own, order, "candidate_entity_ids")
        files = dict(documents or {})
        for name, lists in zip(("output/matching_results.tsv", "output/candidate_pairs.tsv"), both, strict=True):
            a, b = lists.columns[:2]
            rows = lists.orderBy("ordinal").select(F.concat_ws("\t", a, b).alias("line")).toLocalIterator()
            files[name] = "\n".join([f"{a}\t{b}", *(r["line"] for r in rows)]) + "\n"
        IO.write_zip(files, os.fspath(path))
