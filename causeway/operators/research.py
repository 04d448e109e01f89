"""The research registry as rows: capabilities, one-rung promotions, outcomes, and what may influence a recommendation."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPABILITIES = ("data_quality", "risk_identification", "action_value")
LADDER = ("computed_correctly", "replayed_and_explainable", "frozen_shadow_output", "tested_on_new_data")
OUTCOMES = ("passed", "evidence_of_harm", "insufficient_evidence")
BENCHMARKS = ("no_new_defense", "fixed_low_exposure", "trailing_or_ewma_volatility_target", "fixed_long_term_trend_rule")
EVIDENCE_FIELDS = frozenset({"metric", "value", "benchmark", "window"})
SCHEMA = "name string, capability string, hypothesis string, primary_metric string, benchmarks array<string>, frozen_on string, family string, family_size int, grade string, outcome string, evidence array<map<string,string>>, notes array<string>"


@dataclass(frozen=True)
class Experiment:
    name: str
    capability: str
    hypothesis: str
    primary_metric: str
    benchmarks: tuple[str, ...] = BENCHMARKS
    frozen_on: str = ""
    family: str = ""
    family_size: int = 1
    grade: str = LADDER[0]
    outcome: str = OUTCOMES[2]
    evidence: tuple[dict[str, str], ...] = field(default=())
    notes: tuple[str, ...] = ()

    def __post_init__(self):
        for value, allowed in ((self.capability, CAPABILITIES), (self.grade, LADDER), (self.outcome, OUTCOMES)):
            if value not in allowed:
                raise ValueError(f"{self.name}: {value!r} is none of {allowed}")
        if not self.primary_metric or not set(BENCHMARKS) <= set(self.benchmarks):
            raise ValueError(f"{self.name}: a primary metric and every required benchmark are named beforehand")

    def promoted(self, grade: str, **evidence: str) -> Experiment:
        """One rung up; the last one needs data from after the freeze."""
        if grade not in LADDER or LADDER.index(grade) != LADDER.index(self.grade) + 1:
            raise ValueError(f"{self.name}: {self.grade} isn't followed by {grade}")
        if lacking := EVIDENCE_FIELDS - evidence.keys():
            raise ValueError(f"{self.name}: evidence lacks {sorted(lacking)}")
        if grade == LADDER[-1] and not evidence.get("data_after_freeze"):
            raise ValueError(f"{self.name}: data from after the freeze is needed")
        return replace(self, grade=grade, evidence=(*self.evidence, {"grade": grade, **{k: str(v) for k, v in evidence.items()}}))

    def concluded(self, outcome: str, note: str) -> Experiment:
        return replace(self, outcome=outcome, notes=(*self.notes, note))


def frame(spark: SparkSession, experiments: list[Experiment]) -> DataFrame:
    names = [e.name for e in experiments]
    if len(set(names)) < len(names):
        raise ValueError("names are unique and are never used again")
    rows = [tuple(list(v) if isinstance(v, tuple) else v for v in vars(e).values()) for e in experiments]
    return spark.createDataFrame(rows, SCHEMA)


def merged(kept: DataFrame, more: DataFrame) -> DataFrame:
    """Experiments of `more` whose name isn't taken join those that are kept; nothing is removed."""
    return kept.unionByName(more.join(kept.select("name"), "name", "left_anti"))


def may_influence():
    return (F.col("grade") == LADDER[-1]) & (F.col("outcome") == OUTCOMES[0])


def summary(experiments: DataFrame) -> DataFrame:
    """One row per capability, also for those without an experiment."""
    every = experiments.sparkSession.createDataFrame([(c,) for c in CAPABILITIES], "capability string")
    g = experiments.groupBy("capability").agg(
        F.count(F.lit(1)).alias("experiments"),
        F.array_join(F.array_sort(F.collect_set("grade")), ",").alias("grades"),
        F.array_join(F.array_sort(F.collect_set(F.when(may_influence(), F.col("name")))), ",").alias("may_influence"),
    )
    out = every.join(g, "capability", "left")
    return out.select("capability", F.coalesce("experiments", F.lit(0)).alias("experiments"), F.coalesce("grades", F.lit("")).alias("grades"), F.coalesce("may_influence", F.lit("")).alias("may_influence"))


def save(experiments: DataFrame, path: str) -> None:
    """As JSON records. Experiments are never removed: a store is written whole, from what was loaded and what was added."""
    experiments.write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A store that isn't there is empty."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(path)
