"""The daily run: gates, evidence, labels, ledger, and the report. Only small frames reach the driver."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators import evidence, ledger, quality
from causeway.plans import report
from causeway.sources.landed import as_of

REQUIRED_DIMENSIONS = ("trend", "volatility")


class GateError(RuntimeError):
    """A gate that stops the run."""


def eligible(observations: DataFrame, health: DataFrame, datasets: DataFrame) -> DataFrame:
    """Series whose dataset has an eligible provider. `datasets`: dataset, symbol; series without a dataset stay."""
    bad = health.groupBy("dataset").agg(F.bool_or("eligible").alias("ok")).where("not ok").join(datasets, "dataset").select("symbol").distinct()
    return observations.join(bad, "symbol", "left_anti")


def run(prices: DataFrame, macro: DataFrame, bars: DataFrame, session: str, health: DataFrame | None = None, datasets: DataFrame | None = None, gate_quality: bool = False) -> dict[str, Any]:
    """The report of one session. With `gate_quality`, quarantined bars are taken out before anything is computed."""
    if health is not None:
        if failed := [r["dataset"] for r in quality.required_failures(health).collect()]:
            raise GateError(f"required sources aren't available: {failed}")
        if datasets is not None:
            prices = eligible(prices, health, datasets)
    issues = quality.validate_bars(as_of(bars, session))
    if gate_quality:
        prices = quality.drop_quarantined(prices, issues)
    prices, macro = as_of(prices, session), as_of(macro, session)
    found = evidence.evidence(evidence.indicator_values(prices, macro))
    # A dozen rows: the catalogue bounds the evidence.
    indicators = [r.asDict() for r in found.collect()]
    have = {i["dimension"] for i in indicators if i["value"] is not None}
    if missing := [d for d in REQUIRED_DIMENSIONS if d not in have]:
        raise GateError(f"required dimensions are missing: {missing}")
    small = prices.sparkSession.createDataFrame(indicators, found.schema)
    labels = evidence.leaning(evidence.state_labels(small)).first().asDict()
    spy = prices.where("symbol = 'spy'")
    performance = [r.asDict() for r in ledger.performance(ledger.ledger_returns(ledger.benchmark_exposures(spy))).orderBy("strategy").collect()]
    worst = sorted((i for i in indicators if i["risk_rank"] is not None), key=lambda i: -i["risk_rank"])
    return report.build(
        data_status={"session": session, "issues": [r.asDict() for r in quality.issue_summary(issues).orderBy("severity", "code").collect()]},
        judgment={**labels, "supporting": report.capped([i["name"] for i in worst if i["direction"] == "deteriorating"]), "contrary": report.capped([i["name"] for i in worst[::-1] if i["direction"] == "easing"])},
        dimensions={"indicators": [{k: i[k] for k in ("name", "dimension", "value", "percentile", "direction")} for i in indicators], "contradictions": [r.asDict() for r in evidence.contradictions(small).collect()]},
        method={"ledger": performance},
    )
