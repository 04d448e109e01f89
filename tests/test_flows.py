"""Registry gates, broker rows, the report and the daily run."""

import datetime as dt

import pytest

from causeway.operators import research
from causeway.plans import daily, inputs, report
from causeway.sources import quotes

SF = "/root/testdata/sf0.01"
EVIDENCE = {"metric": "m", "value": "1", "benchmark": "b", "window": "w"}


def test_promotion_goes_one_rung_at_a_time():
    e = research.Experiment("a", "action_value", "h", "drawdown")
    with pytest.raises(ValueError):
        e.promoted("frozen_shadow_output", **EVIDENCE)
    with pytest.raises(ValueError):
        e.promoted("replayed_and_explainable", metric="m")
    e = e.promoted("replayed_and_explainable", **EVIDENCE).promoted("frozen_shadow_output", **EVIDENCE)
    with pytest.raises(ValueError):
        e.promoted("tested_on_new_data", **EVIDENCE)
    assert e.promoted("tested_on_new_data", **EVIDENCE, data_after_freeze="yes").grade == "tested_on_new_data"


@pytest.mark.parametrize("wrong", [{"capability": "x"}, {"grade": "x"}, {"primary_metric": ""}, {"benchmarks": ("no_new_defense",)}])
def test_an_experiment_states_its_terms_beforehand(wrong):
    with pytest.raises(ValueError):
        research.Experiment(**{"name": "a", "capability": "action_value", "hypothesis": "h", "primary_metric": "m", **wrong})


def test_registry_keeps_what_it_has(spark):
    old = research.frame(spark, [research.Experiment("a", "action_value", "old", "m").concluded("evidence_of_harm", "n")])
    new = research.frame(spark, [research.Experiment("a", "action_value", "new", "m"), research.Experiment("b", "data_quality", "new", "m")])
    got = {r["name"]: r["hypothesis"] for r in research.merged(old, new).collect()}
    assert got == {"a": "old", "b": "new"}
    with pytest.raises(ValueError):
        research.frame(spark, [research.Experiment("a", "action_value", "h", "m")] * 2)


def test_quotes_read_their_own_side(spark):
    at = dt.datetime(2026, 9, 8, 12, 0, 30)
    rows = [(1, "P", 1.0, 2.0, -1.0, float("nan"), 50.0, 0.0, None, 1.0, 0.0, 1, at, dt.datetime(2026, 9, 8, 12, 0)), (2, "C", -1.0, None, 3.0, None, 0.0, 70.0, None, 0.0, 2.0, 2, at, dt.datetime(2026, 9, 8, 12, 0))]
    raw = spark.createDataFrame(rows, "con_id long, right string, bid double, ask double, last double, close double, put_open_interest double, call_open_interest double, open_interest double, put_volume double, call_volume double, data_type int, received_at timestamp, exchange_time timestamp")
    p, c = quotes.normalised(raw).orderBy("con_id").collect()
    assert (p["open_interest"], p["status"], p["quote_age_seconds"], p["last"], p["close"]) == (50.0, "complete", 30.0, None, None)
    assert (c["open_interest"], c["status"], c["quote_age_seconds"], c["tick_lag_seconds"], c["staleness_basis"]) == (70.0, "close_only", None, 30.0, "frozen_book_has_no_timestamp")


def test_report_has_all_sections_in_order_and_no_account_fields():
    r = report.build(judgment={"a": 1.5, "b": None}, dimensions={"rows": [{"x": 1, "y": None}]})
    assert tuple(r) == report.SECTIONS
    text = report.markdown(r)
    assert [text.index(report.TITLES["en"][s]) for s in report.SECTIONS] == sorted(text.index(report.TITLES["en"][s]) for s in report.SECTIONS)
    assert "- b: —" in text and "| 1 | — |" in text
    assert "<td>1</td>" in report.page(r, "t<") and "t&lt;" in report.page(r, "t<") and report.TITLES["zh"]["judgment"] in report.markdown(r, "zh")
    with pytest.raises(ValueError):
        report.build(judgment={"deep": [{"account": 1}]})
    assert report.capped([1, 2, 3, 4, 5]) == {"shown": [1, 2, 3], "withheld": 2}


def test_daily_run(spark):
    r = daily.run(inputs.px5(spark, SF), inputs.macro(spark, SF), inputs.bars(spark, SF), "2000-06-30")
    assert r["judgment"]["leaning"] == "DATA_INSUFFICIENT" and len(r["method"]["ledger"]) == 5
    assert len(r["dimensions"]["indicators"]) == 13 and report.markdown(r)
    with pytest.raises(daily.GateError):
        daily.run(inputs.px5(spark, SF).where("symbol <> 'spy'"), inputs.macro(spark, SF), inputs.bars(spark, SF), "2000-06-30")
