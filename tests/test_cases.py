"""Cases with known answers for the gates, screens, payoffs, snapshots and loading."""

import datetime as dt
import itertools
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from causeway.operators import evidence, options, quality, research, snapshots
from causeway.plans import artefacts, diagnostics
from causeway.sources import loading, quotes

DAY = dt.date(2026, 9, 1)


def closes(spark, rows, symbol="spy"):
    return spark.createDataFrame([(symbol, DAY + dt.timedelta(i), p) for i, p in rows], "symbol string, session date, p double")


def test_a_move_after_a_gap_of_the_other_source_is_compared(spark):
    a = closes(spark, enumerate([100.0, 100.0, 100.0, 120.0]))
    b = closes(spark, [(0, 100.0), (1, 100.0), (3, 120.0)])
    assert [(r["code"], r["severity"]) for r in quality.confirm_moves(a, b).collect()] == [("move_confirmed", "note")]
    flat = closes(spark, [(0, 100.0), (1, 100.0), (3, 100.0)])
    assert [r["code"] for r in quality.confirm_moves(a, flat).collect()] == ["move_unconfirmed"]
    assert [r["code"] for r in quality.confirm_moves(a, closes(spark, [(3, 120.0)])).collect()] == ["move_unconfirmable"]


def test_a_move_has_no_say_in_its_own_band(spark):
    a = closes(spark, enumerate([100.0] * 10 + [66.0]))
    b = closes(spark, enumerate([100.0] * 11))
    both = quality.aligned(a, b)
    assert quality.measured_tolerance(both).first()["tolerance"] < 0.01
    last = quality.tolerance_before(both).orderBy(F.col("session").desc()).first()
    assert last["band"] == pytest.approx(5e-5)


def test_rows_that_differ_in_where_a_null_stands_conflict(spark):
    rows = [("a", DAY, None, 5.0), ("a", DAY, 5.0, None), ("b", DAY, None, 5.0), ("b", DAY, None, 5.0)]
    d = spark.createDataFrame(rows, "symbol string, session date, open double, close double")
    assert {r["symbol"]: r["code"] for r in quality.duplicate_rows(d).collect()} == {"a": "duplicate_row_conflict", "b": "duplicate_row_identical"}
    assert quality.duplicate_rows(d.select("symbol", "session")).count() == 2


def test_conventions_are_checked_before_values(spark):
    a, b = closes(spark, enumerate([100.0, 101.0])), closes(spark, enumerate([50.0, 50.5]))
    c = spark.createDataFrame([("spy", "x", "adjusted", "regular", "USD", "shares"), ("spy", "y", "raw", "regular", "USD", "lots")], "symbol string, source string, price string, session_kind string, currency string, volume_unit string")
    out = quality.reconcile(a, b, c).collect()
    assert [(r["code"], r["severity"], r["session"]) for r in out] == [("convention_mismatch", "quarantine", None)]
    units = c.withColumn("price", F.lit("raw"))
    assert quality.comparable(units).first()["comparable"]
    assert {r["verdict"] for r in quality.cross_source(a, None).collect()} == {"unverified"}


def test_a_substitution_needs_a_reason(spark):
    swap = "symbol string, replaced string, replacement string, reason string"
    assert quality.substitutions(spark.createDataFrame([("spy", "a", "b", "ended")], swap)).count() == 1
    with pytest.raises(PySparkException):
        quality.substitutions(spark.createDataFrame([("spy", "a", "b", "  ")], swap)).collect()


def test_eligibility_by_what_could_not_be_judged(spark):
    rows = [("judged", ["VALID", "QUARANTINED"], None), ("late", ["VALID", "DEGRADED"], None), ("none", [], None), ("empty", None, None), ("blocked", ["VALID"], ["quotes", "day_end"])]
    got = {r["name"]: r for r in quality.eligibility(spark.createDataFrame(rows, "name string, qualifications array<string>, blocks array<string>")).collect()}
    assert got["judged"]["quotes"] and got["judged"]["reason"] is None
    assert not got["late"]["quotes"] and got["late"]["reason"] == "rows that could not be judged: DEGRADED"
    assert not got["none"]["quotes"] and got["none"]["reason"] == "no data" and got["none"]["day_end"] and got["empty"]["day_end"]
    assert not got["blocked"]["quotes"] and not got["blocked"]["day_end"]
    assert not any(r["training"] or r["intraday"] for r in got.values())


def test_payoffs_at_half_coverage_and_with_a_cash_rate(spark):
    row = spark.createDataFrame([("spy", 500.0, 100_000.0, 475.0, 8.0), ("x", 640.0, 100_000.0, 600.0, 8.0)], "symbol string, spot double, notional double, strike double, ask double")
    sized = {r["symbol"]: r for r in options.size_protection(row).collect()}
    assert sized["spy"]["contracts"] == 2 and sized["spy"]["uncovered"] == 0 and sized["x"]["contracts"] == 1 and sized["x"]["uncovered"] == pytest.approx(56.25)
    half = {r["symbol"]: r for r in options.size_protection(row, coverage=0.5).collect()}
    assert half["spy"]["contracts"] == 1 and half["spy"]["uncovered"] == 100 and half["spy"]["coverage_ratio"] == 0.5
    worst = [r for r in options.put_scenarios(row.where("symbol = 'spy'")).collect() if r["move"] == -0.2][0]
    assert worst["payoff"] == pytest.approx(15_000) and worst["outlay"] == pytest.approx(1601.30) and worst["hedged_pnl"] == pytest.approx(-6601.30)
    reduced = {r["move"]: r for r in options.reduced_exposure(row.where("symbol = 'spy'")).collect()}
    assert reduced[-0.2]["pnl"] == pytest.approx(-16_004) and reduced[0.1]["pnl"] == pytest.approx(7_996) and reduced[0.0]["cost"] == pytest.approx(4)
    carried = options.reduced_exposure(row.where("symbol = 'spy'"), cash_rate=0.04).first()
    assert carried["carry"] == pytest.approx((20_000 - 4) * 0.04 * 30 / 365)
    for bad in (0, -1):
        with pytest.raises(ValueError):
            options.size_protection(row, coverage=bad)
    with pytest.raises(ValueError):
        options.reduced_exposure(row, keep=1.2)
    with pytest.raises(PySparkException):
        options.checked(row.withColumn("ask", F.lit(float("nan")))).collect()


def test_controls_have_the_shape_of_candidates(spark):
    c = {r["label"]: r for r in options.controls(spark.createDataFrame([("spy", 500.0, 100_000.0)], "symbol string, spot double, notional double")).collect()}
    assert set(c) == {"no new protection", "reduce to 80%"}
    assert c["no new protection"]["cost"] == 0 and c["no new protection"]["strike"] is None and c["no new protection"]["coverage_ratio"] == 0
    assert c["reduce to 80%"]["protection_at_worst"] == pytest.approx(-16_004 + 20_000)


def candidates(spark, rows):
    return spark.createDataFrame([("spy", *r) for r in rows], "symbol string, bucket string, moneyness double, con_id long, cost_share double")


def test_shortlist_stays_in_one_horizon_and_tells_why(spark):
    rows = [("25-60", -0.02, 1, 0.01), ("25-60", -0.02, 2, 0.02), ("25-60", -0.05, 3, None), ("25-60", -0.10, 4, 0.2), ("60-95", -0.02, 5, 0.01), ("60-95", -0.10, 6, 0.3)]
    got = {r["con_id"]: (r["shortlisted"], r["reason"]) for r in options.shortlist(candidates(spark, rows)).collect()}
    assert len(got) == 6
    assert got[1] == (True, "-2% protection depth in 25-60") and got[3] == (True, "-5% protection depth in 25-60")
    assert got[2] == (False, "not in the chosen horizon") and got[4] == (False, "cost over 5% of the notional") and got[5] == (False, "not in the chosen horizon")
    other = {r["con_id"]: r["shortlisted"] for r in options.shortlist(candidates(spark, rows), horizon="60-95").collect()}
    assert [k for k, v in other.items() if v] == [5]
    dear = options.shortlist(candidates(spark, [("25-60", -0.02, 1, 0.5)])).first()
    assert not dear["shortlisted"] and dear["reason"].startswith("cost over")
    many = options.shortlist(candidates(spark, [("25-60", -0.01 * k, k, 0.01) for k in range(1, 7)])).where("shortlisted").collect()
    assert sorted(r["con_id"] for r in many) == [1, 2, 3]


def test_a_mixed_book_counts_as_frozen(spark):
    rows = [("mixed", None, 0.01, 500.0), ("live", None, 0.01, 500.0), ("live", 30.0, 0.01, 500.0), ("live", 90.0, 0.01, 500.0), ("live", 30.0, 0.5, 500.0), ("live", 30.0, 0.01, 5.0), ("live", 30.0, None, None)]
    q = spark.createDataFrame([(i, "priced", *r) for i, r in enumerate(rows)], "con_id long, status string, basis string, age double, relative_spread double, open_interest double")
    shut = {r["con_id"]: r["qualification"] for r in options.screen(q, market_open=False).collect()}
    assert list(shut.values()) == ["VALID", "DEGRADED", "VALID", "DEGRADED", "QUARANTINED", "QUARANTINED", "DEGRADED"]
    assert options.screen(q, market_open=True).where("con_id = 0").first()["qualification"] == "DEGRADED"


@pytest.mark.parametrize("t,v,s,r", list(itertools.product([False, True], repeat=4)))
def test_every_rung_of_the_leaning(spark, t, v, s, r):
    row = spark.createDataFrame([(t, v, s, r)], "trend_damaged boolean, volatility_elevated boolean, stress_spreading boolean, repair_underway boolean")
    if t and (v or s):
        want = "REDUCTION"
    elif r and (t or v or s):
        want = "CONFLICTED"
    elif v and not t and not s:
        want = "HEDGE"
    elif t or v or s or r:
        want = "WATCH"
    else:
        want = "NO_NEW_DEFENSE"
    got = evidence.leaning(row, F.lit("REPLAYED")).first()
    assert got["rung"] == got["leaning"] == want
    assert evidence.leaning(row).first()["leaning"] == "DATA_INSUFFICIENT"


FOUND = "name string, dimension string, overlap_with string, value double, percentile double, direction string, risk_rank double"


def test_state_labels_by_branch(spark):
    def labels(*rows):
        return evidence.state_labels(spark.createDataFrame(list(rows), FOUND)).first().asDict()

    worse = lambda d, over=None: (d + "_x", d, over, 1.0, 0.95, "deteriorating", 0.95)
    eased = lambda d: (d + "_y", d, None, 1.0, 0.05, "easing", 0.05)
    assert labels(("spy_vs_200d_ma", "trend", None, -0.01, 0.5, "stable", 0.5)) == {"trend_damaged": True, "volatility_elevated": False, "stress_spreading": False, "repair_underway": False}
    assert labels(("vol_ratio_20_over_60", "volatility", None, 1.4, 0.9, "stable", 0.9))["volatility_elevated"]
    assert labels(worse("credit"), worse("implied"))["stress_spreading"]
    assert not labels(worse("trend"), worse("implied"))["stress_spreading"]
    assert not labels(worse("credit", "hy_oas"), worse("implied"))["stress_spreading"]
    assert labels(eased("credit"), eased("trend"))["repair_underway"]
    assert not labels(eased("credit"), eased("trend"), worse("implied"))["repair_underway"]


def quote_rows(spark, ask=7.68):
    return spark.createDataFrame([(882140303, 730.0, 7.65, ask, 9.0), (882140488, 755.0, 12.57, 12.62, 8.0)], "con_id long, strike double, bid double, ask double, tick_lag_seconds double")


def test_writing_the_same_content_again_writes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    args = (spark, root, "2026-09-04")
    first = snapshots.write_snapshot(*args, {"quotes": quote_rows(spark)}, {"a": 1}, eligible_for=["day_end"])
    stamps = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    lagged = quote_rows(spark).withColumn("tick_lag_seconds", F.lit(1.0))
    again = snapshots.write_snapshot(*args, {"quotes": lagged}, {"a": 1}, eligible_for=["day_end"])
    assert again.snapshot_id == first.snapshot_id and {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")} == stamps
    assert snapshots.records(spark, root).count() == 1
    revised = snapshots.write_snapshot(*args, {"quotes": quote_rows(spark, 7.7)}, {"a": 1})
    assert revised.manifest["revision"] == 2 and revised.manifest["supersedes"] == first.snapshot_id and revised.manifest["changed_tables"] == ["quotes"]
    assert snapshots.write_snapshot(*args, {"quotes": quote_rows(spark)}, {"a": 2}).snapshot_id != first.snapshot_id
    view = snapshots.write_snapshot(*args, {"quotes": quote_rows(spark)}, {"a": 1}, {"horizon": 60})
    assert view.manifest["revision"] == 1 and view.manifest["supersedes"] is None


def test_a_verdict_is_amended_and_the_old_one_kept(spark, tmp_path):
    root = f"file://{tmp_path}"
    args = (spark, root, "2026-09-04", {"quotes": quote_rows(spark)}, {})
    own = snapshots.write_snapshot(*args, eligible_for=["day_end"]).snapshot_id
    snapshots.write_snapshot(*args, eligible_for=["day_end", "quotes"])
    snapshots.write_snapshot(*args, eligible_for=["day_end", "quotes"])
    s = snapshots.read_snapshot(spark, root, own)
    assert s.manifest["eligible_for"] == ["day_end", "quotes"] and [a["eligible_for"] for a in s.manifest["amendments"]] == [["day_end"]]
    s.require("quotes")
    with pytest.raises(PermissionError):
        s.require("training")
    with pytest.raises(ValueError):
        s.require("guessing")
    with pytest.raises(KeyError):
        s.table("nothing")
    assert snapshots.verify_snapshot(s) == []
    broken = snapshots.Snapshot(own, s.manifest, {"quotes": quote_rows(spark, 9.0), "more": quote_rows(spark)})
    assert snapshots.verify_snapshot(broken) == ["quotes: content differs", "more: not in the manifest"]
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, root, "2026-09-04-none")
    assert snapshots.records(spark, f"file://{tmp_path}/elsewhere").count() == 0


def test_content_hash_adds_up_batches_not_rows(spark):
    import hashlib
    import json

    from causeway.operators.lineage import content_hash

    rows = [(None if i % 5 == 0 else f"t{i % 3}", i, None if i % 4 == 0 else i / 8) for i in range(500)]
    df = spark.createDataFrame(rows, "name string, i long, x double").coalesce(1)
    each, expected = {}, {}
    for name, i, x in rows:
        each.setdefault(name, []).append(hashlib.sha256(json.dumps({"i": i, "x": x}, separators=(",", ":")).encode()).hexdigest())
    for name, hs in each.items():
        sums = [str(sum(int(h[k : k + 15], 16) for h in hs)) for k in (0, 15, 30, 45)]
        expected[name] = (hashlib.sha256("|".join(["i:bigint,x:double", str(len(hs)), *sums]).encode()).hexdigest(), len(hs))
    assert {r["name"]: (r["sha256"], r["rows"]) for r in content_hash(df).collect()} == expected
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {r["name"]: (r["sha256"], r["rows"]) for r in content_hash(df).collect()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = content_hash(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "conv(" not in plan  # a number of each part of each row took most of the time


def test_all_tables_of_a_snapshot_are_hashed_in_one_job(spark):
    ran = lambda: spark._jsparkSession.sharedState().statusStore().executionsCount()
    tables = {"b": quote_rows(spark), "a": quote_rows(spark, 9.0), "none": quote_rows(spark).where("strike < 0")}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = ran()
    hashes = snapshots.table_hashes(tables)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert ran() == before + 1
    assert [(h["name"], h["rows"]) for h in hashes] == [("a", 2), ("b", 2), ("none", 0)] and len({h["sha256"] for h in hashes}) == 3
    assert [snapshots.table_hashes({n: tables[n]})[0] for n in sorted(tables)] == hashes
    assert snapshots.table_hashes({}) == []


def test_content_hash_knows_nulls_types_and_order_of_an_ordinal(spark):
    from causeway.operators.lineage import content_hash

    h = lambda rows, kind="name string, o int, a string": content_hash(spark.createDataFrame(rows, kind)).first()["sha256"]
    base = [("t", 0, "x"), ("t", 1, None)]
    assert h(base) == h(base[::-1]) != h([("t", 1, "x"), ("t", 0, None)])
    assert h(base) != h([("t", 0, "x"), ("t", 1, "")]) and h(base) != h(base, "name string, o bigint, a string")
    assert h([("t", 0, "x")] * 2) != h([("t", 0, "x")])


def test_the_cache_is_fresh_fetched_or_stale(tmp_path):
    calls = []

    def get(url):
        calls.append(url)
        return b"body"

    def down(url):
        raise OSError("down")

    folder = str(tmp_path)
    assert loading.fetch(get, "http://a", folder).status == "network"
    assert loading.fetch(down, "http://a", folder).status == "cache_fresh" and len(calls) == 1
    stale = loading.fetch(down, "http://a", folder, max_age_seconds=-1, wait=lambda s: None)
    assert stale.status == "cache_stale" and stale.error == "down" and open(stale.path, "rb").read() == b"body"
    with pytest.raises(OSError):
        loading.fetch(down, "http://b", folder, wait=lambda s: None)
    assert not [n for n in os.listdir(folder) if n.endswith(".part")]
    assert len(loading.cache_name("http://a")) == 24 and loading.cache_name("http://a", "x.csv") == "x.csv"


def test_history_is_asked_for_only_when_allowed(spark, tmp_path):
    with pytest.raises(PermissionError):
        quotes.historical_bars(spark, str(tmp_path), "10 Y")


def test_fixture_and_manifest_status(spark):
    f = loading.offline_fixture(spark, "2021-01-04", "2021-03-01", ["spy", "rsp"])
    assert f.count() == 2 * 41 and f.exceptAll(loading.offline_fixture(spark, "2021-01-04", "2021-03-01", ["spy", "rsp"])).count() == 0
    m = lambda *p: spark.createDataFrame([(x,) for x in p], "provider string")
    assert [loading.point_in_time_status(m(*p)).first()["status"] for p in (("first_release",), ("first_release", "graph"), ("graph",))] == ["point_in_time", "mixed", "latest_values"]


def test_registry_store_and_merge(spark, tmp_path):
    at = f"{tmp_path}/registry"
    assert research.load(spark, at).count() == 0
    e = research.Experiment("a", research.CAPABILITIES[0], "h", "m")
    research.save(research.frame(spark, [e]), at)
    assert research.load(spark, at).first()["name"] == "a"


def test_replays_are_recorded_once():
    from causeway.operators import replay

    kept = replay.record([], "evidence_of_harm", "less recall")
    again = replay.record(kept, "passed", "more recall", 0.5)
    assert len(again) == 1 and again[0].grade == research.LADDER[1] and again[0].outcome == "passed"


def test_report_files_and_diagnostics(spark, tmp_path):
    from causeway.plans import report

    names = artefacts.write_report(spark, f"file://{tmp_path}/run", report.build(judgment={"leaning": "WATCH"}), "Run")
    assert names == ["report.en.html", "report.en.md", "report.json", "report.zh.html", "report.zh.md"]
    assert "WATCH" in (tmp_path / "run" / "report.en.md").read_text(encoding="utf-8")
    assert artefacts.run_folder("r", "2026-09-04", "210000Z") == "r/2026-09-04-210000Z" and artefacts.run_folder("r", "x", "y", True) == "r/offline"
    assert all(r["status"] == "ok" for r in diagnostics.environment())


def test_report_blocks_show_what_is_missing_as_missing():
    from causeway.plans import report

    rows = [{"name": "a", "value": 1.0, "risk_rank": 0.5, "direction": "easing"}, {"name": "b", "value": None, "risk_rank": None}, {"name": "c", "value": 2.0, "risk_rank": 0.9, "direction": "stable"}]
    assert [r["indicator"] for r in report.indicator_table(rows)] == ["c", "a", "b"] and report.indicator_table(rows)[2]["value"] == "—"
    assert report.bar_rows(rows, "risk_rank") == ["c " + "#" * 18 + " 90 %", "a " + "#" * 10 + " 50 %"]
    table = report.scenario_table([{"symbol": "s", "label": "x", "cost": 1.0}, {"symbol": "s", "label": "x", "cost": 2.0}])
    assert len(table) == 1 and table[0]["cost"] == "1.00" and table[0]["worst"] == "—"
    assert report.condition_lines([{"name": "a", "above": 0.6, "below": 0.4}, {"name": "b", "above": None, "below": None}]) == ["a: above 60 % or below 40 %"]
    assert report.headline({"leaning": "DATA_INSUFFICIENT"}).startswith("No leaning") and report.headline({"leaning": "WATCH"}) == "Leaning: WATCH"
    assert report.registry_lines([{"capability": "c", "experiments": 2, "may_influence": ""}]) == ["c: 2 experiments; may influence: none"]
    assert report.method_lines({"x": 1.5}, "UNTESTED")[-1].endswith("UNTESTED")


def test_secrets_by_name_and_environment_first(tmp_path):
    from causeway import config

    lines = ["# FRED_API_KEY=no", "FRED_API_KEY='file'", "PATH=evil", "noise"]
    assert config.secrets(lines, {}) == {"FRED_API_KEY": "file"}
    assert config.secrets(lines, {"FRED_API_KEY": "env", "PATH": "x"}) == {"FRED_API_KEY": "env"}
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert config.load(str(tmp_path / "c.json"), str(tmp_path / "none"))["a"] == 1


def test_views_answer_sql(spark):
    from causeway import catalog

    assert catalog.register_views(spark, "/root/testdata/sf0.001", ["tumbling_window", "signal_rate"]) == ["signal_rate", "tumbling_window"]
    assert spark.sql("select count(*) as n from tumbling_window join signal_rate on true where n > 0").first()["n"] > 0
    assert spark.sql("select count(*) as n from orders").first()["n"] == 1500


def test_a_statistic_of_ones_own_can_be_bootstrapped(spark):
    import numpy as np

    from causeway.operators import ledger

    rows = [("s", DAY + dt.timedelta(i), float(i % 7), 1.0) for i in range(200)]
    wide = spark.createDataFrame(rows, "symbol string, session date, a double, b double")
    out = ledger.bootstrap_depths(wide, ["a", "b"], 120, 20, statistic=lambda x: x.mean(axis=1)).collect()
    assert len(out) == 240 and all(r["depth"] == 1 for r in out if r["name"] == "b")
    source = ledger.block_source(200, 20, 7)
    assert [r["depth"] for r in out if r["name"] == "a" and r["draw"] == 7] == [pytest.approx(np.mean(source % 7))]
    short = ledger.paired_bootstrap(wide.where(F.col("session") < DAY + dt.timedelta(10)), [("a", "b")], 50, 20).first()
    assert short["draws"] == 0 and short["low"] is None and not short["significant"]


def test_rules_are_promoted_one_rung_with_evidence():
    from causeway.settings import LabelRules

    r = evidence.promoted(LabelRules(), "REPLAYED", {"window": "after 2013"})
    assert r.grade == "REPLAYED"
    for grade, why in (("TESTED", {"a": 1}), ("SHADOWED", {}), ("SHADOWED", {"a": None}), ("nothing", {"a": 1})):
        with pytest.raises(ValueError):
            evidence.promoted(r, grade, why)


def test_evidence_says_what_is_missing(spark):
    none = spark.createDataFrame([], "name string, session date, value double")
    found = evidence.evidence(none)
    assert evidence.described(found)["missing"] == ["credit", "implied", "participation", "trend", "volatility"]
    assert {r["missing_reason"] for r in evidence.with_missing(found).collect()} == {"no data"}
