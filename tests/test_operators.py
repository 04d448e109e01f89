"""Hand-computed cases of single operators."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from causeway.functions import timeseries as ts
from causeway.operators import calendar, lineage, options, quality
from causeway.settings import EventRules
from causeway.sources import landed
from causeway.streaming.events import Machine, confirmation_cost, notifications

D = dt.date


def days(n, start=D(2026, 9, 1)):
    return [start + dt.timedelta(i) for i in range(n)]


def series(spark, values, name="x"):
    return spark.createDataFrame([("a", d, float(v)) for d, v in zip(days(len(values)), values, strict=True)], f"symbol string, session date, {name} double")


def bars(spark, closes):
    rows = [("spy", d, 0.99 * c, 1.01 * c, 0.98 * c, float(c), 1e6, "shares", "ETF") for d, c in zip(days(len(closes)), closes, strict=True)]
    return spark.createDataFrame(rows, "symbol string, session date, open double, high double, low double, close double, volume double, volume_unit string, sec_type string")


def codes(df):
    return sorted(r["code"] for r in df.collect())


def test_causal_rank_ignores_the_future(spark):
    one = ts.causal_percentile(series(spark, [1.0, 2, 3, 4, 5]), ["symbol"], "session", "x", "r", 2)
    more = ts.causal_percentile(series(spark, [1.0, 2, 3, 4, 5, -99]), ["symbol"], "session", "x", "r", 2)
    first = [r["r"] for r in one.orderBy("session").collect()]
    assert first == [None, 1.0, 1.0, 1.0, 1.0]
    assert [r["r"] for r in more.orderBy("session").collect()][:5] == first


def test_bars(spark):
    assert codes(quality.validate_bars(bars(spark, [770.0, 771, 769]))) == []
    assert codes(quality.validate_bars(bars(spark, [770.0, 77000, 771]))) == ["price_scale_break"] * 2
    assert codes(quality.validate_bars(bars(spark, [770.0, 508, 520]))) == ["large_price_move"]
    assert codes(quality.validate_bars(bars(spark, [770.0, 385]))) == ["large_price_move"]
    assert codes(quality.validate_bars(bars(spark, [770.0, 7700]))) == ["price_scale_break"]
    assert codes(quality.validate_bars(bars(spark, [770.0]).withColumn("high", F.lit(700.0)).withColumn("low", F.lit(800.0)))) == ["ohlc_bounds_violated", "ohlc_bounds_violated", "ohlc_inverted"]
    assert codes(quality.validate_bars(bars(spark, [770.0]).withColumn("close", F.lit(900.0)))) == ["ohlc_bounds_violated"]


def test_stale_series_needs_five(spark):
    assert quality.stale_series(bars(spark, [100.0] * 8)).first()["length"] == 8
    assert quality.stale_series(bars(spark, [100.0] * 4)).count() == 0


@pytest.mark.parametrize("known, ratio, explained", [(D(2026, 8, 20), 4.0, True), (D(2026, 9, 5), 4.0, False), (D(2026, 8, 20), 2.0, False)])
def test_a_split_explains_its_own_ratio_if_known_in_time(spark, known, ratio, explained):
    moves = spark.createDataFrame([("x", D(2026, 9, 2), 200 / 800 - 1)], "symbol string, session date, move double")
    actions = spark.createDataFrame([("x", "split", D(2026, 9, 2), known, ratio, 1)], "symbol string, kind string, effective_at date, known_at date, ratio double, action_id long")
    assert (quality.attribute_moves(moves, actions, "2026-09-02").first()["severity"] == "note") == explained


def test_a_constant_factor_is_the_tolerance_and_one_outlier_is_not(spark):
    a = spark.createDataFrame([("x", d, 100.4, 100.0) for d in days(30)], "symbol string, session date, a double, b double")
    assert quality.measured_tolerance(a).first()["tolerance"] == pytest.approx(0.004)
    b = spark.createDataFrame([("x", d, 100.0 if i else 66.0, 100.0) for i, d in enumerate(days(11))], "symbol string, session date, a double, b double")
    assert quality.measured_tolerance(b).first()["tolerance"] < 0.01


def test_put_scenarios(spark):
    r = spark.createDataFrame([(500.0, 100_000.0, 475.0, 8.0)], "spot double, notional double, strike double, ask double")
    s = options.put_scenarios(r).where("move = -0.2").first()
    assert (s["contracts"], round(s["outlay"], 2), s["payoff"], round(s["hedged_pnl"], 2)) == (2, 1601.30, 15_000.0, -6601.30)
    big = options.size_protection(r.withColumn("spot", F.lit(640.0))).first()
    assert (big["contracts"], big["uncovered"]) == (1, 56.25)
    low = {round(x["move"], 2): round(x["pnl"], 2) for x in options.reduced_exposure(r).collect()}
    assert (low[-0.2], low[0.1]) == (-16_004.0, 7_996.0)


def test_nearest_strike_ties_go_down(spark):
    t = spark.createDataFrame([("s", "e", 767.5)], "symbol string, expiry string, target double")
    k = spark.createDataFrame([("s", "e", x) for x in (760.0, 765.0, 770.0)], "symbol string, expiry string, strike double")
    assert options.nearest_strike(t, k, ["symbol", "expiry"]).first()["strike"] == 765.0


def test_parity_recovers_forward_and_rate(spark):
    import math

    rows = []
    for expiry, n in (("20261009", 31), ("20261120", 73)):
        for k in (695.0, 730.0, 755.0):
            put = 0.06 * (k - 600)
            rows.append((expiry, n, k, put, put + math.exp(-0.031 * n / 365) * (774.4 - k), 0.05))
    p = options.put_call_parity(spark.createDataFrame(rows, "expiry string, days int, strike double, put_mid double, call_mid double, half_spread double"))
    for r in p.collect():
        assert r["status"] == "ok" and r["forward"] == pytest.approx(774.4, abs=1e-6) and r["rate"] == pytest.approx(0.031, abs=1e-9)


@pytest.mark.parametrize("pattern, kinds", [("TT", []), ("TTT", ["opened"]), ("TTFFFFFF", []), ("TTTFFFFF", ["opened", "released"]), ("TTTFFTTT", ["opened"]), ("TTFT", ["opened"])])
def test_event_machine(pattern, kinds, spark):
    rules = EventRules(3, 5, 0)
    m = Machine()
    got = [n[0] for c, d in zip(pattern, days(len(pattern)), strict=True) if (n := m.observe(c == "T", d, rules))]
    assert got == kinds
    rows = spark.createDataFrame([("a", d, c == "T") for c, d in zip(pattern, days(len(pattern)), strict=True)], "label string, session date, present boolean")
    assert [r["kind"] for r in notifications(rows, rules).orderBy("session").collect()] == kinds


def test_a_repeated_session_counts_once():
    m, d = Machine(), D(2026, 9, 1)
    for _ in range(5):
        m.observe(True, d, EventRules())
    assert m.seen == 1


def test_confirmation_cost(spark):
    rows = spark.createDataFrame([("a", d, c == "T") for c, d in zip("TFTTTTFFFFF", days(11), strict=True)], "label string, session date, present boolean")
    r = confirmation_cost(rows).first()
    assert (r["flickers"], r["opened"], r["worst_delay"]) == (1, 1, 3.0)


def test_calendar(spark):
    cal = calendar.calendar(spark, "2026-08-01", "2026-09-30")
    assert cal.where("session = '2026-09-07'").count() == 0
    assert calendar.market_is_open(cal, "2026-09-04 18:00:00").first()["open"]
    assert not calendar.market_is_open(cal, "2026-09-04 23:00:00").first()["open"]
    assert not calendar.market_is_open(cal, "2026-09-07 18:00:00").first()["open"]
    assert calendar.last_completed(cal, "2026-09-08 12:00:00").first()["session"] == D(2026, 9, 4)
    assert calendar.calendar(spark, "2000-01-01", "2026-12-31").where("weekday(session) > 4").count() == 0


def test_payloads(spark, tmp_path):
    (tmp_path / "g.csv").write_text("DATE,X\n2020-01-01,.\n2020-01-02,1.5\n")
    assert [tuple(r) for r in landed.read_graph_csv(spark, str(tmp_path / "g.csv"), "x").collect()] == [("x", D(2020, 1, 2), 1.5)]
    body = {"chart": {"result": [{"timestamp": [1577923200, 1578009600], "indicators": {"quote": [{"close": [100.0, 102.0]}], "adjclose": [{"adjclose": [99.0, 101.0]}]}}]}}
    (tmp_path / "c.json").write_text(json.dumps(body))
    got = {(r["convention"], r["session"]): r["value"] for r in landed.read_chart_json(spark, str(tmp_path / "c.json"), "spy").collect()}
    assert got["adjusted", D(2020, 1, 2)] == 99.0 and got["raw", D(2020, 1, 3)] == 102.0
    (tmp_path / "o.json").write_text(json.dumps({"observations": [{"date": "2020-01-02", "value": "3"}, {"date": "2020-01-03", "value": "."}]}))
    assert landed.read_observations_json(spark, str(tmp_path / "o.json"), "s").count() == 1
    (tmp_path / "t.json").write_text(json.dumps({"data": {"tradesTable": {"rows": [{"date": "01/02/2020", "close": "$1,234.50"}]}}}))
    assert landed.read_trades_json(spark, str(tmp_path / "t.json"), "s").first()["value"] == 1234.5
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.csv", "words\n,Mkt-RF,SMB\n20200102,1.0,-2.0\n20200103,3.0,4.0\n\n20200104,9,9\n")
    (tmp_path / "f.zip").write_bytes(z.getvalue())
    rows = {(r["series"], r["session"]): r["value"] for r in landed.read_factor_zip(spark, str(tmp_path / "f.zip")).collect()}
    assert rows == {("mkt_rf", D(2020, 1, 2)): 0.01, ("smb", D(2020, 1, 2)): -0.02, ("mkt_rf", D(2020, 1, 3)): 0.03, ("smb", D(2020, 1, 3)): 0.04}


def test_write_once(spark, tmp_path):
    at = f"file://{tmp_path}/once"
    assert lineage.write_once(spark.range(3), at) and not lineage.write_once(spark.range(3), at)
    with pytest.raises(ValueError):
        lineage.write_once(spark.range(4), at)


def test_forbidden_names_are_found_at_any_depth(spark):
    df = spark.sql("select 1 as a, struct(array(struct(2 as account)) as x) as b")
    assert landed.unavailable_keys(df, ("account",)) == ["b.x.account"]
