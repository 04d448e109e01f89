"""Benchmark exposures, the return ledger, matched controls, bootstrap, conditional frequencies and episodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.functions import timeseries as ts
from causeway.settings import EPISODE_GAP, EVENT_DEPTH, EVENT_HORIZON, TRADING_DAYS, Ledger

STRATEGIES = ("no_new_defense", "fixed_low_exposure", "trailing_or_ewma_volatility_target", "ewma_volatility_target", "fixed_long_term_trend_rule")


def _clipped(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(x, F.lit(high))))


def benchmark_exposures(prices: DataFrame, s: Ledger = Ledger()) -> DataFrame:
    """symbol, session, i, p -> also r and one exposure per strategy, decided the session before."""
    w = ts.series("symbol")
    r = prices.withColumn("r", ts.pct_change(F.col("p"), w))
    r = ts.ewm_volatility(r, ["symbol"], "session", "r", "ewm", s.ewm_alpha, s.ewm_minimum)
    vol = ts.rolling_volatility(F.col("r"), w, s.volatility_window)
    decided = r.withColumns(
        {
            "vt": _clipped(F.try_divide(F.lit(s.target_volatility), vol), 0.0, s.cap),
            "ew": _clipped(F.try_divide(F.lit(s.target_volatility), F.col("ewm") * F.sqrt(F.lit(float(TRADING_DAYS)))), 0.0, s.cap),
            "above": F.coalesce(F.col("p") > ts.rolling_mean(F.col("p"), w, s.trend_window), F.lit(False)).cast("double"),
        }
    )
    return decided.select(
        "symbol",
        "session",
        "i",
        "p",
        "r",
        F.lit(1.0).alias(STRATEGIES[0]),
        F.lit(s.fixed_low).alias(STRATEGIES[1]),
        F.lag("vt").over(w).alias(STRATEGIES[2]),
        F.lag("ew").over(w).alias(STRATEGIES[3]),
        F.lag("above").over(w).alias(STRATEGIES[4]),
    )


def ledger_returns(exposures: DataFrame, s: Ledger = Ledger()) -> DataFrame:
    """symbol, session, i, strategy, weight, ret, common: net of the cost of turnover, cash on what isn't invested.

    `common` marks the sessions on which every strategy has a return; entry from no weight is free.
    """
    every = F.lit(True)
    for name in STRATEGIES:
        every = every & F.col(name).isNotNull()
    wide = exposures.withColumn("common", every & F.col("r").isNotNull())
    long = wide.unpivot(["symbol", "session", "i", "r", "common"], list(STRATEGIES), "strategy", "raw")
    w = ts.series("symbol", "strategy")
    long = long.withColumn("weight", _clipped(F.col("raw"), 0.0, s.cap))
    turnover = F.coalesce(F.abs(F.col("weight") - F.lag("weight").over(w)), F.lit(0.0))
    ret = F.col("weight") * F.col("r") + (1 - F.col("weight")) * (s.cash_rate / TRADING_DAYS) - turnover * s.cost_bps / 10_000
    return long.select("symbol", "session", "i", "strategy", "weight", ret.alias("ret"), "common")


def with_drawdown(returns: DataFrame, by: list[str], ret: str = "ret", order: str = "session") -> DataFrame:
    """Adds `drawdown` from the running peak, which begins at the first equity."""
    w = ts.series(*by, order=order)
    eq = returns.withColumn("equity", ts.equity(F.col(ret), w))
    return eq.withColumn("drawdown", F.col("equity") / F.max("equity").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)


def performance(returns: DataFrame) -> DataFrame:
    """One row per symbol and strategy over the common sessions."""
    d = with_drawdown(returns.where("common"), ["symbol", "strategy"])
    year = float(TRADING_DAYS)
    return d.groupBy("symbol", "strategy").agg(
        F.count(F.lit(1)).alias("days"),
        F.round(F.avg("ret") * year, 6).alias("annual_return"),
        F.round(F.stddev_samp("ret") * F.sqrt(F.lit(year)), 6).alias("annual_volatility"),
        F.round(F.min("drawdown"), 6).alias("max_drawdown"),
        F.round(F.avg("weight"), 6).alias("average_exposure"),
    )


def matched_control(pairs: DataFrame, minimum: int = TRADING_DAYS, back_fill: bool = True) -> DataFrame:
    """symbol, session, baseline, candidate -> `control`: the baseline scaled to the candidate's mean exposure so far.

    Each mean is over the side's own values. The ratio is filled backward into the warm-up as the method it mirrors does;
    back_fill=False keeps it causal.
    """
    w = ts.series("symbol")
    ratio = F.try_divide(ts.expanding_mean(F.col("candidate"), w, minimum), ts.expanding_mean(F.col("baseline"), w, minimum))
    out = pairs.withColumn("ratio", _clipped(ratio, 0.0, 2.0))
    out = out.withColumn("ratio", ts.forward_fill(F.col("ratio"), w))
    if back_fill:
        out = out.withColumn("ratio", ts.back_fill(F.col("ratio"), w))
    return out.withColumn("control", F.col("baseline") * F.col("ratio"))


def block_source(n: int, block: int, draw: int) -> np.ndarray:
    """Where the positions of one draw come from: circular blocks whose starts a fixed linear rule deals out."""
    b = np.arange(-(-n // block), dtype=np.int64)
    start = ((draw * 7919 + b * 104729 + 17) * 31) % n
    return ((start[:, None] + np.arange(block)) % n).ravel()[:n]


def _depth(returns: np.ndarray) -> np.ndarray:
    """Deepest fall from the running peak of each row; the peak begins at the first equity."""
    with np.errstate(invalid="ignore", divide="ignore"):
        log = np.cumsum(np.log1p(returns), axis=1)
        return np.exp(np.min(log - np.maximum.accumulate(log, axis=1), axis=1)) - 1


#: Draws that one row of work holds.
DRAWS_A_ROW = 50


#: rows of returns -> one number for each row
Statistic = Callable[[np.ndarray], np.ndarray]


def bootstrap_depths(wide: DataFrame, columns: list[str], draws: int, block: int = 60, statistic: Statistic = _depth) -> DataFrame:
    """symbol, session and returns -> (symbol, draw, name, depth), all columns drawn by the same blocks; `depth` is the statistic of a draw.

    A symbol's returns are one array for each column (as long as the calendar) that goes to every task of its draws; draws spread
    over tasks. Symbols with fewer sessions than a block have no draws.
    """
    ordered = F.array_sort(F.collect_list(F.struct("session", *columns)))
    one = wide.groupBy("symbol").agg(ordered.alias("x")).where(F.size("x") >= block)
    one = one.select("symbol", *(F.col(f"x.{c}").alias(c) for c in columns))
    work = one.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAWS_A_ROW))))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                returns = np.array([b[c][i].as_py() for c in columns], dtype=float)
                symbol, first = b["symbol"][i].as_py(), b["first"][i].as_py()
                last = min(first + DRAWS_A_ROW, draws)
                depth = np.array([statistic(returns[:, block_source(returns.shape[1], block, d)]) for d in range(first, last)])
                n = depth.size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([symbol] * n, pa.string()), pa.array(np.repeat(np.arange(first, last), len(columns))), pa.array(columns * (last - first)), pa.array(depth.ravel(), from_pandas=True)],
                    ["symbol", "draw", "name", "depth"],
                )

    return work.repartition("symbol", "first").mapInArrow(f, "symbol string, draw long, name string, depth double")


def paired_bootstrap(wide: DataFrame, pairs: list[tuple[str, str]], draws: int = 1000, block: int = 60) -> DataFrame:
    """symbol, session and returns -> symbol, left, right, difference in depth and its interval over the draws; null below one block.

    significant: the interval excludes zero.
    """
    columns = sorted({c for p in pairs for c in p})
    drawn = bootstrap_depths(wide, columns, draws, block).groupBy("symbol", "draw").pivot("name", columns).agg(F.first("depth"))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), (F.col(a) - F.col(b)).alias("diff")) for a, b in pairs))).alias("d")
    q = drawn.select("symbol", each).select("symbol", "d.*").groupBy("symbol", "left", "right").agg(F.count("diff").alias("draws"), F.expr("percentile(diff, array(0.025, 0.975))").alias("q"))
    long = wide.unpivot(["symbol", "session"], columns, "name", "ret")
    depth = with_drawdown(long, ["symbol", "name"]).groupBy("symbol", "name").agg(F.min("drawdown").alias("depth"), F.count(F.lit(1)).alias("observations"))
    depth = depth.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("name", "depth"))).alias("depth"), F.max("observations").alias("observations"))
    seen = depth.select("symbol", "observations", F.explode(F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), (F.col("depth")[a] - F.col("depth")[b]).alias("difference")) for a, b in pairs))).alias("d")).select("symbol", "observations", "d.*")
    low, high = F.col("q")[0], F.col("q")[1]
    out = seen.join(q, ["symbol", "left", "right"], "left")
    enough = F.col("draws").isNotNull()
    return out.select("symbol", "left", "right", "observations", F.coalesce("draws", F.lit(0)).alias("draws"), F.when(enough, F.round("difference", 6)).alias("difference"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.coalesce((low > 0) | (high < 0), F.lit(False)).alias("significant"))


TARGET = STRATEGIES[2]
#: Strategies that are compared with the volatility target scaled to their own mean exposure.
MATCHED = (STRATEGIES[1], STRATEGIES[3], STRATEGIES[4])


def with_matched_returns(exposures: DataFrame, s: Ledger = Ledger()) -> DataFrame:
    """symbol, session and the return of each strategy and of each matched control (`matched_NAME`), on the sessions that all strategies have."""
    w = ts.series("symbol")
    every = F.col("r").isNotNull()
    for name in STRATEGIES:
        every = every & F.col(name).isNotNull()
    rows = exposures.withColumn("common", every)
    for name in MATCHED:
        pair = rows.withColumns({"baseline": F.col(TARGET), "candidate": F.col(name)})
        rows = matched_control(pair).withColumn(f"matched_{name}", F.col("control")).drop("baseline", "candidate", "ratio", "control")
    weights = [*STRATEGIES, *(f"matched_{n}" for n in MATCHED)]
    clipped = {c: _clipped(F.col(c), 0.0, s.cap) for c in weights}
    held = rows.withColumns(clipped)
    # A strategy's first weight is free; a control begins with the common sessions.
    before = {c: F.lag(F.when(F.col("common"), F.col(c)) if c.startswith("matched_") else F.col(c)).over(w) for c in weights}
    cost = {c: F.coalesce(F.abs(F.col(c) - before[c]), F.lit(0.0)) * s.cost_bps / 10_000 for c in weights}
    return held.select("symbol", "session", "common", *((F.col(c) * F.col("r") + (1 - F.col(c)) * (s.cash_rate / TRADING_DAYS) - cost[c]).alias(c) for c in weights)).where("common").drop("common")


def compare_against_benchmarks(prices: DataFrame, s: Ledger = Ledger(), draws: int = 1000, block: int = 60) -> DataFrame:
    """Every strategy on one day set: its performance, and its drawdown against the volatility target and against its matched control."""
    exposures = benchmark_exposures(prices, s)
    own = performance(ledger_returns(exposures, s))
    pairs = [(n, TARGET) for n in STRATEGIES if n != TARGET] + [(n, f"matched_{n}") for n in MATCHED]
    tests = paired_bootstrap(with_matched_returns(exposures, s), pairs, draws, block)
    fields = ("difference", "low", "high", "significant")
    side = lambda prefix, rows: rows.select("symbol", F.col("left").alias("strategy"), *(F.col(c).alias(f"{prefix}_{c}") for c in fields))
    out = own.join(side("target", tests.where(F.col("right") == TARGET)), ["symbol", "strategy"], "left")
    return out.join(side("matched", tests.where(F.col("right") != TARGET)), ["symbol", "strategy"], "left")


def conditional_frequencies(prices: DataFrame, horizon: int = EVENT_HORIZON, depth: float = EVENT_DEPTH, split: str = "1998-01-01", high: float = 0.9) -> DataFrame:
    """Event frequency of all sessions and of those below trend, with high volatility, or both; whole and after the split."""
    w = ts.series("symbol")
    base = prices.withColumn("r", ts.pct_change(F.col("p"), w))
    base = base.withColumns({"event": ts.forward_drawdown_event(F.col("p"), w, horizon, depth), "vol": ts.rolling_volatility(F.col("r"), w, 20), "ma": ts.rolling_mean(F.col("p"), w, 200)})
    base = ts.causal_percentile(base, ["symbol"], "session", "vol", "rank")
    rows = base.where("event is not null and rank is not null and ma is not null")
    periods = F.explode(F.when(F.col("session") >= F.lit(split).cast("date"), F.array(F.lit("whole"), F.lit("recent"))).otherwise(F.array(F.lit("whole")))).alias("period")
    below, wild = F.col("p") < F.col("ma"), F.col("rank") >= high
    masks = {"all": F.lit(True), "below_trend": below, "high_volatility": wild, "both": below & wild}
    aggs = []
    for name, mask in masks.items():
        aggs += [F.count(F.when(mask, 1)).alias(f"{name}_sessions"), F.round(F.avg(F.when(mask, F.col("event"))), 6).alias(f"{name}_rate")]
    return rows.select("*", periods).groupBy("symbol", "period").agg(*aggs)


def episodes(flags: DataFrame, gap: int = EPISODE_GAP) -> DataFrame:
    """symbol, session, i, flag -> maximal groups of flagged sessions no more than `gap` apart; days span first to last."""
    w = ts.series("symbol", order="i")
    f = flags.where("flag = 1").withColumn("new", F.coalesce((F.col("i") - F.lag("i").over(w) > gap).cast("int"), F.lit(1)))
    f = f.withColumn("episode", ts.run_id(F.col("new"), w))
    return f.groupBy("symbol", "episode").agg(F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.min("i").alias("first_i"), F.max("i").alias("last_i"), (F.max("i") - F.min("i") + 1).alias("event_days"))


def replay_metrics(rows: DataFrame, gap: int = EPISODE_GAP) -> DataFrame:
    """symbol, session, i, event, alert -> recall over episodes, precision over alerts, alerts and false ones a year.

    Each row learns in one window which episode began last and where it ends, so alerts and episodes never meet as pairs.
    """
    w = ts.series("symbol", order="i")
    new = F.when(F.col("event") == 1, F.coalesce((F.col("i") - F.last(F.when(F.col("event") == 1, F.col("i")), True).over(w.rowsBetween(W.unboundedPreceding, -1)) > gap).cast("int"), F.lit(1)))
    placed = rows.withColumn("new", new).withColumn("episode", F.sum(F.coalesce("new", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    e = W.partitionBy("symbol", "episode")
    placed = placed.withColumn("ends", F.max(F.when(F.col("event") == 1, F.col("i"))).over(e))
    hit = placed.where("episode > 0").groupBy("symbol", "episode").agg(F.bool_or((F.col("alert") == 1) & (F.col("i") <= F.col("ends"))).alias("detected"))
    e = hit.groupBy("symbol").agg(F.count(F.lit(1)).alias("episodes"), F.count(F.when(F.col("detected"), 1)).alias("detected"))
    a = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("sessions"), F.sum("alert").cast("long").alias("alerts"), F.count(F.when((F.col("alert") == 1) & (F.col("event") == 1), 1)).alias("hits"))
    out = a.join(e, "symbol", "left").na.fill(0, ["episodes", "detected"])
    return out.select(
        "symbol",
        "sessions",
        "episodes",
        "detected",
        "alerts",
        F.round(F.try_divide(F.col("detected"), F.col("episodes")), 6).alias("recall"),
        F.round(F.try_divide(F.col("hits"), F.col("alerts")), 6).alias("precision"),
        F.round(F.col("alerts") / F.col("sessions") * TRADING_DAYS, 6).alias("alerts_per_year"),
        (F.col("alerts") - F.col("hits")).alias("false_sessions"),
    )


def signal_rate(signals: DataFrame) -> DataFrame:
    """Rising edges a year of `signal`."""
    w = ts.series("symbol")
    edge = signals.withColumn("edge", F.when(F.col("signal") - F.lag("signal").over(w) == 1, 1))
    return edge.groupBy("symbol").agg(F.round(F.coalesce(F.sum("edge"), F.lit(0)) / F.count(F.lit(1)) * TRADING_DAYS, 6).alias("rate"))


def current_exposures(prices: DataFrame, s: Ledger = Ledger()) -> DataFrame:
    """The last session's exposures, decided the session before, and today's triggers."""
    w = ts.series("symbol")
    e = benchmark_exposures(prices, s)
    e = e.withColumns({"ma": ts.rolling_mean(F.col("p"), w, s.trend_window), "vol": ts.rolling_volatility(F.col("r"), w, s.volatility_window)})
    last = e.groupBy("symbol").agg(F.max_by(F.struct(*e.columns[1:]), "session").alias("x")).select("symbol", "x.*")
    return last.select("symbol", "session", *(F.round(c, 6).alias(c) for c in STRATEGIES), F.round("ma", 6).alias("trend_level"), F.round("vol", 6).alias("volatility"), (F.col("p") > F.col("ma")).alias("above_trend"))


def run_lengths(rows: DataFrame) -> DataFrame:
    """symbol, session, present -> length of each run of presence."""
    w = ts.series("symbol")
    r = rows.withColumn("new", ts.changed(F.col("present"), w))
    r = r.withColumn("run", ts.run_id(F.col("new"), w))
    return r.where("present").groupBy("symbol", "run").agg(F.min("session").alias("starts"), F.count(F.lit(1)).alias("length"))


def threshold_search(ranks: DataFrame, target: float, grid: tuple[int, int] = (50, 98)) -> DataFrame:
    """The threshold (in hundredths) whose rate of rising edges is nearest the target; the first of equals."""
    w = ts.series("symbol", "grid")
    tried = ranks.where("rank is not null").withColumn("grid", F.explode(F.sequence(F.lit(grid[0]), F.lit(grid[1])))).withColumn("signal", (F.col("rank") >= F.col("grid") / 100).cast("int"))
    edge = tried.withColumn("edge", F.when(F.col("signal") - F.lag("signal").over(w) == 1, 1))
    rates = edge.groupBy("symbol", "grid").agg((F.coalesce(F.sum("edge"), F.lit(0)) / F.count(F.lit(1)) * TRADING_DAYS).alias("rate"))
    best = rates.groupBy("symbol").agg(F.min_by(F.struct("grid", "rate"), F.struct(F.abs(F.col("rate") - target), F.col("grid"))).alias("x"))
    return best.select("symbol", "x.grid", F.round("x.rate", 6).alias("rate"))
