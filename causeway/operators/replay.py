"""Replay of a rule through the event machine against a volatility rule of the same frequency, and its verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import timeseries as ts
from causeway.operators import ledger, research
from causeway.settings import EPISODE_GAP, EVENT_DEPTH, EVENT_HORIZON, TRADING_DAYS
from causeway.streaming import events

#: Openings a year that a reader puts up with, and the gap in recall that counts as harm.
BUDGET, MARGIN = 12.0, 0.05
GRID = (50, 98)
NAME = "trend_rule_vs_drawdown_event_replay_v1"


def _stood(rows: DataFrame, label: str, present) -> DataFrame:
    """symbol, session, signal: `present` through the event machine, one machine per symbol."""
    keyed = rows.select(F.concat_ws("/", "symbol", F.lit(label)).alias("label"), "session", F.coalesce(present, F.lit(False)).alias("present"))
    stood = events.standing(keyed)
    return stood.select(F.split("label", "/")[0].alias("symbol"), "session", F.col("open").cast("int").alias("signal"))


def rate_of(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Openings a year of `signal`."""
    w = ts.series(*keys)
    edge = signals.withColumn("edge", F.when(F.col("signal") - F.lag("signal").over(w) == 1, 1))
    return edge.groupBy(*keys).agg((F.coalesce(F.sum("edge"), F.lit(0)) / F.count(F.lit(1)) * TRADING_DAYS).alias("rate"))


def inputs(prices: DataFrame) -> DataFrame:
    """symbol, session, i, p -> also the event, the trend rule decided the session before, and the causal rank of volatility with that of the session before."""
    w = ts.series("symbol")
    rows = prices.withColumns({"r": ts.pct_change(F.col("p"), w), "event": ts.forward_drawdown_event(F.col("p"), w, EVENT_HORIZON, EVENT_DEPTH)})
    rows = rows.withColumns({"vol": ts.rolling_volatility(F.col("r"), w, 20), "below": F.lag(F.col("p") <= ts.rolling_mean(F.col("p"), w, 200)).over(w)})
    rows = ts.causal_percentile(rows, ["symbol"], "session", "vol", "rank")
    return rows.withColumn("rank_before", F.lag("rank").over(w))


def matched_threshold(rows: DataFrame, target: DataFrame, grid: tuple[int, int] = GRID) -> DataFrame:
    """symbol, grid, gap: the percentile (in hundredths) whose alerts open as often a year as the target; the first of equals.

    Each percentile is a machine of its own, so they run side by side.
    """
    tried = rows.withColumn("grid", F.explode(F.sequence(F.lit(grid[0]), F.lit(grid[1]))))
    keyed = tried.select(F.concat_ws("/", "symbol", F.col("grid").cast("string")).alias("label"), "session", F.coalesce(F.col("rank") >= F.col("grid") / 100, F.lit(False)).alias("present"))
    parts = F.split("label", "/")
    signals = events.standing(keyed).select(parts[0].alias("symbol"), parts[1].cast("int").alias("grid"), "session", F.col("open").cast("int").alias("signal"))
    rates = rate_of(signals, ["symbol", "grid"]).join(target, "symbol").withColumn("gap", F.abs(F.col("rate") - F.col("target")))
    best = rates.groupBy("symbol").agg(F.min_by(F.struct("grid", "rate"), F.struct("gap", "grid")).alias("x"))
    return best.select("symbol", "x.grid", F.col("x.rate").alias("matched_rate"))


def recall(signals: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """symbol, episodes, detected: episodes in which the signal stands at some session whose event is settled.

    Rows look up the episode that began last; no pair of episode and session becomes a row.
    """
    w = ts.series("symbol")
    starts = found.select("symbol", F.col("first_session").alias("session"), F.struct("episode", "last_session").alias("e"))
    seen = rows.where("event is not null").select("symbol", "session").join(signals, ["symbol", "session"]).join(starts, ["symbol", "session"], "left")
    seen = seen.withColumn("e", F.last("e", True).over(w))
    hit = seen.where((F.col("signal") == 1) & (F.col("session") <= F.col("e.last_session"))).select("symbol", F.col("e.episode").alias("episode")).distinct()
    n = found.groupBy("symbol").agg(F.count(F.lit(1)).alias("episodes"))
    return n.join(hit.groupBy("symbol").agg(F.count(F.lit(1)).alias("detected")), "symbol", "left").na.fill(0, ["detected"])


def measure(prices: DataFrame, train_end: str, budget: float = BUDGET, margin: float = MARGIN) -> DataFrame:
    """One row per symbol: the threshold matched on the training sessions, recall and rate of both rules after them, and the verdict.

    PASSED needs more recall within the budget; less recall by over the margin is harm; anything else is too little evidence.
    """
    end = F.lit(train_end).cast("date")
    rows = inputs(prices)
    candidate = _stood(rows, "trend", F.col("below"))
    target = rate_of(candidate.where(F.col("session") <= end), ["symbol"]).withColumnRenamed("rate", "target")
    threshold = matched_threshold(rows.where(F.col("session") <= end), target)
    against = rows.join(threshold, "symbol")
    comparator = _stood(against, "volatility", F.col("rank_before") >= F.col("grid") / 100)
    found = ledger.episodes(rows.withColumn("flag", F.col("event")), EPISODE_GAP)
    tested = found.where(F.col("first_session") > end)
    trained = found.where(F.col("last_session") <= end).groupBy("symbol").agg(F.count(F.lit(1)).alias("train_episodes"))
    out = target.join(threshold, "symbol").join(trained, "symbol", "left")
    for name, signals in (("candidate", candidate), ("comparator", comparator)):
        r = recall(signals, rows, tested).select("symbol", F.col("episodes").alias("test_episodes"), F.coalesce(F.try_divide(F.col("detected"), F.col("episodes")), F.lit(0.0)).alias(f"{name}_recall"))
        rate = rate_of(signals.where(F.col("session") > end), ["symbol"]).withColumnRenamed("rate", f"{name}_rate")
        out = out.join(r.drop("test_episodes") if name == "comparator" else r, "symbol", "left").join(rate, "symbol", "left")
    gap = F.col("candidate_recall") - F.col("comparator_recall")
    verdict = F.when((F.col("candidate_rate") <= budget) & (gap > 0), "passed").when(gap < -margin, "evidence_of_harm").otherwise("insufficient_evidence")
    return out.na.fill(0, ["train_episodes", "test_episodes"]).withColumns({"recall_gap": gap, "verdict": verdict})


def record(kept: list[research.Experiment], verdict: str, detail: str, value: float | None = None) -> list[research.Experiment]:
    """The registry with this replay's experiment once, whatever was recorded of it before."""
    e = research.Experiment(name=NAME, capability=research.CAPABILITIES[1], hypothesis="the trend rule warns better than a volatility rule of its frequency", primary_metric="recall of episodes within the budget", family="trend-rule-replays")
    e = e.concluded(verdict, detail)
    if verdict == research.OUTCOMES[0]:
        e = e.promoted(research.LADDER[1], metric=e.primary_metric, value=str(value), benchmark="volatility rule of equal frequency", window="after training")
    return [*(x for x in kept if x.name != NAME), e]
