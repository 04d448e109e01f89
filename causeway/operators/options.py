"""Protective option candidates: plan, resolve, attach, screen, price, and shortlist.

Rejected candidates stay: each stage moves a row's status on, so joins are left joins and filters are cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.functions import timeseries as ts
from causeway.settings import EXPIRY_BUCKETS, MONEYNESS, MOVES, PARITY_SLOPE, STRIKE_DRIFT, ScreenLimits


def parse_expiry(x: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(x, F.lit("yyyyMMdd")), F.try_to_timestamp(x, F.lit("yyyy-MM-dd"))).cast("date")


def select_chain(chains: DataFrame) -> DataFrame:
    """symbol, trading_class, strike_count: the class named like the symbol if there is one, then the widest, then the first name."""
    named = (F.upper("trading_class") == F.upper("symbol")).cast("int")
    best = chains.groupBy("symbol").agg(F.min_by(F.struct("trading_class", "strike_count"), F.struct(-named, -F.col("strike_count"), F.col("trading_class"))).alias("x"))
    return best.select("symbol", "x.*")


def select_expiries(expiries: DataFrame) -> DataFrame:
    """symbol, expiry, days -> for each bucket (both ends inside) the nearest expiry; an empty bucket keeps its row."""
    each = F.array(*(F.struct(F.lit(n).alias("bucket"), F.lit(a).alias("fewest"), F.lit(b).alias("most")) for n, a, b in EXPIRY_BUCKETS))
    b = expiries.select("symbol").distinct().select("symbol", F.explode(each).alias("b")).select("symbol", "b.*")
    joined = b.join(expiries, "symbol", "left").withColumn("fits", F.col("days").between(F.col("fewest"), F.col("most")))
    g = joined.groupBy("symbol", "bucket").agg(F.min(F.when(F.col("fits"), F.struct("days", "expiry"))).alias("x"))
    return g.select("symbol", "bucket", "x.expiry", "x.days", F.when(F.col("x").isNull(), "no_listed_expiry").otherwise("proposed").alias("status"))


def nearest_strike(targets: DataFrame, strikes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `strike`: the listed one nearest to `target`, the lower of equals; null where none is listed.

    Strikes are gathered into one sorted array per key (a chain lists hundreds) and searched there, so no pair of
    target and strike becomes a row.
    """
    listed = strikes.where("strike > 0").groupBy(*keys).agg(F.array_sort(F.collect_set("strike")).alias("listed"))
    out = targets.join(listed, keys, "left")
    best = F.array_min(F.transform("listed", lambda k: F.struct(F.abs(k - F.col("target")).alias("gap"), k.alias("strike"))))
    return out.withColumn("strike", best["strike"]).drop("listed")


def plan_candidates(expiries: DataFrame, strikes: DataFrame, spots: DataFrame) -> DataFrame:
    """One row per symbol, bucket and moneyness with the strike that is listed nearest."""
    grid = expiries.withColumn("moneyness", F.explode(F.array(*map(F.lit, MONEYNESS)))).join(spots, "symbol")
    grid = grid.withColumn("target", F.col("spot") * (1 + F.col("moneyness")))
    out = nearest_strike(grid, strikes, ["symbol", "expiry"])
    drift = F.abs(F.col("strike") / F.col("target") - 1)
    status = F.when(F.col("status") != "proposed", F.col("status")).when(F.col("strike").isNull(), "no_listed_strike").when(drift > STRIKE_DRIFT, "strike_far_from_target").otherwise("proposed")
    return out.withColumns({"drift": drift, "status": status})


def resolve_strikes(candidates: DataFrame, listed: DataFrame) -> DataFrame:
    """Proposed rows against the strikes really listed for their expiry; the proposal is kept beside the result."""
    known = listed.select("symbol", "expiry").distinct().withColumn("known", F.lit(True))
    rows = candidates.withColumnRenamed("strike", "strike_proposed").drop("drift")
    out = nearest_strike(rows, listed, ["symbol", "expiry"]).join(known, ["symbol", "expiry"], "left")
    far = F.abs(F.col("strike") / F.col("target") - 1) > STRIKE_DRIFT
    status = F.when(F.col("status") != "proposed", F.col("status")).when(F.col("known").isNull(), "expiry_not_listed").when(F.col("strike").isNull(), "no_listed_strike").when(far, "strike_far_from_target").otherwise("ok")
    return out.withColumn("status", status).drop("known")


def attach_contracts(candidates: DataFrame, contracts: DataFrame) -> DataFrame:
    """con_id by expiry and strike, for rows that are ok; the last contract (largest id) of equal keys."""
    one = contracts.groupBy("expiry", "strike").agg(F.max("con_id").alias("con_id"))
    out = candidates.join(one, ["expiry", "strike"], "left")
    ok = F.col("status") == "ok"
    return out.withColumns({"con_id": F.when(ok, F.col("con_id")), "status": F.when(ok & F.col("con_id").isNull(), "not_qualified").otherwise(F.col("status"))})


def attach_quotes(candidates: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes by con_id for rows that are ok: no_quote_returned, no_ask, or priced, with mid and relative spread."""
    q = quotes.withColumn("quoted", F.lit(True))
    out = candidates.join(q, "con_id", "left")
    ok = F.col("status") == "ok"
    ask, bid = ts.cleaned(F.col("ask")), ts.cleaned(F.col("bid"))
    usable = ask > 0
    status = F.when(~ok, F.col("status")).when(F.col("quoted").isNull(), "no_quote_returned").when(~F.coalesce(usable, F.lit(False)), "no_ask").otherwise("priced")
    both = usable & (bid > 0)
    return out.withColumns({"status": status, "mid": F.when(both, (ask + bid) / 2), "relative_spread": F.when(both, (ask - bid) / ask)}).drop("quoted")


def quotable(candidates: DataFrame) -> DataFrame:
    """Rows whose contract is known to be listed: only on these is a quote request spent."""
    return candidates.where("status = 'ok'")


def put_quotes(candidates: DataFrame, multiplier: int = 100) -> DataFrame:
    """The priced rows as typed quotes; a one-sided book keeps its bid null, so that no spread is invented."""
    typed = {"symbol": "string", "expiry": "string", "strike": "double", "bid": "double", "ask": "double", "con_id": "long", "age": "double"}
    return candidates.where("status = 'priced'").select(*(F.col(c).cast(t).alias(c) for c, t in typed.items()), F.lit(multiplier).alias("multiplier"))


def spot_of_book(quotes: DataFrame) -> DataFrame:
    """symbol, basis, close, last -> the spot of the same feed and regime as the book: a frozen one's close, else the last; the other where that is missing."""
    close, last = (F.when(ts.finite(F.col(c)) & (F.col(c) > 0), F.col(c)) for c in ("close", "last"))
    return quotes.withColumn("spot", F.when(F.col("basis").isin(*FROZEN), F.coalesce(close, last)).otherwise(F.coalesce(last, close)))


def median_horizon(candidates: DataFrame, bucket: str, default: float = 30.0) -> DataFrame:
    """symbol, horizon: the median of days to the expiries chosen in a bucket, the default where it has none."""
    days = candidates.groupBy("symbol").agg(F.expr(f"percentile(case when bucket = '{bucket}' then days end, 0.5)").alias("horizon"))
    return days.select("symbol", F.coalesce("horizon", F.lit(default)).alias("horizon"))


#: Books that stand still, wholly or in part.
FROZEN = ("frozen", "mixed")


def screen(candidates: DataFrame, market_open: bool, limits: ScreenLimits = ScreenLimits()) -> DataFrame:
    """Adds `qualification`, `reasons`, `notes` and `screened`. `basis` is live, frozen or mixed; a mixed book counts as frozen."""
    priced = F.col("status") == "priced"
    frozen = F.coalesce(F.col("basis").isin(*FROZEN), F.lit(False))
    age = F.col("age")
    old = age > limits.max_age_seconds
    regime = F.when(~priced, "UNAVAILABLE").when(frozen, F.lit("DEGRADED" if market_open else "VALID")).when(age.isNull() | old, "DEGRADED").otherwise("VALID")
    why = (
        F.when(~priced, F.concat(F.lit("not priced: "), F.col("status")))
        .when(frozen, "frozen book in a trading session" if market_open else "frozen at the last close")
        .when(age.isNull(), "no usable time of the quote")
        .when(old, "quote too old")
        .otherwise("quote fresh")
    )
    spread, interest = F.col("relative_spread"), F.col("open_interest")
    wide, thin = spread > limits.max_relative_spread, interest < limits.min_open_interest
    reasons = F.concat_ws("; ", F.when(wide, "wide spread"), F.when(thin, "thin open interest"))
    notes = F.concat_ws("; ", why, F.when(spread.isNull(), "spread unknown"), F.when(interest.isNull(), "open interest absent"))
    absent = spread.isNull() | interest.isNull()
    out = F.when(~priced, regime).when(reasons != "", "QUARANTINED").when(absent, "DEGRADED").otherwise(regime)
    rows = candidates.withColumns({"reasons": reasons, "qualification": out, "notes": notes})
    return rows.withColumn("screened", F.col("qualification").isin("VALID", "DEGRADED") & (F.col("reasons") == ""))


def screened(candidates: DataFrame) -> DataFrame:
    """Rows that cleared every hard limit."""
    return candidates.where("screened")


def put_call_parity(pairs: DataFrame) -> DataFrame:
    """expiry, days, strike, put_mid, call_mid, half_spread -> a line through call - put by strike, and what it implies."""
    rows = pairs.where("put_mid is not null and call_mid is not null").withColumn("y", F.col("call_mid") - F.col("put_mid"))
    fit = rows.groupBy("expiry", "days").agg(F.regr_slope("y", "strike").alias("slope"), F.regr_intercept("y", "strike").alias("intercept"), F.count(F.lit(1)).alias("pairs"))
    resid = rows.join(fit, ["expiry", "days"]).withColumn("residual", F.abs(F.col("y") - F.col("intercept") - F.col("slope") * F.col("strike")))
    worst = resid.groupBy("expiry", "days").agg(
        F.first("slope").alias("slope"),
        F.first("intercept").alias("intercept"),
        F.first("pairs").alias("pairs"),
        F.max("residual").alias("worst"),
        F.bool_or(F.col("residual") > 2 * F.col("half_spread")).alias("broken"),
    )
    falls = F.col("slope") < 0
    status = (
        F.when(F.col("pairs") < 2, "too_few_pairs")
        .when(~F.col("slope").between(*PARITY_SLOPE), "slope_out_of_band")
        .when(F.col("pairs") == 2, "slope_only")
        .when(F.col("broken"), "violated")
        .otherwise("ok")
    )
    return worst.select("expiry", "days", "pairs", "slope", F.when(falls, -F.col("intercept") / F.col("slope")).alias("forward"), F.when(falls, -F.log(-F.col("slope")) / (F.col("days") / 365)).alias("rate"), "worst", status.alias("status"))


def parity_verdict(parity: DataFrame) -> DataFrame:
    g = parity.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("status") == "ok").alias("all_ok"), F.bool_or(F.col("status").isin("violated", "slope_out_of_band")).alias("bad"))
    return g.select("n", F.when(F.col("n") == 0, "unverified").when(F.col("all_ok"), "ok").when(F.col("bad"), "failed").otherwise("unverified").alias("verdict"))


def staleness(quotes: DataFrame, last_session: str | None = None, last_close: str | None = None, now: str | None = None) -> DataFrame:
    """What kinds of data a book holds and how old it is.

    A live book's age is that of its oldest tick. A frozen book has no tick age: it belongs to the last session and is as old
    as that session's close (times in UTC).
    """
    stands = F.col("data_type").isin(2, 4)
    g = quotes.groupBy("part").agg(F.array_join(F.array_sort(F.collect_set("data_type")), ",").alias("types"), F.max("age").alias("oldest"), F.bool_and(stands).alias("frozen"), F.bool_or(stands).alias("some"))
    hours = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.lit(last_close).cast("timestamp"))) / 3600
    return g.select(
        "part",
        "types",
        F.when(F.col("frozen"), "frozen").when(F.col("some"), "mixed").otherwise("live").alias("basis"),
        F.when(~F.col("frozen"), F.col("oldest")).alias("oldest_age"),
        F.when(F.col("some"), F.lit(last_session).cast("date")).alias("book_session"),
        F.when(F.col("some"), hours).alias("book_age_hours"),
    )


def payoff_fault(strike: str | None = "strike", ask: str | None = "ask") -> Column:
    """Why a row can't be priced to expiry: each of spot, notional, strike, ask and multiplier must be a positive number."""
    need = ["spot", "notional", *filter(None, (strike, ask))]
    bad = lambda c: ~(ts.finite(F.col(c)) & (F.col(c) > 0))
    return F.coalesce(*(F.when(bad(c), F.lit(f"{c} isn't a positive number")) for c in need))


def checked(rows: DataFrame, strike: str | None = "strike", ask: str | None = "ask") -> DataFrame:
    """The rows unchanged; evaluating one that can't be priced raises."""
    fault = payoff_fault(strike, ask)
    return rows.withColumn("spot", F.when(fault.isNull(), F.col("spot")).otherwise(F.raise_error(fault)))


def _share(name: str, x: float, low: float, high: float, open_low: bool = False) -> None:
    if not (low < x if open_low else low <= x) or x > high:
        raise ValueError(f"{name} must lie in {'(' if open_low else '['}{low}, {high}]")


def size_protection(rows: DataFrame, coverage: float = 1.0, multiplier: int = 100) -> DataFrame:
    """spot, notional -> whole contracts, and the shares of all held that they leave uncovered."""
    _share("coverage", coverage, 0.0, float("inf"), open_low=True)
    _share("multiplier", multiplier, 0, float("inf"), open_low=True)
    shares = F.col("notional") / F.col("spot")
    n = F.floor(shares * coverage / multiplier)
    return rows.withColumns({"shares": shares, "contracts": n, "covered": n * multiplier, "coverage_ratio": n * multiplier / shares, "uncovered": shares - n * multiplier})


def put_scenarios(rows: DataFrame, moves=MOVES, fee: float = 0.65, multiplier: int = 100, coverage: float = 1.0) -> DataFrame:
    """Payoff at expiry for each move: bought at the ask, with fees."""
    sized = size_protection(rows, coverage, multiplier).withColumn("move", F.explode(F.array(*map(F.lit, moves))))
    after = F.col("spot") * (1 + F.col("move"))
    outlay = F.col("contracts") * (F.col("ask") * multiplier + fee)
    payoff = F.col("contracts") * multiplier * F.greatest(F.col("strike") - after, F.lit(0.0))
    plain = F.col("shares") * (after - F.col("spot"))
    return sized.withColumns({"outlay": outlay, "payoff": payoff, "unhedged_pnl": plain, "hedged_pnl": plain + payoff - outlay})


def reduced_exposure(rows: DataFrame, keep: float = 0.8, days: int = 30, cash_rate: float = 0.0, exit_bps: float = 2.0, moves=MOVES) -> DataFrame:
    """Selling part instead: the kept part moves; leaving costs basis points, and what is left of the sale earns its carry."""
    _share("keep", keep, 0.0, 1.0)
    sold = F.col("notional") * (1 - keep)
    cost = sold * exit_bps / 10_000
    carry = (sold - cost) * cash_rate * days / 365
    out = rows.withColumn("move", F.explode(F.array(*map(F.lit, moves))))
    plain = F.col("notional") * F.col("move")
    return out.withColumns({"cost": cost, "carry": carry, "unhedged_pnl": plain, "pnl": plain * keep + carry - cost})


def no_protection(rows: DataFrame, moves=MOVES) -> DataFrame:
    plain = F.col("notional") * F.col("move")
    return rows.withColumn("move", F.explode(F.array(*map(F.lit, moves)))).withColumns({"cost": F.lit(0.0), "unhedged_pnl": plain, "pnl": plain})


def candidate_summary(scenarios: DataFrame, key: str) -> DataFrame:
    """Worst, flat and best move of each candidate."""
    return scenarios.groupBy(key).agg(F.first("outlay").alias("cost"), F.min_by("hedged_pnl", "move").alias("worst"), F.min_by("hedged_pnl", F.struct(F.abs("move"), "move")).alias("flat"), F.max_by("hedged_pnl", "move").alias("best"))


def control_summary(scenarios: DataFrame, label: str, structure: str) -> DataFrame:
    """A control in the shape of a candidate: no strike, expiry or contracts, and no coverage."""
    g = scenarios.groupBy("symbol").agg(
        F.first("notional").alias("notional"),
        F.first("cost").alias("cost"),
        F.min_by("pnl", "move").alias("worst"),
        F.min_by("unhedged_pnl", "move").alias("unhedged_worst"),
        F.min_by("pnl", F.struct(F.abs("move"), "move")).alias("flat"),
        F.max_by("pnl", "move").alias("best"),
    )
    absent = {"expiry": "string", "strike": "double", "moneyness": "double", "contracts": "long", "uncovered": "double"}
    return g.select(
        "symbol",
        F.lit(label).alias("label"),
        F.lit(structure).alias("structure"),
        *(F.lit(None).cast(t).alias(c) for c, t in absent.items()),
        F.lit(0.0).alias("coverage_ratio"),
        "cost",
        (F.col("cost") / F.col("notional")).alias("cost_share"),
        "flat",
        "best",
        "unhedged_worst",
        "worst",
        (F.col("worst") - F.col("unhedged_worst")).alias("protection_at_worst"),
    )


def controls(spots: DataFrame, keep: float = 0.8, days: int = 30, cash_rate: float = 0.0) -> DataFrame:
    """The two controls of each symbol, of repeated (symbol, label) rows the first."""
    rows = control_summary(no_protection(spots), "no new protection", "unhedged")
    less = control_summary(reduced_exposure(spots, keep, days, cash_rate), f"reduce to {keep:.0%}", "de-risked")
    return rows.unionByName(less).dropDuplicates(["symbol", "label"])


def shortlist(candidates: DataFrame, limits: ScreenLimits = ScreenLimits(), most: int = 3, horizon: str | None = None) -> DataFrame:
    """All candidates with `shortlisted` and `reason`: at most `most` of distinct depth in one horizon, nearest the money first.

    The horizon is the asked one if a symbol has an affordable candidate in it, else its first. Too dear ones say so; the rest
    isn't in the chosen horizon. `cost_share` null counts as affordable.
    """
    fits = F.coalesce(F.col("cost_share") <= limits.max_cost_share, F.lit(True))
    s = W.partitionBy("symbol")
    affordable = F.when(fits, F.col("bucket"))
    asked = F.lit(horizon).cast("string")
    chosen = F.coalesce(F.when(F.max(F.coalesce(affordable == asked, F.lit(False))).over(s), asked), F.min(affordable).over(s))
    rows = candidates.withColumns({"_fits": fits, "_chosen": chosen})
    inside = F.col("_fits") & (F.col("bucket") == F.col("_chosen"))
    order = W.partitionBy("symbol", "_in", "moneyness").orderBy("cost_share", "con_id")
    rows = rows.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_k", F.row_number().over(order))
    rows = rows.withColumn("_first", F.col("_in") & (F.col("_k") == 1))
    place = F.row_number().over(W.partitionBy("symbol").orderBy(F.col("_first").desc(), F.col("moneyness").desc(), "con_id"))
    taken = F.col("_first") & (F.col("_place") <= most)
    depth = F.concat(F.round(F.col("moneyness") * 100).cast("int").cast("string"), F.lit("% protection depth in "), F.col("bucket"))
    reason = F.when(taken, depth).when(~F.col("_fits"), f"cost over {limits.max_cost_share:.0%} of the notional").otherwise("not in the chosen horizon")
    return rows.withColumn("_place", place).withColumns({"shortlisted": taken, "reason": reason}).drop("_fits", "_chosen", "_in", "_k", "_first", "_place")


def data_status(candidates: DataFrame) -> DataFrame:
    g = candidates.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("status") == "priced").alias("priced"))
    return g.select("symbol", F.when(F.col("n") == 0, "no_data").when(F.col("priced"), "screened_out").otherwise("data_insufficient").alias("data_status"))


def protection_table(expiries: DataFrame, strikes: DataFrame, listed: DataFrame, spots: DataFrame, contracts: DataFrame, quotes: DataFrame, market_open: bool = False, limits: ScreenLimits = ScreenLimits(), horizon: str | None = None) -> DataFrame:
    """Plan, resolve, attach, quote, screen, price and shortlist for all symbols at once, the controls below the candidates.

    One row per candidate and control with the columns of `control_summary`, `status`, `qualification`, `shortlisted` and `reason`.
    """
    planned = plan_candidates(select_expiries(expiries), strikes, spots)
    quoted = attach_quotes(attach_contracts(resolve_strikes(planned, listed), contracts), quotes)
    rows = screen(quoted, market_open, limits)
    priced = put_scenarios(checked(screened(rows)))
    key = F.struct("symbol", "bucket", "expiry", "strike", "moneyness", "con_id", "qualification", "notional", "contracts", "uncovered", "coverage_ratio", "status")
    worst = F.min_by("unhedged_pnl", "move").alias("unhedged_worst")
    priced = priced.withColumn("key", key)
    sums = candidate_summary(priced, "key").join(priced.groupBy("key").agg(worst), "key").select("key.*", "cost", "worst", "flat", "best", "unhedged_worst")
    sums = sums.withColumns({"cost_share": F.col("cost") / F.col("notional"), "protection_at_worst": F.col("worst") - F.col("unhedged_worst"), "label": F.concat_ws(" ", "expiry", F.col("strike").cast("string")), "structure": F.lit("protective put")})
    listed_rows = shortlist(sums, limits, horizon=horizon).drop("notional")
    return listed_rows.unionByName(controls(spots), allowMissingColumns=True)
