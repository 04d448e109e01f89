"""Findings on bars and quotes, source health, and agreement of two sources.

Findings are rows; nothing is repaired. A finding has a severity (quarantine, review, note) and the purposes it blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from causeway.functions import timeseries as ts
from causeway.settings import SECURITY_TYPES_WITH_POSITIVE_PRICES, TOLERANCE_FLOOR, TOLERANCE_MULTIPLE, TOLERANCE_WINDOW

ALL_BLOCKED = ("training", "day_end", "quotes")
STRUCTURAL = ("price_not_finite", "price_not_positive", "ohlc_inverted", "ohlc_bounds_violated", "price_scale_break")
#: Findings as a table of their own, empty where nothing was found.
ISSUES = "symbol string, session date, code string, severity string, detail string, blocks array<string>"


def finding(when: Column, code: str, severity: str, blocks: tuple[str, ...] = (), detail: Column | None = None) -> Column:
    """The finding where the condition holds, else null."""
    return F.when(
        when,
        F.struct(
            F.lit(code).alias("code"),
            F.lit(severity).alias("severity"),
            (detail if detail is not None else F.lit(None)).cast("string").alias("detail"),
            F.array(*map(F.lit, blocks)).cast("array<string>").alias("blocks"),
        ),
    )


def found(rows: DataFrame, findings: list[Column], keep: list[str]) -> DataFrame:
    """One row per finding: a single pass over the rows, no join."""
    issues = rows.select(*keep, F.explode(F.filter(F.array(*findings), lambda x: x.isNotNull())).alias("f"))
    return issues.select(*keep, "f.code", "f.severity", "f.detail", "f.blocks")


def no_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ISSUES)


def validate_bars(bars: DataFrame, jump: float = 0.20) -> DataFrame:
    """Checks of each bar and of its change from the last close."""
    w = ts.series("symbol")
    rows = bars.withColumn("ratio", F.try_divide(F.col("close"), F.lag("close").over(w)))
    rows = rows.withColumn("scale", ts.scale_factor(F.col("ratio")))
    prices = ["open", "high", "low", "close"]
    traded = F.col("sec_type").isin(*SECURITY_TYPES_WITH_POSITIVE_PRICES)
    whole = F.lit(True)
    for c in prices:
        whole = whole & ts.finite(F.col(c))
    outside = lambda c: (F.col(c) < F.col("low")) | (F.col(c) > F.col("high"))
    out = []
    for c in prices:
        out.append(finding(~ts.finite(F.col(c)), "price_not_finite", "quarantine", ALL_BLOCKED, F.lit(c)))
        out.append(finding(traded & ts.finite(F.col(c)) & (F.col(c) <= 0), "price_not_positive", "quarantine", ALL_BLOCKED, F.lit(c)))
    out += [
        finding(whole & (F.col("high") < F.col("low")), "ohlc_inverted", "quarantine", ALL_BLOCKED),
        *(finding(whole & outside(c), "ohlc_bounds_violated", "quarantine", ALL_BLOCKED, F.lit(c)) for c in ("open", "close")),
        finding(F.col("scale").isNotNull(), "price_scale_break", "quarantine", ALL_BLOCKED),
        finding(F.col("scale").isNull() & (F.col("ratio") > 0) & (F.abs(F.col("ratio") - 1) > jump), "large_price_move", "review"),
        finding(F.col("volume_unit").isNull(), "volume_unit_undeclared", "note"),
        finding(F.col("volume").isNull(), "volume_missing", "note"),
        finding((F.col("volume") == 0) & traded, "volume_zero", "note"),
    ]
    return found(rows, out, ["symbol", "session"])


def duplicate_rows(bars: DataFrame, by: tuple[str, ...] = ("symbol", "session")) -> DataFrame:
    """Keys that occur more than once, told apart by whether their rows agree; a null agrees with a null only."""
    rest = [c for c in bars.columns if c not in by]
    content = F.struct(*rest) if rest else F.struct(F.lit(1))
    g = bars.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(content).alias("distinct")).where(F.col("rows") > 1)
    same = F.col("distinct") == 1
    return g.select(*by, F.when(same, "duplicate_row_identical").otherwise("duplicate_row_conflict").alias("code"), F.when(same, "note").otherwise("quarantine").alias("severity"), "rows")


def validate_quotes(quotes: DataFrame, frozen: bool = False) -> DataFrame:
    """crossed book, zero bid, last outside the book (one summary note for a frozen book), implied-volatility sentinel."""
    bid, ask, last = F.col("bid"), F.col("ask"), F.col("last")
    book = ts.finite(bid) & ts.finite(ask)
    outside = book & ts.finite(last) & ((last < bid) | (last > ask))
    checks = [
        finding(book & (bid > ask), "crossed_book", "review"),
        finding(bid == 0, "zero_bid", "note"),
        finding(F.col("implied_volatility") <= 0, "implied_vol_sentinel", "note"),
    ]
    if not frozen:
        return found(quotes, [*checks, finding(outside, "last_outside_book", "note")], ["con_id"])
    n = quotes.agg(F.count(F.when(outside, 1)).alias("n")).where("n > 0")
    summary = n.select(F.lit(None).cast("long").alias("con_id"), F.lit("last_outside_frozen_book").alias("code"), F.lit("note").alias("severity"), F.col("n").cast("string").alias("detail"), F.array().cast("array<string>").alias("blocks"))
    return found(quotes, checks, ["con_id"]).unionByName(summary)


def drop_quarantined(bars: DataFrame, issues: DataFrame) -> DataFrame:
    bad = issues.where("severity = 'quarantine'").select("symbol", "session").distinct()
    return bars.join(bad, ["symbol", "session"], "left_anti")


def stale_series(rows: DataFrame, value: str = "close", repeats: int = 5) -> DataFrame:
    """The longest constant run of each series (the first of equals), if at least `repeats` long."""
    w = ts.series("symbol")
    r = rows.where(F.col(value).isNotNull()).withColumn("new", ts.changed(F.col(value), w))
    r = r.withColumn("run", ts.run_id(F.col("new"), w))
    runs = r.groupBy("symbol", "run").agg(F.count(F.lit(1)).alias("length"), F.min("session").alias("starts"))
    best = runs.groupBy("symbol").agg(F.max_by(F.struct("length", "starts"), F.struct(F.col("length"), -F.col("run"))).alias("x"))
    return best.select("symbol", "x.length", "x.starts").where(F.col("length") >= repeats)


def attribute_moves(moves: DataFrame, actions: DataFrame, known_by: str, tolerance: float = 0.02) -> DataFrame:
    """symbol, session, move -> explained by an action known in time: a split by its ratio, a dividend always."""
    a = actions.where(F.col("known_at") <= F.lit(known_by).cast("date")).select("symbol", F.col("effective_at").alias("session"), "kind", "ratio", "action_id")
    joined = moves.join(a, ["symbol", "session"], "left")
    fits = F.when(F.col("kind") == "split", F.abs((1 + F.col("move")) * F.col("ratio") - 1) <= tolerance).otherwise(F.col("kind") == "dividend")
    hit = joined.groupBy("symbol", "session", "move").agg(F.min(F.when(fits, F.col("action_id"))).alias("action_id"))
    explained = F.col("action_id").isNotNull()
    return hit.select("symbol", "session", F.round("move", 6).alias("move"), "action_id", F.when(explained, "move_explained_by_corporate_action").otherwise("large_price_move").alias("code"), F.when(explained, "note").otherwise("review").alias("severity"))


def last_bar_incomplete(bars: DataFrame, complete: Column) -> DataFrame:
    """The last bar of each symbol, if its session isn't over."""
    last = bars.groupBy("symbol").agg(F.max("session").alias("session")).where(~complete)
    return last.select("symbol", "session", F.lit("last_bar_incomplete").alias("code"), F.lit("quarantine").alias("severity"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Counts by code and severity and the purposes that each blocks, sorted."""
    return issues.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("subjects"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("blocks")))), ",").alias("blocked"))


def crisis_gate(issues: DataFrame, symbols: DataFrame) -> DataFrame:
    """Whether a crisis reading is allowed: no structural quarantine on the symbol."""
    bad = issues.where((F.col("severity") == "quarantine") & F.col("code").isin(*STRUCTURAL)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return symbols.join(bad, "symbol", "left").select("symbol", F.coalesce("n", F.lit(0)).alias("structural"), F.col("n").isNull().alias("allowed"))


def eligibility(snapshots: DataFrame) -> DataFrame:
    """name, qualifications and blocked purposes (arrays, null for none) -> the purposes a table may serve, and why not quotes.

    One row that could not be judged (DEGRADED, UNAVAILABLE) takes the quotes away; a QUARANTINED one doesn't, for there the
    screen worked. No qualification at all is no data. The day's end depends on the blocks alone. Training and intraday use are
    never given by one run.
    """
    none = F.array().cast("array<string>")
    held = F.coalesce(F.col("qualifications"), none)
    blocked = F.coalesce(F.col("blocks"), none)
    unjudged = F.array_sort(F.array_intersect(held, F.array(F.lit("DEGRADED"), F.lit("UNAVAILABLE"))))
    reason = (
        F.when(F.array_contains(blocked, "quotes"), "quarantined by a field-level check")
        .when(F.size(unjudged) > 0, F.concat(F.lit("rows that could not be judged: "), F.array_join(unjudged, ", ")))
        .when(F.size(held) == 0, "no data")
    )
    return snapshots.select("name", reason.isNull().alias("quotes"), (~F.array_contains(blocked, "day_end")).alias("day_end"), F.lit(False).alias("intraday"), F.lit(False).alias("training"), reason.alias("reason"))


def actions_rejected(actions: DataFrame) -> DataFrame:
    """Corporate actions that can't be used, each with the first reason: kind, a split's ratio, or known over a year early."""
    kind = F.col("kind")
    why = (
        F.when(~F.coalesce(kind.isin("split", "dividend"), F.lit(False)), "unknown kind")
        .when((kind == "split") & ~(ts.finite(F.col("ratio")) & (F.col("ratio") > 0)), "split without a ratio")
        .when(F.col("effective_at").isNull() | F.col("known_at").isNull(), "no date")
        .when(F.col("known_at") < F.date_sub("effective_at", 365), "known more than a year early")
    )
    return actions.withColumn("reason", why).where("reason is not null")


def expected_ratio(kind: Column, ratio: Column) -> Column:
    """The close's ratio that a split explains; a dividend expects none."""
    return F.when(kind == "split", F.try_divide(F.lit(1.0), ratio))


def reported_move(detail: Column) -> Column:
    """The first signed per cent of a finding's text as a share; null where there is none."""
    return F.regexp_extract(detail, r"([+-]\d+(?:\.\d+)?)%", 1).try_cast("double") / 100


# Source health


def weekdays_between(first: Column, last: Column) -> Column:
    """Monday-to-Friday days from first to last, both included, in closed form."""

    def until(d: Column) -> Column:  # days since Monday 1970-01-05, exclusive
        n = F.datediff(d, F.lit("1970-01-05").cast("date")) + 1
        week = F.floor(n / 7)
        return week * 5 + F.least(n - week * 7, F.lit(5))

    return until(last) - until(F.date_sub(first, 1))


def manifest_health(manifest: DataFrame, rules: DataFrame, as_of: str) -> DataFrame:
    """dataset, provider, status, rows, earliest, latest with rules -> age, history, density and a verdict.

    The ladder is failed, stale, truncated, ok. A null age fails; null history or density passes; fixtures are exempt from
    depth and density. Rules are one row per dataset.
    """
    day = F.lit(as_of).cast("date")
    m = manifest.join(rules, "dataset", "left")
    age = weekdays_between(F.col("latest"), day) - 1
    history = F.datediff(day, F.col("earliest")) / 365.25
    density = F.least(F.lit(1.0), F.try_divide(F.col("rows"), weekdays_between(F.col("earliest"), F.col("latest"))))
    exempt = F.col("status") == "fixture"
    fetched = F.col("status").isin("ok", "fixture")
    fresh = F.coalesce(F.col("age") <= F.coalesce("max_age", F.lit(5)), F.lit(False))
    deep = exempt | (F.coalesce(F.col("history") >= F.coalesce("min_history", F.lit(0.0)), F.lit(True)) & (F.coalesce("rows", F.lit(0)) >= F.coalesce("min_rows", F.lit(1))) & F.coalesce(F.col("density") >= F.coalesce("min_density", F.lit(0.0)), F.lit(True)))
    verdict = F.when(~fetched, "failed").when(~fresh, "stale").when(~deep, "truncated").otherwise("ok")
    m = m.withColumns({"age": age, "history": history, "density": density})
    return m.select("dataset", "provider", F.coalesce("required", F.lit(False)).alias("required"), F.col("age").cast("long").alias("age"), F.round("history", 6).alias("history"), F.round("density", 6).alias("density"), verdict.alias("health"), (verdict == "ok").alias("eligible"))


def required_failures(health: DataFrame) -> DataFrame:
    """Required datasets without any eligible provider: a healthy fallback satisfies its dataset."""
    return health.where("required").groupBy("dataset").agg(F.bool_or("eligible").alias("any_eligible")).where("not any_eligible").select("dataset")


# Two sources


def measured_tolerance(joined: DataFrame, window: int = TOLERANCE_WINDOW, multiple: float = TOLERANCE_MULTIPLE, floor: float = TOLERANCE_FLOOR) -> DataFrame:
    """symbol, session, a, b -> median + multiple * MAD of relative differences over the last common sessions, at least floor."""
    w = W.partitionBy("symbol").orderBy(F.col("session").desc())
    d = joined.where("a is not null and b is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= window).select("symbol", F.abs(F.try_divide(F.col("a"), F.col("b")) - 1).alias("x"))
    mid = d.groupBy("symbol").agg(F.expr("percentile(x, 0.5)").alias("med"), F.count("x").alias("points"))
    mad = d.join(mid, "symbol").groupBy("symbol").agg(F.first("med").alias("med"), F.first("points").alias("points"), F.expr("percentile(abs(x - med), 0.5)").alias("mad"))
    return mad.select("symbol", "points", F.when(F.col("points") < 2, F.lit(floor)).otherwise(F.greatest(F.col("med") + multiple * F.col("mad"), F.lit(floor))).alias("tolerance"))


def aligned(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    a = primary.select("symbol", "session", F.col("p").alias("a"))
    return a.join(secondary.select("symbol", "session", F.col("p").alias("b")), ["symbol", "session"], "full_outer")


def comparable(conventions: DataFrame) -> DataFrame:
    """symbol, source, price, session_kind, currency, volume_unit -> symbol, comparable: price, session and currency agree; units of volume don't matter."""
    c = F.struct("price", "session_kind", "currency")
    return conventions.groupBy("symbol").agg((F.count_distinct(c) == 1).alias("comparable"))


def reconcile(primary: DataFrame, secondary: DataFrame, conventions: DataFrame | None = None) -> DataFrame:
    """Every session of either source with its class: agree, disagree, or in one source only.

    With `conventions` (see `comparable`): symbols whose sources follow different conventions aren't compared, they get one
    quarantine instead. Symbols of both sources without a common session get a row that says so.
    """
    both = aligned(primary.where("p is not null"), secondary.where("p is not null"))
    rows = both.join(measured_tolerance(both), "symbol", "left")
    diff = F.abs(F.try_divide(F.col("a"), F.col("b")) - 1)
    code = F.when(F.col("b").isNull(), "date_only_in_primary").when(F.col("a").isNull(), "date_only_in_secondary").when(diff > F.col("tolerance"), "sources_disagree").otherwise("agrees")
    severity = F.when(code == "sources_disagree", "review").when(code == "agrees", F.lit(None)).otherwise("note")
    out = rows.select("symbol", "session", F.round(diff, 6).alias("difference"), code.alias("code"), severity.alias("severity"))
    apart = both.groupBy("symbol").agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("common"))
    no_overlap = apart.where("common = 0 and na > 0 and nb > 0").select("symbol", *_whole_symbol("no_overlap", "review"))
    out = out.unionByName(no_overlap)
    if conventions is None:
        return out
    mismatch = comparable(conventions).where("not comparable").select("symbol", *_whole_symbol("convention_mismatch", "quarantine"))
    return out.join(mismatch.select("symbol"), "symbol", "left_anti").unionByName(mismatch)


def _whole_symbol(code: str, severity: str) -> list[Column]:
    return [F.lit(None).cast("date").alias("session"), F.lit(None).cast("double").alias("difference"), F.lit(code).alias("code"), F.lit(severity).alias("severity")]


def _middle(x: Column) -> Column:
    """The median of a sorted array."""
    n = F.size(x)
    return (F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) / 2


def tolerance_before(common: DataFrame, window: int = TOLERANCE_WINDOW) -> DataFrame:
    """symbol, session, a, b -> also `band`: the tolerance measured on the `window` common sessions strictly before each one."""
    w = ts.series("symbol").rowsBetween(-window, -1)
    x = F.abs(F.try_divide(F.col("a"), F.col("b")) - 1)

    def band(before: Column) -> Column:
        # An array of one binds the sorted values and their median, so that neither is worked out anew for each value.
        of = lambda v, m: F.greatest(m + TOLERANCE_MULTIPLE * _middle(F.array_sort(F.transform(v, lambda y: F.abs(y - m)))), F.lit(TOLERANCE_FLOOR))
        bound = F.transform(F.array(F.array_sort(before)), lambda v: F.transform(F.array(_middle(v)), lambda m: of(v, m)))
        return F.when(F.size(before) < 2, F.lit(TOLERANCE_FLOOR)).otherwise(bound[0][0])

    rows = common.withColumn("before", F.collect_list(x).over(w))
    return rows.withColumn("band", band(F.col("before"))).drop("before")


def confirm_moves(primary: DataFrame, secondary: DataFrame, jump: float = 0.02, window: int = TOLERANCE_WINDOW) -> DataFrame:
    """Large moves of the first source: confirmed if the second moved alike within a band measured strictly before.

    Each source's move is that over its own last value, so a gap of one doesn't make the other's move incomparable. One
    window per source and one over the common sessions; no move meets the sessions before it as rows.
    """
    w = ts.series("symbol")
    moved = lambda s: s.where("p is not null").withColumn("r", ts.pct_change(F.col("p"), w))
    a = moved(primary).select("symbol", "session", F.col("p").alias("a"), F.col("r").alias("ra"))
    b = moved(secondary).select("symbol", "session", F.col("p").alias("b"), F.col("r").alias("rb"))
    bands = tolerance_before(a.join(b, ["symbol", "session"]), window)
    moves = a.where(F.abs("ra") > jump).select("symbol", "session", "ra")
    out = moves.join(bands.select("symbol", "session", "rb", "band"), ["symbol", "session"], "left")
    alike = F.abs(F.col("ra") - F.col("rb")) <= F.greatest(2 * F.col("band"), F.lit(0.005))
    code = F.when(F.col("rb").isNull(), "move_unconfirmable").when(alike, "move_confirmed").otherwise("move_unconfirmed")
    return out.select("symbol", "session", F.round("ra", 6).alias("move"), code.alias("code"), F.when(code == "move_confirmed", "note").otherwise("review").alias("severity"))


def agreement_cannot_clear(issues: DataFrame) -> DataFrame:
    """The findings of one source unchanged, and for each symbol with a quarantine a note that agreement doesn't lift it."""
    columns = [c for c in issues.columns if c not in ("symbol", "code", "severity")]
    note = issues.where("severity = 'quarantine'").select("symbol").distinct()
    note = note.select("symbol", F.lit("agreement_does_not_clear_quarantine").alias("code"), F.lit("note").alias("severity"), *(F.lit(None).cast(issues.schema[c].dataType).alias(c) for c in columns))
    return issues.unionByName(note)


def unverifiable(subjects: DataFrame, reason: str) -> DataFrame:
    """A note for each symbol that no second source confirms."""
    return subjects.select("symbol", F.lit("no_independent_source").alias("code"), F.lit("note").alias("severity"), F.lit(reason).alias("detail"))


def stability_only(reads: DataFrame) -> DataFrame:
    """symbol, value of repeated reads of one feed -> how many and how far apart; that is steadiness, not confirmation."""
    g = reads.groupBy("symbol").agg(F.count("value").alias("reads"), (F.try_divide(F.max("value"), F.min("value")) - 1).alias("spread"))
    return g.select("symbol", "reads", "spread", F.lit("same_source_stability").alias("code"), F.lit("note").alias("severity"))


def substitutions(requests: DataFrame) -> DataFrame:
    """symbol, replaced, replacement, reason of swaps; a swap without a reason raises, for none is made silently."""
    given = F.length(F.trim(F.coalesce(F.col("reason"), F.lit("")))) > 0
    checked = F.when(given, F.col("reason")).otherwise(F.raise_error(F.concat(F.coalesce(F.col("symbol"), F.lit("?")), F.lit(": a substitution needs a reason"))))
    return requests.select("symbol", F.col("replaced").alias("replaced_source"), F.col("replacement").alias("replacement_source"), checked.alias("substitution_reason"), F.lit(True).alias("must_pass_same_gates"))


def cross_source(primary: DataFrame, secondary: DataFrame | None, conventions: DataFrame | None = None, jump: float = 0.02) -> DataFrame:
    """symbol, verdict, disagreements, confirmed, unconfirmed. Without a second source a symbol is unverified, never in disagreement."""
    symbols = primary.select("symbol").distinct()
    if secondary is None:
        return symbols.select("symbol", F.lit("unverified").alias("verdict"), *(F.lit(0).cast("long").alias(c) for c in ("disagreements", "confirmed", "unconfirmed")))
    seen = reconcile(primary, secondary, conventions).groupBy("symbol").agg(
        F.count(F.when(F.col("code") == "sources_disagree", 1)).alias("disagreements"),
        F.count(F.when(F.col("code").isin("agrees", "sources_disagree"), 1)).alias("common"),
        F.bool_or(F.col("code") == "convention_mismatch").alias("mismatch"),
    )
    moves = confirm_moves(primary, secondary, jump).groupBy("symbol").agg(F.count(F.when(F.col("code") == "move_confirmed", 1)).alias("confirmed"), F.count(F.when(F.col("code") != "move_confirmed", 1)).alias("unconfirmed"))
    out = symbols.join(seen, "symbol", "left").join(moves, "symbol", "left").na.fill(0, ["disagreements", "common", "confirmed", "unconfirmed"])
    verdict = F.when(F.coalesce("mismatch", F.lit(False)), "convention_mismatch").when(F.col("common") == 0, "unverified").when(F.col("disagreements") > 0, "disagreed").otherwise("agreed")
    return out.select("symbol", verdict.alias("verdict"), "disagreements", "confirmed", "unconfirmed")


def reconciliation_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(
        F.count(F.when(F.col("code").isin("agrees", "sources_disagree"), 1)).alias("common"),
        F.count(F.when(F.col("code") == "sources_disagree", 1)).alias("disagreements"),
        F.max("difference").alias("worst"),
        F.max_by("session", F.struct(F.coalesce("difference", F.lit(-1.0)), F.negative(F.unix_date("session")))).alias("worst_session"),
        (F.count(F.when(F.col("code") == "agrees", 1)) > 0).alias("overlap"),
        F.coalesce(F.bool_and(F.when(F.col("code").isin("agrees", "sources_disagree"), F.col("code") == "agrees")), F.lit(False)).alias("agreed"),
    )
