"""The event machine: confirmed slowly, released more slowly, notified once.

One step function serves the batch fold and the streaming operator, whose state survives restarts in its checkpoint. A
label's `seen` is cumulative: short absences don't reset it. A release of an event that was never confirmed is silent.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from causeway.settings import EventRules

NOTES = "label string, session date, kind string, first_seen date, seen int"
STATE = "first_seen date, seen int, absent int, confirmed date, noted date, last date"


@dataclass
class Machine:
    """`first_seen` is null while no event is active; `last` is the latest session observed."""

    first_seen: dt.date | None = None
    seen: int = 0
    absent: int = 0
    confirmed: dt.date | None = None
    noted: dt.date | None = None
    last: dt.date | None = None

    def observe(self, present: bool, session: dt.date, rules: EventRules) -> tuple[str, dt.date, int] | None:
        """Advance by one session. A session that isn't later than the last one has been counted and changes nothing."""
        if self.last is not None and session <= self.last:
            return None
        self.last = session
        if present:
            if self.first_seen is None:
                self.first_seen, self.seen, self.confirmed, self.noted = session, 0, None, None
            self.seen, self.absent = self.seen + 1, 0
            if self.confirmed is None and self.seen >= rules.confirm:
                self.confirmed = session
                return self._note("opened", session, rules)
            return None
        if self.first_seen is None:
            return None
        self.absent += 1
        if self.absent < rules.release:
            return None
        note = self._note("released", session, rules) if self.confirmed is not None else None
        self.first_seen, self.seen, self.absent, self.confirmed, self.noted = None, 0, 0, None, None
        return note

    def _note(self, kind: str, session: dt.date, rules: EventRules):
        if self.noted is not None and (session - self.noted).days < rules.cooldown_days:
            return None
        self.noted = session
        return kind, self.first_seen, self.seen


def _run(machine: Machine, label: str, rows: pd.DataFrame, rules: EventRules) -> pd.DataFrame:
    out = []
    for session, present in zip(rows["session"], rows["present"], strict=True):
        if note := machine.observe(bool(present), session, rules):
            out.append((label, session, *note))
    return pd.DataFrame(out, columns=["label", "session", "kind", "first_seen", "seen"])


def notifications(labels: DataFrame, rules: EventRules = EventRules()) -> DataFrame:
    """Batch fold of (label, session, present); of repeated sessions, present wins. A group is one label's calendar."""
    once = labels.groupBy("label", "session").agg(F.bool_or("present").alias("present"))

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _run(Machine(), key[0], pdf.sort_values("session"), rules)

    return once.groupBy("label").applyInPandas(fold, NOTES)


def standing(labels: DataFrame, rules: EventRules = EventRules()) -> DataFrame:
    """(label, session, open): whether a confirmed event stands after each session, which is what a reader is told."""
    once = labels.groupBy("label", "session").agg(F.bool_or("present").alias("present"))

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        machine, stands = Machine(), []
        pdf = pdf.sort_values("session")
        for session, present in zip(pdf["session"], pdf["present"], strict=True):
            machine.observe(bool(present), session, rules)
            stands.append(machine.confirmed is not None)
        return pd.DataFrame({"label": key[0], "session": pdf["session"], "open": stands})

    return once.groupBy("label").applyInPandas(fold, "label string, session date, open boolean")


def active(labels: DataFrame, rules: EventRules = EventRules()) -> DataFrame:
    """Events still running after the last session, one per label at most: when first and last seen, how often, and whether confirmed."""
    once = labels.groupBy("label", "session").agg(F.bool_or("present").alias("present"))

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        machine, last = Machine(), None
        pdf = pdf.sort_values("session")
        for session, present in zip(pdf["session"], pdf["present"], strict=True):
            machine.observe(bool(present), session, rules)
            last = session if present else last
        rows = [] if machine.first_seen is None else [(key[0], machine.first_seen, last, machine.seen, machine.absent, machine.confirmed)]
        return pd.DataFrame(rows, columns=["label", "first_seen", "last_seen", "seen", "absent", "confirmed_on"])

    return once.groupBy("label").applyInPandas(fold, "label string, first_seen date, last_seen date, seen int, absent int, confirmed_on date")


def open_events(labels: DataFrame, rules: EventRules = EventRules()) -> DataFrame:
    """The confirmed ones of `active`."""
    return active(labels, rules).where("confirmed_on is not null")


def stream_notifications(labels: DataFrame, rules: EventRules = EventRules()) -> DataFrame:
    """The same over a stream: sessions must reach the operator in order, later ones in later batches."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Machine(*state.get) if state.exists else Machine()
        rows = pd.concat(list(frames)).groupby("session", as_index=False)["present"].max().sort_values("session")
        out = _run(machine, key[0], rows, rules)
        state.update(astuple(machine))
        yield out

    return labels.groupBy("label").applyInPandasWithState(step, NOTES, STATE, "append", GroupStateTimeout.NoTimeout)


def exceptional_review(moves: DataFrame) -> DataFrame:
    """Verified moves that aren't single prints skip the wait."""
    return moves.where(F.col("verified") & ~F.col("single_print"))


def confirmation_cost(labels: DataFrame, rules: EventRules = EventRules()) -> DataFrame:
    """What waiting bought and cost: flickers kept quiet, events opened, and their delay in sessions."""
    quick = EventRules(rules.confirm, rules.release, 0)

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        machine, delays, runs, run, first = Machine(), [], [], 0, None
        for i, (session, present) in enumerate(zip(*(pdf.sort_values("session")[c] for c in ("session", "present")), strict=True)):
            if present and first is None:
                first = i
            run = run + 1 if present else runs.append(run) or 0 if run else 0
            note = machine.observe(bool(present), session, quick)
            if note and note[0] == "opened":
                delays.append(i - (first if first is not None else i))
                first = None
        runs += [run] if run else []
        d = pd.Series(delays, dtype=float)
        return pd.DataFrame({"label": [key[0]], "flickers": [sum(r < rules.confirm for r in runs)], "opened": [len(delays)], "median_delay": [d.median() if delays else None], "worst_delay": [d.max() if delays else None]})

    return labels.groupBy("label").applyInPandas(fold, "label string, flickers long, opened long, median_delay double, worst_delay double")
