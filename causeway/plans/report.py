"""The report: seven sections in a fixed order from small collected frames, as a dictionary, markdown and HTML."""

from __future__ import annotations

import html
from typing import Any

SECTIONS = ("data_status", "judgment", "changes", "dimensions", "scenarios", "instruments", "method")
MOST_ITEMS = 3
FORBIDDEN = frozenset({"account", "account_id", "position", "positions", "portfolio", "net_liquidation", "buying_power", "avg_cost"})
TITLES = {
    "en": dict(zip(SECTIONS, ("Data status", "Judgment", "Changes", "Dimensions", "Scenarios", "Instruments", "Method"), strict=True)),
    "zh": dict(zip(SECTIONS, ("数据状态", "判断", "变化", "维度", "情景", "工具", "方法"), strict=True)),
}


def forbidden_fields(value: Any, path: str = "") -> list[str]:
    """Paths of account-like names at any depth."""
    if isinstance(value, dict):
        own = [f"{path}.{k}".lstrip(".") for k in value if str(k).lower() in FORBIDDEN]
        return own + [p for k, v in value.items() for p in forbidden_fields(v, f"{path}.{k}")]
    if isinstance(value, (list, tuple)):
        return [p for i, v in enumerate(value) for p in forbidden_fields(v, f"{path}[{i}]")]
    return []


def capped(items: list[Any]) -> dict[str, Any]:
    return {"shown": items[:MOST_ITEMS], "withheld": max(0, len(items) - MOST_ITEMS)}


def label_changes(now: list[str], before: list[str]) -> dict[str, list[str]]:
    return {"added": sorted({*now} - {*before}), "dropped": sorted({*before} - {*now})}


def build(**sections: Any) -> dict[str, Any]:
    """Every section, in order; a missing one is there and empty. Account-like fields are refused."""
    if unknown := sections.keys() - set(SECTIONS):
        raise ValueError(f"no such section: {sorted(unknown)}")
    report = {name: sections.get(name) or {} for name in SECTIONS}
    if found := forbidden_fields(report):
        raise ValueError(f"account fields don't belong in a report: {found}")
    return report


def shown(value: Any) -> str:
    """Missing is a dash, never zero."""
    if value is None or value != value:
        return "—"
    return f"{value:,.4g}" if isinstance(value, float) else str(value)


def _lines(value: Any) -> list[str]:
    if isinstance(value, dict):
        return [f"- {k}: {shown(v) if not isinstance(v, (dict, list)) else ''}".rstrip() for k, v in value.items() if not isinstance(v, (dict, list))] + [x for k, v in value.items() if isinstance(v, (dict, list)) for x in [f"### {k}", *_lines(v)]]
    if value and all(isinstance(v, dict) for v in value):
        head = list(value[0])
        return ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(shown(v.get(h)) for h in head) + " |" for v in value)]
    return [f"- {shown(v)}" for v in value] or ["—"]


def percent(value: Any, digits: int = 1) -> str:
    return "—" if value is None or value != value else f"{value * 100:.{digits}f} %"


def money(value: Any) -> str:
    return "—" if value is None or value != value else f"{value:,.2f}"


def indicator_table(rows: list[dict[str, Any]]) -> list[dict[str, str]]:
    """Indicators by falling risk; those without a rank come last."""
    ranked = sorted(rows, key=lambda r: (r.get("risk_rank") is None, -(r.get("risk_rank") or 0), r["name"]))
    return [{"indicator": r["name"], "value": shown(r.get("value")), "change over 20": shown(r.get("change_20")), "rank": percent(r.get("risk_rank"), 0), "direction": r.get("direction") or "—"} for r in ranked]


def scenario_table(rows: list[dict[str, Any]]) -> list[dict[str, str]]:
    """Candidates and controls beside each other, first of equal (symbol, label) rows."""
    seen: dict[tuple[Any, Any], dict[str, Any]] = {}
    for r in rows:
        seen.setdefault((r.get("symbol"), r.get("label")), r)
    return [{"choice": str(r.get("label") or "—"), "cost": money(r.get("cost")), "share": percent(r.get("cost_share"), 2), "worst": money(r.get("worst")), "flat": money(r.get("flat")), "best": money(r.get("best"))} for r in seen.values()]


def condition_lines(triggers: list[dict[str, Any]]) -> list[str]:
    """What would change the reading: ranks at which an indicator is looked at again."""
    return [f"{t['name']}: above {percent(t['above'], 0)} or below {percent(t['below'], 0)}" for t in triggers if t.get("above") is not None and t.get("below") is not None]


def method_lines(rules: dict[str, Any], grade: str) -> list[str]:
    return [f"{k}: {shown(v)}" for k, v in rules.items()] + [f"grade of the rules: {grade}"]


def registry_lines(summary: list[dict[str, Any]]) -> list[str]:
    """Each capability with its experiments and what may influence a recommendation, which is nothing until something passed on new data."""
    return [f"{r['capability']}: {r['experiments']} experiments; may influence: {r['may_influence'] or 'none'}" for r in summary]


def headline(judgment: dict[str, Any]) -> str:
    withheld = judgment.get("leaning") in (None, "DATA_INSUFFICIENT")
    return "No leaning: the rules are untested or the data doesn't suffice." if withheld else f"Leaning: {judgment['leaning']}"


def bar_rows(rows: list[dict[str, Any]], value: str, width: int = 20) -> list[str]:
    """A bar for each row that has a number; a missing one is left out, never drawn as zero."""
    kept = sorted((r for r in rows if r.get(value) is not None), key=lambda r: -r[value])
    return [f"{r['name']} {'#' * round(max(0.0, min(1.0, r[value])) * width)} {percent(r[value], 0)}" for r in kept]


def markdown(report: dict[str, Any], language: str = "en") -> str:
    return "\n".join(x for name in SECTIONS for x in [f"## {TITLES[language][name]}", *_lines(report[name]), ""])


def page(report: dict[str, Any], title: str, language: str = "en") -> str:
    body: list[str] = []
    table = False
    for line in markdown(report, language).split("\n"):
        row = line.startswith("|")
        if row and not table:
            body.append("<table>")
        if table and not row:
            body.append("</table>")
        table = row
        text = html.escape(line.replace("**", "").replace("`", ""))
        if row:
            if set(line) - set("|- "):
                body.append("<tr>" + "".join(f"<td>{c.strip()}</td>" for c in text.strip("|").split("|")) + "</tr>")
        elif line.startswith("## "):
            body.append(f"<h2>{text[3:]}</h2>")
        elif line.startswith("### "):
            body.append(f"<h3>{text[4:]}</h3>")
        elif line:
            body.append(f"<p>{text.removeprefix('- ')}</p>")
    return f'<!doctype html><html lang="{language}"><meta charset="utf-8"><title>{html.escape(title)}</title><body>{"".join(body)}{"</table>" if table else ""}</body></html>'
