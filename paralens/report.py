"""A static page of results: no script, no timestamp, the same bytes from the same documents."""

from __future__ import annotations

from html import escape
from typing import Any

WIDTH, HEIGHT, PAD = 640, 200, 30


def percent(x: float | None, places: int = 1) -> str:
    return "n/a" if x is None else f"{100 * x:.{places}f}%"


def number(x: float | None, form: str = ".3f") -> str:
    return "n/a" if x is None else format(x, form)


def _table(head: list[str], rows: list[list[str]]) -> str:
    cells = lambda row, tag: "".join(f"<{tag}>{escape(str(c))}</{tag}>" for c in row)
    return f"<table><tr>{cells(head, 'th')}</tr>" + "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows) + "</table>"


def _x(value: float) -> float:
    return round(PAD + min(max(value, 0.0), 1.0) * (WIDTH - 2 * PAD), 2)


def histogram_svg(runs: list[dict[str, Any]]) -> str:
    """One line a run, each scaled to its own peak, and the canonical wording's score as a tick."""
    shapes = []
    for k, run in enumerate(runs):
        bins = run["histogram"]
        peak = max([1, *(b["n"] for b in bins)])
        points = " ".join(f"{_x((b['low'] + b['high']) / 2)},{round(HEIGHT - PAD - b['n'] / peak * (HEIGHT - 2 * PAD), 2)}" for b in bins)
        shapes.append(f'<polyline class="run{k}" fill="none" stroke="currentColor" points="{points}"><title>{escape(run["model"])}</title></polyline>')
        if (own := run["canonical"].get("canonical_accuracy")) is not None:
            shapes.append(f'<line class="canonical" stroke="currentColor" x1="{_x(own)}" x2="{_x(own)}" y1="{HEIGHT - PAD}" y2="{HEIGHT - PAD + 8}"/>')
    return f'<svg viewBox="0 0 {WIDTH} {HEIGHT}" role="img" aria-label="scores">{"".join(shapes)}</svg>'


def strip_svg(runs: list[dict[str, Any]]) -> str:
    """Range, quartiles, median and canonical score of each run."""
    shapes = []
    for k, run in enumerate(runs):
        d, y = run["strict"], PAD + 24 * k
        if not d.get("n"):
            continue
        shapes.append(f'<line stroke="currentColor" x1="{_x(d["min"])}" x2="{_x(d["max"])}" y1="{y}" y2="{y}"/>')
        shapes.append(f'<rect fill="none" stroke="currentColor" x="{_x(d["p25"])}" width="{round(_x(d["p75"]) - _x(d["p25"]), 2)}" y="{y - 7}" height="14"/>')
        shapes.append(f'<line stroke="currentColor" x1="{_x(d["median"])}" x2="{_x(d["median"])}" y1="{y - 7}" y2="{y + 7}"/>')
        if (own := run["canonical"].get("canonical_accuracy")) is not None:
            shapes.append(f'<circle cx="{_x(own)}" cy="{y}" r="3"><title>canonical</title></circle>')
    return f'<svg viewBox="0 0 {WIDTH} {2 * PAD + 24 * len(runs)}" role="img" aria-label="ranges">{"".join(shapes)}</svg>'


def summary_table(runs: list[dict[str, Any]]) -> str:
    head = ["task", "model", "wordings", "mean", "sd", "p05 to p95", "min to max", "Q", "p", "null sd", "Spearman-Brown"]
    rows = []
    for r in runs:
        d, s = r["strict"], r["spread_test"]
        rows.append([
            r["task"], r["model"], d["n"], percent(d["mean"]), percent(d["sd"]), f"{percent(d['p05'])} to {percent(d['p95'])}", f"{percent(d['min'])} to {percent(d['max'])}",
            number(s["cochran_q"], ".1f"), number(s["q_p_value"]), percent(s["null_sd_mean"]), number(r["reliability"]["spearman_brown"], ".2f"),
        ])
    return _table(head, rows)


def accounting_table(runs: list[dict[str, Any]]) -> str:
    rows = [[r["task"], r["model"], *(r["accounting"][k] for k in ("correct", "wrong", "unparseable", "error")), percent(r["strict"]["mean"]), percent(r["parsed_only"]["mean"])] for r in runs]
    return _table(["task", "model", "correct", "wrong", "unparseable", "failed", "strict mean", "parsed mean over wordings"], rows)


def feature_table(run: dict[str, Any]) -> str:
    """Strongest correlations first; a star marks what holds after correction."""
    ordered = sorted(run["features"], key=lambda f: -abs(f["rho"] or 0))
    star = lambda p: "*" if p is not None and p < 0.05 else ""
    return _table(["feature", "rho", "p", "p (Holm)", "share"], [[f["name"] + star(f["p_holm"]), number(f["rho"]), number(f["p"]), number(f["p_holm"]), percent(f["share_with_feature"])] for f in ordered])


def lead(runs: list[dict[str, Any]]) -> dict[str, Any]:
    """The run of the widest spread; of equals the first."""
    return max(runs, key=lambda r: r["strict"]["sd"] or 0.0)


def page(runs: list[dict[str, Any]], title: str = "How much the wording matters") -> str:
    """The report over documents of analyses with task and model."""
    runs = sorted(runs, key=lambda r: (r["task"], r["model"]))
    parts = [f"<h1>{escape(title)}</h1>"]
    if runs:
        top = lead(runs)
        parts += [
            f"<p>Widest spread: {escape(top['task'])} on {escape(top['model'])}, standard deviation {percent(top['strict']['sd'])}.</p>", histogram_svg(runs),
            "<p>One bin for each score that the items allow.</p>", strip_svg(runs), summary_table(runs), accounting_table(runs),
            *(f"<h2>{escape(r['task'])}, {escape(r['model'])}</h2>{feature_table(r)}" for r in runs),
        ]
    return "<!doctype html><html lang=\"en\"><meta charset=\"utf-8\"><title>" + escape(title) + "</title><body>" + "\n".join(parts) + "</body></html>\n"
