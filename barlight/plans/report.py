"""Data sets of a factor's report, and a page that shows them."""

from __future__ import annotations

from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate


def report_data(panel: DataFrame, step: str, n_groups: int = 5, bins: int = 20, max_lag: int = 10) -> dict[str, DataFrame]:
    """Four small tables from a panel with symbol, open_time, close, value and fwd_ret: IC by time, groups, histogram, IC decay."""
    low, high = panel.agg(F.min("value"), F.max("value")).first()
    spread = (low, high) if low is not None and low < high else (-1.0, 1.0)
    return {
        "ic_series": evaluate.ic_series(panel).orderBy("open_time"),
        "groups": evaluate.grouping_backtest(panel, n_groups).orderBy("bucket"),
        "histogram": evaluate.histogram(panel, *map(float, spread), bins).orderBy("bin"),
        "ic_decay": evaluate.ic_decay(panel, step, max_lag).orderBy("lag"),
    }


def bars_svg(values: list[float | None], width: int = 640, height: int = 160) -> str:
    """Bars around a zero line."""
    given = [v for v in values if v is not None]
    top = max((abs(v) for v in given), default=0.0) or 1.0
    step = width / max(1, len(values))
    rects = "".join(f'<rect x="{i * step:.1f}" y="{height / 2 - max(v, 0) / top * height / 2:.1f}" width="{max(step - 1, 1):.1f}" height="{abs(v) / top * height / 2:.1f}"/>' for i, v in enumerate(values) if v is not None)
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}" fill="#446">{rects}<line x1="0" x2="{width}" y1="{height / 2}" y2="{height / 2}" stroke="#999"/></svg>'


def write_report(name: str, data: dict[str, DataFrame], path: str | Path) -> Path:
    """An HTML page of the data sets; they have a row for each time, group, bin or lag."""
    parts, shown = [], {"ic_series": "ic", "groups": "mean_ret", "histogram": "n", "ic_decay": "ic_mean"}
    for key, df in data.items():
        rows = df.collect()
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{escape(key)}</h2>{bars_svg([r[shown[key]] for r in rows])}<details><summary>table</summary><table><tr>{head}</tr>{body}</table></details>")
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f'<!DOCTYPE html><html lang="en"><meta charset="utf-8"><title>{escape(name)}</title><h1>{escape(name)}</h1>{"".join(parts)}</html>', encoding="utf-8")
    return path
