"""Squarified treemap: rectangles of given areas, laid out greedily so that none is needlessly thin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def treemap(rows: DataFrame, width: float = 100.0, height: float = 100.0) -> DataFrame:
    """(session, category, tokens) -> with x, y, w, h; a session has one row per category, a bounded number."""

    def place(values: list[float], width: float, height: float) -> list[tuple[float, float, float, float]]:
        """(x, y, w, h) for each of the values, given in falling order; their areas share width x height."""
        scale = width * height / sum(values) if sum(values) else 0
        areas, out, x, y, w, h, i = [v * scale for v in values], [], 0.0, 0.0, width, height, 0
        while i < len(areas):
            side, n, best = min(w, h), 0, float("inf")
            while i + n < len(areas):
                row = areas[i : i + n + 1]
                total = sum(row)
                worst = max((side * side * max(row) / (total * total), total * total / (side * side * min(row)))) if total and min(row) else float("inf")
                if n and worst > best:
                    break
                best, n = worst, n + 1
            row = areas[i : i + n]
            thick, along = (sum(row) / side if side else 0), 0.0
            for a in row:
                long = a / thick if thick else 0
                out.append((x + along, y, long, thick) if w < h else (x, y + along, thick, long))
                along += long
            x, y, w, h = (x, y + thick, w, h - thick) if w < h else (x + thick, y, w - thick, h)
            i += n
        return out

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for session, parts in zip(batch["session"], batch["parts"], strict=True):
                ordered = sorted(((p["tokens"], p["category"]) for p in parts), key=lambda p: (-p[0], p[1]))
                out += [(session, c, t, *r) for (t, c), r in zip(ordered, place([float(t) for t, _ in ordered], width, height), strict=True)]
            yield pd.DataFrame(out, columns=["session", "category", "tokens", "x", "y", "w", "h"])

    each = rows.where("tokens > 0").groupBy("session").agg(F.collect_list(F.struct("category", "tokens")).alias("parts"))
    return each.mapInPandas(lay, "session long, category string, tokens long, x double, y double, w double, h double")
