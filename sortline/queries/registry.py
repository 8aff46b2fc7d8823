"""Where queries register themselves with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from ..sources import fixtures as X

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: The range of most queries; its ends don't fall on whole minutes.
START, END = "1997-01-01 00:00:30", "1998-01-01 12:30:15"
SCAN_START, SCAN_END = "2024-01-05 06:30:20", "2024-01-20 18:45:40"
NOW = "2024-02-01 00:00:00"

IN_RANGE = f"created_time >= TIMESTAMP '{START}' AND created_time < TIMESTAMP '{END}'"
IN_SCANS = f"scan_time >= TIMESTAMP '{SCAN_START}' AND scan_time < TIMESTAMP '{SCAN_END}'"

NUMBER = "TRY_CAST(trim({}) AS INTEGER)"
SORTED = "status IN (3, 4)"
EXCEPTIONAL = "(is_exception OR status = 5)"
RECIRCULATED = "coalesce(TRY_CAST(resolved_dock_code AS INTEGER) > 7, false)"
WAVE = "coalesce(normalized_wave_code, '未分波次')"
CHUTE = "coalesce(actual_chute_code, target_chute_code, resolved_dock_code)"


def percent(n: str, d: str) -> str:
    return f"CAST(CASE WHEN ({d}) > 0 THEN CAST((({n}) * 200000 + ({d})) // (2 * ({d})) AS DOUBLE) / 1000 ELSE 0 END AS DECIMAL(18,3))"


def query(sql: str | None = None, views: tuple[str, ...] = (X.TASKS,)):
    """Register a function (spark, sf_dir) under its name, with SQL that may use the views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {','.join(views)}\n{sql}" if views else sql
        return f

    return add
