"""Test tables of a script against stored snapshots of their rows."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame

from .engine import Engine


def rendered(df: DataFrame) -> list[dict]:
    """Rows as JSON values; those of an unordered table in the order of their text."""
    return [json.loads(x) for x in df.toJSON().collect()]


def run_tests(engine: Engine, folder: str, limit: int = 1000) -> dict[str, str]:
    """``passed``, ``created`` (a first run writes the snapshot; that is no pass) or what differs, for each table with the hint ``test``.

    ``test(no_rows)`` expects none. ``limit`` bounds the rows that a test table may have; more of them is a failure.
    """
    os.makedirs(folder, exist_ok=True)
    out = {}
    for table in [t for t in engine.tables.values() if "test" in t.hints]:
        rows = rendered(engine.query(table.name, limit=limit + 1))
        if len(rows) > limit:
            out[table.name] = f"more than {limit} rows"
            continue
        if not table.order:
            rows.sort(key=lambda r: json.dumps(r, sort_keys=True))
        if (table.hints.args("test") or [""])[:1] == ["no_rows"]:
            out[table.name] = "passed" if not rows else f"{len(rows)} rows where none should be"
            continue
        path = os.path.join(folder, f"{table.name}.snapshot")
        if not os.path.exists(path):
            with open(path, "w", encoding="utf-8") as f:
                json.dump(rows, f, indent=1, sort_keys=True)
            out[table.name] = "created"
            continue
        with open(path, encoding="utf-8") as f:
            want = json.load(f)
        if rows == want:
            out[table.name] = "passed"
        else:
            i = next((i for i, (a, b) in enumerate(zip(rows, want, strict=False)) if a != b), min(len(rows), len(want)))
            out[table.name] = f"{len(rows)} rows for {len(want)}; the first that differs is {i}: {rows[i : i + 1]} for {want[i : i + 1]}"
    return out
