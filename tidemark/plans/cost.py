"""View or table: where a definition is computed once and stored, and where each query computes it."""

from __future__ import annotations

from dataclasses import dataclass

#: How computing on write counts against computing on read, by model.
WRITE_FACTOR = {"DEFAULT": 0.1, "READ": 0.1, "WRITE": 10.0}


@dataclass(frozen=True)
class Node:
    """A definition: its join cost, how many others and queries read it, its rows if they are known."""

    name: str
    join_cost: float
    readers: int
    rows: int | None = None
    pinned: str | None = None


def stage(node: Node, model: str = "DEFAULT") -> str:
    """``table`` if computing it once on write is cheaper than on each read, else ``view``.

    A hint pins it. Without a join the view is as good: a scan costs what reading the table would.
    """
    if node.pinned in ("view", "table"):
        return node.pinned
    if model == "READ":
        write = 1.0
    else:
        write = WRITE_FACTOR[model] * node.join_cost
    read = node.join_cost * max(1, node.readers) if model != "READ" else 2.0 * max(1, node.readers)
    return "table" if node.join_cost > 1 and write < read and node.readers > 1 else "view"


def shares_scan(scans: int, rows: int | None, divisor: float = 1.0) -> bool:
    """Whether a table that one query scans repeatedly should be read once and kept: more scans than the log of its size allows."""
    import math

    return rows is not None and scans >= 2 and scans > max(1.0, (math.log2(max(rows, 1)) - 20) / divisor)
