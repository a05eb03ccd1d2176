"""Row patterns: ``MATCH_RECOGNIZE`` over sorted partitions.

Conditions are Spark expressions, with ``PREV(c)`` and ``NEXT(c)`` as windows, and are
evaluated in the JVM. What goes to Python is one small integer for each row, the set of the
symbols it can be, and the pattern is matched there as a regular expression over these sets.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def _compiled(pattern: str, symbols: Sequence[str]) -> re.Pattern:
    """``A B+ (C|D)?`` over letters that stand for sets of symbols."""
    bits = {s: 1 << i for i, s in enumerate(symbols)}
    letters = lambda s: "[" + "".join(re.escape(chr(0x100 + m)) for m in range(1 << len(symbols)) if m & bits[s]) + "]"
    out = re.sub(r"[A-Za-z_]\w*", lambda m: letters(m[0]) if m[0] in bits else _unknown(m[0]), pattern)
    return re.compile(out.replace(" ", ""))


def _unknown(name: str) -> str:
    raise ValueError(f"the pattern has {name}, which is not defined")


def match_recognize(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], pattern: str, define: dict[str, str], after_match: str = "past last row") -> DataFrame:
    """The rows of all matches, with match_number (from 1 in its partition) and matched_symbol.

    ``define`` maps symbols to conditions; a symbol of the pattern that isn't there is
    always true, as in the standard. A row that more than one symbol fits takes the first of
    them, by name, that keeps the pattern. ``after_match``: ``past last row`` or ``to next row``. A partition is held in
    one task's memory, as a few bytes for each row besides its own columns.
    """
    names = sorted({*define, *re.findall(r"[A-Za-z_]\w*", pattern)})
    if len(names) > 8:
        raise ValueError("at most 8 symbols")
    over = f"OVER (PARTITION BY {', '.join(partition_by)} ORDER BY {', '.join(order_by)})"
    mask = F.lit(0)
    for i, name in enumerate(names):
        text = re.sub(r"(?i)\bPREV\s*\(([^()]*)\)", rf"lag(\1) {over}", define.get(name, "true"))
        text = re.sub(r"(?i)\bNEXT\s*\(([^()]*)\)", rf"lead(\1) {over}", text)
        mask = mask + F.when(F.expr(text), 1 << i).otherwise(0)
    marked = df.withColumn("_mask", mask)
    regex = _compiled(pattern, names)
    step = after_match == "to next row"

    def found(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order_by])
        masks = rows.column("_mask").to_pylist()
        text = "".join(chr(0x100 + m) for m in masks)
        places, numbers, symbols = [], [], []
        at = number = 0
        while at <= len(text) and (m := regex.search(text, at)):
            if m.end() > m.start():
                number += 1
                places += range(m.start(), m.end())
                numbers += [number] * (m.end() - m.start())
                symbols += _labels(regex, names, masks[m.start() : m.end()])
            at = m.start() + 1 if step or m.end() == m.start() else m.end()
        out = rows.drop_columns(["_mask"]).take(pa.array(places, pa.int64()))
        return out.append_column("match_number", pa.array(numbers, pa.int64())).append_column("matched_symbol", pa.array(symbols, pa.string()))

    schema = StructType([*df.schema.fields, StructField("match_number", LongType()), StructField("matched_symbol", StringType())])
    return marked.groupBy(*partition_by).applyInArrow(found, schema)


def _labels(regex: re.Pattern, names: Sequence[str], masks: list[int]) -> list[str]:
    """A symbol for each row of a match: rows are fixed one after another to the first symbol that the pattern still allows."""
    fixed: list[int] = []
    for i, mask in enumerate(masks):
        for k in range(len(names)):
            if mask >> k & 1 and regex.fullmatch("".join(chr(0x100 + m) for m in [*fixed, 1 << k, *masks[i + 1 :]])):
                fixed.append(1 << k)
                break
    return [names[m.bit_length() - 1] for m in fixed]
