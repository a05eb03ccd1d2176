"""Schemas found in data files and in Avro schema files."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Forms of timestamps that are recognised.
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?$"
BOOLEAN = r"^(?i:true|false)$"
INTEGER = r"^[+-]?\d{1,18}$"
DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
#: Tried in this order, from narrow to wide; a column gets the first that all its values have.
TRIED = (("boolean", BOOLEAN), ("timestamp", TIMESTAMP), ("bigint", INTEGER), ("double", DECIMAL))


def files_format(path: str) -> str:
    name = re.sub(r"\.(gz|bz2|zst)$", "", path.lower())
    if name.endswith((".jsonl", ".json", ".ndjson")):
        return "json"
    if name.endswith((".csv", ".tsv")):
        return "csv"
    if name.endswith(".avsc"):
        return "avsc"
    if name.endswith(".parquet"):
        return "parquet"
    raise ValueError(f"the format of {path} is not known")


def narrowed(df: DataFrame) -> DataFrame:
    """String columns cast to the narrowest type that all their values have: one pass that counts the values that fit."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    there = [F.count(F.when(F.trim(F.col(f"`{c}`")) != "", 1)).alias(f"{c}|any") for c in texts]
    fits = [F.count(F.when(F.col(f"`{c}`").rlike(p), 1)).alias(f"{c}|{t}") for c in texts for t, p in TRIED]
    found = df.agg(*there, *fits).first().asDict()
    casts = {}
    for c in texts:
        n = found[f"{c}|any"]
        kind = next((t for t, _ in TRIED if n and found[f"{c}|{t}"] == n), None)
        if kind:
            casts[c] = F.expr(f"try_cast(nullif(trim(`{c}`), '') AS {kind})")
    return df.withColumns(casts) if casts else df


def discover(spark: SparkSession, path: str, delimiter: str = ",") -> T.StructType:
    """The schema of a JSON-lines or CSV file (also compressed), timestamps among strings included."""
    kind = files_format(path)
    if kind == "avsc":
        return avro_schema(read_text(spark, path))
    if kind == "csv":
        return narrowed(spark.read.csv(path, header=True, sep=delimiter)).schema
    if kind == "json":
        return narrowed(spark.read.json(path)).schema
    return spark.read.parquet(path).schema


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, such as a script or a schema, from wherever Spark can read."""
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


_AVRO = {"string": T.StringType(), "bytes": T.BinaryType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
_LOGICAL = {"date": T.DateType(), "timestamp-millis": T.TimestampType(), "timestamp-micros": T.TimestampType(), "local-timestamp-millis": T.TimestampNTZType(), "local-timestamp-micros": T.TimestampNTZType(), "uuid": T.StringType(), "time-millis": T.StringType(), "time-micros": T.StringType()}


def avro_schema(text: str) -> T.StructType:
    """An Avro record schema in Spark's types; unions are of null and one type, and schemas don't contain themselves."""
    named: dict[str, dict] = {}

    def of(s, inside: tuple[str, ...]) -> tuple[T.DataType, bool]:
        if isinstance(s, list):
            rest = [x for x in s if x != "null"]
            if len(rest) != 1:
                raise ValueError("a union must be of null and one other type")
            return of(rest[0], inside)[0], True
        if isinstance(s, str):
            if s in _AVRO:
                return _AVRO[s], False
            if s not in named:
                raise ValueError(f"unknown Avro type {s}")
            return of(named[s], inside)
        kind = s["type"]
        if isinstance(kind, list | dict):
            return of(kind, inside)
        logical = s.get("logicalType")
        if logical == "decimal":
            return T.DecimalType(s["precision"], s.get("scale", 0)), False
        if logical in _LOGICAL:
            return _LOGICAL[logical], False
        if kind == "record":
            name = s["name"]
            if name in inside:
                raise ValueError(f"{name} contains itself")
            named[name] = s
            fields = []
            for f in s["fields"]:
                t, nullable = of(f["type"], (*inside, name))
                fields.append(T.StructField(f["name"], t, nullable))
            return T.StructType(fields), False
        if kind == "array":
            t, nullable = of(s["items"], inside)
            return T.ArrayType(t, nullable), False
        if kind == "map":
            t, nullable = of(s["values"], inside)
            return T.MapType(T.StringType(), t, nullable), False
        if kind == "enum":
            named[s["name"]] = s
            return T.StringType(), False
        if kind == "fixed":
            return T.BinaryType(), False
        if kind in _AVRO:
            return _AVRO[kind], False
        raise ValueError(f"unknown Avro type {kind}")

    return of(json.loads(text), ())[0]
