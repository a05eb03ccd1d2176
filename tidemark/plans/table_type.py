"""Kinds of tables, and what operators make of them."""

from __future__ import annotations

from enum import Enum


class TableType(Enum):
    STREAM = "stream"
    VERSIONED_STATE = "versioned_state"
    STATE = "state"
    LOOKUP = "lookup"
    RELATION = "relation"
    STATIC = "static"

    @property
    def has_timestamp(self) -> bool:
        return self in (TableType.STREAM, TableType.VERSIONED_STATE)

    @property
    def has_primary_key(self) -> bool:
        return self is not TableType.RELATION

    @property
    def supports_temporal_join(self) -> bool:
        return self in (TableType.VERSIONED_STATE, TableType.LOOKUP)


def combine(a: TableType, b: TableType) -> TableType:
    """Of a join that is neither temporal nor bounded in time."""
    if TableType.LOOKUP in (a, b):
        return TableType.RELATION
    if TableType.STATIC in (a, b):
        return b if a is TableType.STATIC else a
    if TableType.RELATION in (a, b):
        return TableType.RELATION
    return TableType.STREAM if a is b is TableType.STREAM else TableType.STATE


def of_union(types: list[TableType], all_rows: bool) -> TableType:
    if all(t is TableType.STATIC for t in types):
        return TableType.STATIC
    if TableType.RELATION in types:
        return TableType.RELATION
    return TableType.STREAM if all_rows and all(t is TableType.STREAM for t in types) else TableType.STATE


#: The type of a source by its connector.
CONNECTORS = {
    "kafka": TableType.STREAM,
    "kafka-safe": TableType.STREAM,
    "file": TableType.STREAM,
    "filesystem": TableType.STREAM,
    "iceberg": TableType.STREAM,
    "upsert-kafka": TableType.VERSIONED_STATE,
    "upsert-kafka-safe": TableType.VERSIONED_STATE,
    "postgres-cdc": TableType.VERSIONED_STATE,
    "jdbc": TableType.LOOKUP,
}
#: The cost of a join by the type of its side, and its factor without an equality or a unique side.
JOIN_COST = {TableType.STREAM: 100.0, TableType.RELATION: 20.0, TableType.STATE: 10.0, TableType.VERSIONED_STATE: 4.0, TableType.LOOKUP: 2.0, TableType.STATIC: 1.0}
UNBOUND_FACTOR = 100.0


def of_connector(name: str | None) -> TableType:
    if name is not None and name.lower().startswith("jdbc-"):  # variants of a database connector
        return TableType.LOOKUP
    return TableType.RELATION if name is None else CONNECTORS.get(name.lower(), TableType.STREAM)
