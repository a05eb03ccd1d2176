"""Readers and writers by connector options."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import distinct_on

#: Connectors that only take rows.
SINKS = ("print", "blackhole", "logger", "log", "elasticsearch-6", "elasticsearch-7", "opensearch", "firehose", "prometheus")
_FORMATS = {"flexible-json": "json", "json": "json", "flexible-csv": "csv", "csv": "csv", "parquet": "parquet", "orc": "orc", "avro": "avro", "raw": "text"}
#: Of a streaming file source: files taken in one batch at most.
MAX_FILES = 1000


@dataclass
class Connector:
    """The options of a table's WITH clause."""

    options: Mapping[str, str] = field(default_factory=dict)

    @property
    def kind(self) -> str:
        return self.options.get("connector", "").lower()

    @property
    def format(self) -> str:
        name = self.options.get("format", "parquet").lower()
        if name not in _FORMATS:
            raise ValueError(f"format {name} is not known")
        return _FORMATS[name]

    @property
    def flexible(self) -> bool:
        """Whether values are taken as they are found: read as text and cast, what doesn't fit becomes null."""
        return self.options.get("format", "").lower().startswith("flexible-")

    @staticmethod
    def _nested(f: T.StructField) -> bool:
        return isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType)

    def reader_options(self) -> dict[str, str]:
        own: dict[str, str] = {}
        if self.format == "csv":
            own = {"header": self.options.get("csv.header", "true"), "sep": self.options.get("csv.field-delimiter", ","), "mode": "PERMISSIVE"}
        if self.format == "json":
            own = {"mode": "PERMISSIVE"}
        return own | {k.removeprefix("spark."): v for k, v in self.options.items() if k.startswith("spark.")}

    @property
    def path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("the connector needs a path")
        return path

    def read(self, spark: SparkSession, schema: T.StructType | None, streaming: bool = False) -> DataFrame:
        """Rows of the source, as a batch or as a stream."""
        kind = self.kind
        if kind in SINKS:
            raise ValueError(f"{kind} only takes rows")
        if kind in ("filesystem", "file", "iceberg"):
            if kind == "iceberg" and "path" not in self.options:
                return spark.readStream.table(self.options["catalog-table"]) if streaming else spark.table(self.options["catalog-table"])
            source = spark.readStream if streaming else spark.read
            source = source.format(self.format).options(**self.reader_options())
            if streaming:
                source = source.option("maxFilesPerTrigger", self.options.get("max-files", str(MAX_FILES)))
            if schema is None:
                return source.load(self.path)
            if not self.flexible:
                return source.schema(schema).load(self.path)
            rows = source.schema(T.StructType([T.StructField(f.name, f.dataType if self._nested(f) else T.StringType()) for f in schema])).load(self.path)
            return rows.select(*[F.col(f"`{f.name}`") if self._nested(f) else F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])
        if kind in ("kafka", "kafka-safe", "upsert-kafka", "upsert-kafka-safe"):
            source = (spark.readStream if streaming else spark.read).format("kafka")
            source = source.option("kafka.bootstrap.servers", self.options["properties.bootstrap.servers"]).option("subscribe", self.options["topic"]).option("startingOffsets", "earliest")
            return self.records(source.load(), schema)
        if kind == "jdbc" or kind.startswith("jdbc-"):
            return spark.read.format("jdbc").options(**self._jdbc(), dbtable=self.options["table-name"], **self._jdbc_parts()).load()
        if kind == "datagen":
            rate = self.options.get("rows-per-second", "10")
            if streaming:
                base = spark.readStream.format("rate").option("rowsPerSecond", rate).load().select(F.col("value").alias("_n"))
            else:
                base = spark.range(int(self.options.get("number-of-rows", "100"))).withColumnRenamed("id", "_n")
            return base.select(*[self._generated(f) for f in schema]) if schema is not None else base
        raise ValueError(f"connector {kind or '(none)'} is not known")

    def records(self, rows: DataFrame, schema: T.StructType | None) -> DataFrame:
        """The log's records (key, value, timestamp) as rows of ``schema``.

        The record's time fills a column that the definition takes from the metadata ``timestamp`` (option ``timestamp-column``). An
        upserting log's key has the columns of the option ``key.fields``; a record without a value removes its key and
        becomes a row with the key alone and true in ``_removed``. Other logs skip such records.
        """
        if schema is None:
            return rows.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("_timestamp"))
        upserts = self.kind.startswith("upsert-")
        value = F.from_json(F.col("value").cast("string"), schema)
        keys = [c for c in self.options.get("key.fields", "").replace(",", ";").split(";") if c]
        rows = rows.select(value.alias("v"), F.from_json(F.col("key").cast("string"), T.StructType([schema[c] for c in keys])).alias("k") if keys else F.lit(None).alias("k"), F.col("timestamp").alias("_timestamp"), F.col("value").isNull().alias("_removed"))
        rows = rows.filter("v IS NOT NULL OR (_removed AND k IS NOT NULL)" if upserts and keys else "v IS NOT NULL")
        stamped = self.options.get("timestamp-column")
        columns = []
        for f in schema:
            c = F.coalesce(f"k.`{f.name}`", f"v.`{f.name}`") if f.name in keys else F.col(f"v.`{f.name}`")
            columns.append((F.col("_timestamp").cast(f.dataType) if f.name == stamped else c).alias(f.name))
        return rows.select(*columns, *(["_removed"] if upserts and keys else []))

    def _jdbc(self) -> dict[str, str]:
        return {"url": self.options["url"]} | {k: self.options[o] for k, o in (("user", "username"), ("password", "password"), ("driver", "driver")) if o in self.options}

    def _jdbc_parts(self) -> dict[str, str]:
        """A large table is read in ranges of a column, one query and task for each."""
        given = {to: self.options[f"scan.partition.{o}"] for to, o in (("partitionColumn", "column"), ("numPartitions", "num"), ("lowerBound", "lower-bound"), ("upperBound", "upper-bound")) if f"scan.partition.{o}" in self.options}
        if given and len(given) < 4:
            raise ValueError("scan.partition needs column, num, lower-bound and upper-bound")
        return given

    def _upsert(self, df: DataFrame, keys: list[str], time: str | None) -> None:
        """Rows into a database table by key: they are written to a staging table in parallel, then merged by one statement, which a repeated write doesn't change.

        ``sink.upsert-mode``: overwrite (the row that comes stays), newer (the one with the later ``time``) or ignore (the one that is there).
        """
        mode = self.options.get("sink.upsert-mode", "newer" if time in df.columns else "overwrite")
        if mode == "newer" and not time:
            raise ValueError("mode newer needs a time")
        target, stage = self.options["table-name"], f"{self.options['table-name']}_stage_{uuid.uuid4().hex[:12]}"
        order = [(time, True, None)] if time in df.columns else [(c, True, None) for c in df.columns if c not in keys]
        distinct_on(df, keys, order).write.format("jdbc").options(**self._jdbc(), dbtable=stage).save()
        quoted = lambda c: f'"{c}"'
        on = " AND ".join(f"t.{quoted(k)} = s.{quoted(k)}" for k in keys)
        rest = [c for c in df.columns if c not in keys]
        update = f"WHEN MATCHED{f' AND s.{quoted(time)} >= t.{quoted(time)}' if mode == 'newer' else ''} THEN UPDATE SET {', '.join(f'{quoted(c)} = s.{quoted(c)}' for c in rest)} " if rest and mode != "ignore" else ""
        insert = f"WHEN NOT MATCHED THEN INSERT ({', '.join(map(quoted, df.columns))}) VALUES ({', '.join(f's.{quoted(c)}' for c in df.columns)})"
        jvm = df.sparkSession.sparkContext._jvm
        info = self._jdbc()
        properties = jvm.java.util.Properties()
        for k in ("user", "password"):
            if k in info:
                properties.setProperty(k, info[k])
        connection = jvm.java.sql.DriverManager.getConnection(info["url"], properties)
        try:
            statement = connection.createStatement()
            statement.executeUpdate(f"MERGE INTO {target} t USING {stage} s ON {on} {update}{insert}")
            statement.executeUpdate(f"DROP TABLE {stage}")
        finally:
            connection.close()

    @staticmethod
    def _generated(f: T.StructField):
        n = F.col("_n")
        if isinstance(f.dataType, T.StringType):
            return F.substring(F.md5(F.concat(n.cast("string"), F.lit(f.name))), 1, 16).alias(f.name)
        if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType):
            return F.timestamp_seconds(n).cast(f.dataType).alias(f.name)
        if isinstance(f.dataType, T.BooleanType):
            return (n % 2 == 0).alias(f.name)
        return n.cast(f.dataType).alias(f.name)

    def write(self, df: DataFrame, mode: str = "append", partition_by: list[str] | None = None, checkpoint: str | None = None, keys: list[str] | None = None, time: str | None = None):
        """Rows to the sink; a stream gives its running query. ``keys`` and ``time`` are those of the sink's rows, for sinks that upsert."""
        kind = self.kind
        if df.isStreaming:
            sink = df.writeStream.option("checkpointLocation", checkpoint) if checkpoint else df.writeStream
            if kind in ("print", "logger", "log"):
                return sink.format("console").start()
            if kind in ("filesystem", "file", "iceberg"):
                return sink.format(self.format).partitionBy(*(partition_by or [])).start(self.path)
            if kind == "blackhole":
                return sink.format("noop").start()
            raise ValueError(f"connector {kind} takes no stream here")
        if kind in ("print", "logger", "log"):
            print(" | ".join(df.columns))
            for row in df.toLocalIterator():  # all rows, a partition at a time
                print(" | ".join("NULL" if v is None else str(v) for v in row))
        elif kind == "blackhole":
            df.write.format("noop").mode("overwrite").save()
        elif kind in ("filesystem", "file", "iceberg"):
            stored(df).write.format(self.format).mode(mode).partitionBy(*(partition_by or [])).options(**({"header": "true"} if self.format == "csv" else {})).save(self.path)
        elif kind == "jdbc" or kind.startswith("jdbc-"):
            if keys and mode == "append":
                self._upsert(stored(df), keys, time)
            else:
                stored(df).write.format("jdbc").options(**self._jdbc(), dbtable=self.options["table-name"]).mode(mode).save()
        elif kind.endswith(("kafka", "kafka-safe")):
            by = keys if keys and kind.startswith("upsert-") else partition_by or df.columns
            key = F.to_json(F.struct(*[F.col(f"`{c}`") for c in by]))
            df.select(key.alias("key"), F.to_json(F.struct("*")).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", self.options["properties.bootstrap.servers"]).option("topic", self.options["topic"]).save()
        else:
            raise ValueError(f"connector {kind} is not known")
        return None


def stored(df: DataFrame) -> DataFrame:
    """``df`` in types that sinks take: JSON values become text, unnamed nulls strings."""
    casts = {}
    for f in df.schema:
        if f.dataType.typeName() == "variant":
            casts[f.name] = F.to_json(F.col(f"`{f.name}`"))
        elif f.dataType.typeName() in ("void", "null"):
            casts[f.name] = F.col(f"`{f.name}`").cast("string")
        elif "interval" in f.dataType.typeName():
            casts[f.name] = F.col(f"`{f.name}`").cast("string")
    return df.withColumns(casts) if casts else df
