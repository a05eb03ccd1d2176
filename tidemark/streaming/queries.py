"""Queries that run as streams: a table is replayed through Structured Streaming to its end, and the result is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.upsert import StateTable
from ..sources.scratch import scratch
from . import joins, state, windows

#: A bound that no row of the replayed tables exceeds, so that the result doesn't depend on the order of files.
DELAY = "3650 days"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream with a watermark; zoned timestamps, as stateful operators need them."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # as a pattern, since a stream's path must be a folder otherwise
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{sf_dir}/events[.]parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", DELAY)


def _written(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What batches have written; nothing if there was no batch."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """The whole result of a stream whose source has an end: the last state in complete mode, all rows in append mode."""
    spark = stream.sparkSession
    path = scratch(spark, "streams")

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure replaces what it wrote before
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", scratch(spark, "stream-checkpoints")).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    out = _written(spark, path, stream.schema)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in out.dtypes if t == "timestamp"})


def _aggregated(make: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: finished(make(events(spark, sf_dir)), "complete").drop("window_time").withColumn("total", F.round("total", 2))


def _totals() -> dict:
    return {"n": F.count("*"), "total": F.sum("value")}


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    a = rows.select("event_id", "user_id", "ts")
    b = rows.filter("event_type = 'purchase'").selectExpr("event_id AS next_id", "user_id AS b_user", "ts AS b_ts")
    return finished(joins.interval_join(a, b, [("user_id", "b_user")], "ts", "b_ts", "0 minutes", "30 minutes").select("event_id", "next_id"), "append")


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    table = StateTable(spark, scratch(spark, "states"), rows.schema, ["user_id"], "newer", "ts")
    query = state.upsert(rows, table, scratch(spark, "stream-checkpoints"), available_now=True)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return table.read().withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def temporal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch is joined with the versions of its rows' times."""
    path = scratch(spark, "streams")
    errors = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'error'").selectExpr("event_id AS v_id", "CAST(ts AS TIMESTAMP) AS v_ts", "user_id AS v_user", "value AS v_value")
    keep = lambda d, n: d.select("event_id", "user_id", "v.v_id", "v.v_value").write.mode("overwrite").parquet(f"{path}/batch={n}")
    join = joins.temporal_join_batches(lambda: errors, [("user_id", "v_user")], "ts", "v_ts", "v", keep, "left")
    query = events(spark, sf_dir).writeStream.foreachBatch(join).option("checkpointLocation", scratch(spark, "stream-checkpoints")).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    schema = StructType.fromDDL("event_id long, user_id long, v_id long, v_value double")
    return _written(spark, path, schema)


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each type's running count was written, and its last value."""
    rows = finished(state.changelog(events(spark, sf_dir).select("event_type", "value", "ts"), "event_type", "value", "ts"), "append")
    return rows.groupBy("event_type").agg(F.count("*").alias("updates"), F.max("n").alias("n"), F.count(F.when(F.col("op") == "+I", 1)).alias("inserts"))


QUERIES = {
    "stream_tumble": _aggregated(lambda d: windows.tumble(d, "ts", "15 minutes", ["user_id"], _totals())),
    "stream_hop": _aggregated(lambda d: windows.hop(d, "ts", "5 minutes", "15 minutes", [], _totals())),
    "stream_cumulate": _aggregated(lambda d: windows.cumulate(d, "ts", "10 minutes", "1 hour", [], _totals())),
    "stream_session": _aggregated(lambda d: windows.session(d, "ts", "10 minutes", ["user_id"], _totals())),
    "stream_interval_join": interval_join,
    "stream_temporal_join": temporal_join,
    "stream_upsert": upsert,
    "stream_changelog": changelog,
}
#: The batch queries whose SQL gives the same rows.
SAME_AS = {"stream_tumble": "tumble", "stream_hop": "hop", "stream_cumulate": "cumulate", "stream_session": "session", "stream_interval_join": "interval_join", "stream_temporal_join": "temporal_join_left", "stream_upsert": "upsert_state"}
ORACLE_SQL = {"stream_changelog": "SELECT event_type, count(*) AS updates, count(*) AS n, 1::BIGINT AS inserts FROM events GROUP BY event_type"}
