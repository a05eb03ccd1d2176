"""Streams give what the batch forms give: events are replayed as files in order of time."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.upsert import StateTable
from tidemark.plans.engine import Engine
from tidemark.streaming import joins, state, windows


@pytest.fixture(scope="module")
def replay(spark, sf, tmp_path_factory):
    """A folder with the events in ten files in order of time, and the batch frame."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).cache()
    bounds = events.approxQuantile("event_id", [i / 5 for i in range(6)], 0)
    for i in range(5):
        events.filter((F.col("event_id") >= bounds[i]) & ((F.col("event_id") < bounds[i + 1]) | F.lit(i == 4))).coalesce(1).write.mode("append").parquet(folder)
    return folder, events


def stream(spark, replay, delay="100 days"):
    folder, events = replay
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(folder).withWatermark("ts", delay)


def run(df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(map(tuple, df.sparkSession.table(name).collect()), key=str)


AGGS = {"n": F.count, "top": F.max}


@pytest.mark.parametrize("kind", ["tumble", "hop", "cumulate", "session"])
def test_windows(spark, replay, tmp_path, kind):
    aggs = {"n": F.count("*"), "top": F.max("value")}
    make = {
        "tumble": lambda d: windows.tumble(d, "ts", "30 minutes", ["user_id"], aggs),
        "hop": lambda d: windows.hop(d, "ts", "15 minutes", "30 minutes", ["event_type"], aggs),
        "cumulate": lambda d: windows.cumulate(d, "ts", "10 minutes", "1 hour", ["event_type"], aggs),
        "session": lambda d: windows.session(d, "ts", "20 minutes", ["user_id"], aggs),
    }[kind]
    got = run(make(stream(spark, replay)), "complete", f"w_{kind}", tmp_path)
    assert got == sorted(map(tuple, make(replay[1]).collect()), key=str) and len(got) > 5


def test_stream_interval_join(spark, replay, tmp_path):
    def make(d):
        a = d.filter("event_type = 'click'").select("event_id", "user_id", "ts")
        b = d.filter("event_type = 'purchase'").selectExpr("event_id AS b_id", "user_id AS b_user", "ts AS b_ts")
        return joins.interval_join(a, b, [("user_id", "b_user")], "ts", "b_ts", "0 minutes", "60 minutes").select("event_id", "b_id")

    assert run(make(stream(spark, replay)), "append", "ij", tmp_path) == sorted(map(tuple, make(replay[1]).collect()), key=str)


def test_upsert_gives_the_latest_row_of_each_key(spark, replay, tmp_path):
    _, events = replay
    table = StateTable(spark, str(tmp_path / "state"), events.schema, ["user_id"], "newer", "ts")
    q = state.upsert(stream(spark, replay), table, str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None
    want = events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    assert sorted(map(tuple, table.read().select("user_id", "ts").collect())) == sorted(map(tuple, want.collect()))


def test_temporal_join_in_batches(spark, replay, tmp_path):
    _, events = replay
    versions = events.filter("event_type = 'error'").selectExpr("event_id AS v_id", "user_id AS v_user", "ts AS v_ts")
    out = []
    join = joins.temporal_join_batches(lambda: versions, [("user_id", "v_user")], "ts", "v_ts", "v", lambda d, n: out.extend(d.select("event_id", "v.v_id").collect()), "left")
    q = stream(spark, replay).writeStream.foreachBatch(join).option("checkpointLocation", str(tmp_path / "tj")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = {r["event_id"]: r["v_id"] for r in out}
    rows = events.collect()
    for r in rows[:200]:
        fits = [(v["ts"], v["event_id"]) for v in rows if v["event_type"] == "error" and v["user_id"] == r["user_id"] and v["ts"] <= r["ts"]]
        assert got[r["event_id"]] == (max(fits)[1] if fits else None)


def test_changelog_counts_up(spark, replay, tmp_path):
    got = run(state.changelog(stream(spark, replay).select("event_type", "value", "ts"), "event_type", "value", "ts"), "append", "cl", tmp_path)
    kinds = {r[0] for r in got}
    for k in kinds:
        own = sorted(r[3] for r in got if r[0] == k)
        assert own == list(range(1, len(own) + 1))
    assert sum(1 for r in got if r[2] == "+I") == len(kinds)


@pytest.mark.parametrize(("run_rows", "block"), [(10**6, 40), (100, 7), (64, 1000), (1, 1)])
def test_rows_in_order_hold_a_bounded_part(run_rows, block):
    rng = np.random.default_rng(5)
    n = 60 if run_rows == 1 else 1000
    df = pd.DataFrame({"t": pd.to_datetime(rng.integers(0, 90, n), unit="s"), "v": np.arange(n)})
    df.loc[::17, "t"] = pd.NaT
    given = (df.iloc[i : i + 37] for i in range(0, n, 37))
    got = list(state.in_order(given, "t", run_rows, block))
    assert max(map(len, got)) <= block
    assert pd.concat(got)["v"].tolist() == df.sort_values("t", kind="stable")["v"].tolist()
    assert list(state.in_order([], "t")) == []


def test_changelog_of_many_rows_of_a_key_comes_in_order(spark, replay, tmp_path, monkeypatch):
    frames = []
    monkeypatch.setattr(state, "RUN", 50)
    monkeypatch.setattr(state, "BLOCK", 20)
    seen = replay[1].selectExpr("event_type", "value", "ts").toPandas()
    for kind, rows in seen.groupby("event_type"):
        frames = list(state.in_order([rows[["value", "ts"]]], "ts"))
        assert len(frames) >= len(rows) // 20 and pd.concat(frames)["ts"].is_monotonic_increasing
    got = run(state.changelog(stream(spark, replay).select("event_type", "value", "ts"), "event_type", "value", "ts"), "append", "cl2", tmp_path)
    last = {k: max((n, total) for key, _, _, n, total in got if key == k) for k in {r[0] for r in got}}
    want = {r["event_type"]: (r["n"], r["s"]) for r in replay[1].groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    assert {k: n for k, (n, _) in last.items()} == {k: n for k, (n, _) in want.items()} and all(abs(last[k][1] - want[k][1]) < 1e-6 * abs(want[k][1]) for k in want)


def test_first_per_key(spark, replay, tmp_path):
    got = run(windows.first_per_key(stream(spark, replay), ["user_id"]).select("user_id"), "append", "fk", tmp_path)
    assert len(got) == replay[1].select("user_id").distinct().count()


def test_windows_of_a_script_leave_the_state(spark, replay, tmp_path):
    """Append mode needs the watermark on the window; the last windows stay open until the watermark passes them."""
    folder, _ = replay
    text = f"""CREATE TABLE Events (event_id BIGINT, ts TIMESTAMP_LTZ(3), user_id BIGINT, event_type STRING, value DOUBLE, WATERMARK FOR ts AS ts - INTERVAL '1' MINUTE) WITH ('connector' = 'filesystem', 'format' = 'parquet', 'path' = '{folder}', 'max-files' = '1');
    Hourly := SELECT window_start, window_end, event_type, count(*) AS n FROM TABLE(TUMBLE(TABLE Events, DESCRIPTOR(ts), INTERVAL '1' HOUR)) GROUP BY window_start, window_end, event_type;"""
    live, batch = Engine(spark, streaming=True).run(text), Engine(spark).run(text)
    got = run(live.query("Hourly"), "append", "hourly", tmp_path)
    want = sorted(map(tuple, batch.query("Hourly").collect()), key=str)
    assert got and set(got) <= set(want)


def test_subscriptions(spark, replay, tmp_path):
    folder, events = replay
    text = f"""CREATE TABLE Events (event_id BIGINT, ts TIMESTAMP_LTZ(3), value DOUBLE) WITH ('connector' = 'filesystem', 'format' = 'parquet', 'path' = '{folder}');
    High := SUBSCRIBE SELECT event_id FROM Events WHERE value > 100;"""
    seen = []
    e = Engine(spark, streaming=True).run(text)
    assert e.table("High").subscribe
    e.subscribe("High", lambda d, n: seen.extend(r["event_id"] for r in d.collect()), str(tmp_path / "sub"), available_now=True).awaitTermination(120)
    assert sorted(seen) == sorted(r["event_id"] for r in events.filter("value > 100").collect())


def test_script_over_a_stream(spark, replay, tmp_path):
    folder, _ = replay
    text = f"""CREATE TABLE Events (event_id BIGINT, ts TIMESTAMP_LTZ(3), user_id BIGINT, event_type STRING, value DOUBLE, WATERMARK FOR ts AS ts - INTERVAL '1' DAY) WITH ('connector' = 'filesystem', 'format' = 'parquet', 'path' = '{folder}');
    Clicks := SELECT event_id, value FROM Events WHERE event_type = 'click';"""
    live, batch = Engine(spark, streaming=True).run(text), Engine(spark).run(text)
    assert live.query("Clicks").isStreaming
    assert run(live.query("Clicks"), "append", "sc", tmp_path) == sorted(map(tuple, batch.query("Clicks").collect()), key=str)


def test_registered_streams_over_an_empty_table(spark, sf, tmp_path):
    from tidemark.streaming.queries import QUERIES

    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_tumble", "stream_interval_join", "stream_temporal_join", "stream_upsert"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0
