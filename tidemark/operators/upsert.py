"""Writing tables of state: newer rows replace older ones by key; and keys for rows without any."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dedup import distinct_on

MODES = ("newer", "ignore", "overwrite")


def merged(current: DataFrame, batch: DataFrame, keys: Sequence[str], mode: str, time: str | None = None, together: str | None = None) -> DataFrame:
    """``current`` after the rows of ``batch``; rows alike in the column ``together``, one of the keys, meet in one task.

    ``newer``: of each key the row with the latest ``time`` stays, of equal times the batch's (tables of
    state). ``ignore``: rows with known keys are left out (streams). ``overwrite``: the batch's row stays.
    Rows that share a key within the batch are resolved by ``time``, or else any one stays.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    both = current.withColumn("_new", F.lit(0)).unionByName(batch.select(current.columns).withColumn("_new", F.lit(1)))
    both = both.repartition(together) if together else both
    if mode == "newer":
        if time is None:
            raise ValueError("mode newer needs a time")
        order = [(time, True, True), ("_new", True, None)]
    elif mode == "ignore":
        order = [("_new", False, None), *([(time, False, None)] if time else [])]
    else:
        order = [("_new", True, None), *([(time, True, True)] if time else [])]
    return distinct_on(both, keys, order).drop("_new")


class StateTable:
    """A table of state in a folder, cut in ``buckets`` by a hash of the key.

    A write reads and rewrites the buckets that its rows fall into, and no others: it puts their new files in
    ``data/v<n>`` and then a list, ``lists/<n>``, that says which version each bucket has. The last
    list is the table, so a failed or repeated write leaves the one before whole. Buckets are as many as a table is given first;
    choose them so that one, state over ``buckets``, fits a task.
    """

    def __init__(self, spark: SparkSession, path: str, schema, keys: Sequence[str], mode: str = "overwrite", time: str | None = None, partition_by: Sequence[str] = (), buckets: int = 64):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.mode, self.time, self.partition_by, self.buckets = list(keys), mode, time, list(partition_by), buckets

    def _at(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return found, found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _lists(self) -> list[int]:
        folder, fs = self._at("lists")
        if not fs.exists(folder):
            return []
        return sorted(int(n) for n in (x.getPath().getName() for x in fs.listStatus(folder)) if n.isdigit())

    def _told(self, number: int) -> dict:
        path, fs = self._at(f"lists/{number}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def versions(self) -> tuple[int, dict[int, int]]:
        """The number of the last list, -1 where there is none, and the version of each bucket that has rows."""
        lists = self._lists()
        if not lists:
            return -1, {}
        told = self._told(lists[-1])
        self.buckets = told["buckets"]
        return lists[-1], {int(b): v for b, v in told["versions"].items()}

    def _stored(self, versions: dict[int, int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/v{v}/_bucket={b}" for b, v in sorted(versions.items())])

    def read(self) -> DataFrame:
        return self._stored(self.versions()[1])

    def write(self, batch: DataFrame) -> None:
        number, versions = self.versions()
        number += 1
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most the number of buckets
        if not touched:
            return
        before = self._stored({b: v for b, v in versions.items() if b in set(touched)})
        # rows of a bucket meet in one task, which resolves its keys and writes one file
        rows = merged(before.withColumn("_bucket", bucket), batch.withColumn("_bucket", bucket), ["_bucket", *self.keys], self.mode, self.time, "_bucket")
        rows.write.mode("overwrite").partitionBy("_bucket", *self.partition_by).parquet(f"{self.path}/data/v{number}")
        self._tell(number, versions | dict.fromkeys(touched, number))
        self._clean()

    def _tell(self, number: int, versions: dict[int, int]) -> None:
        """Write a list under another name and rename it, so that readers see all of it or nothing."""
        (part, fs), (whole, _) = self._at(f"lists/_{number}"), self._at(f"lists/{number}")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(json.dumps({"buckets": self.buckets, "versions": versions}).encode()))
        finally:
            stream.close()
        if not fs.rename(part, whole):
            raise RuntimeError(f"write {number} of {self.path} was done by another writer")

    def _clean(self) -> None:
        """Remove what neither the last list nor the one before, which readers may still have open, names."""
        lists = self._lists()
        named = {(v, int(b)) for n in lists[-2:] for b, v in self._told(n)["versions"].items()}
        data, fs = self._at("data")
        for version in fs.listStatus(data):
            v = int(version.getPath().getName()[1:])
            if v >= lists[-1]:
                continue
            if v not in {w for w, _ in named}:
                fs.delete(version.getPath(), True)
                continue
            for x in fs.listStatus(version.getPath()):
                name = x.getPath().getName()
                if name.startswith("_bucket=") and (v, int(name[8:])) not in named:
                    fs.delete(x.getPath(), True)
        for n in lists[:-2]:
            fs.delete(self._at(f"lists/{n}")[0], False)

    def for_each_batch(self, batch: DataFrame, _: int) -> None:
        """For ``writeStream.foreachBatch``; a batch that is repeated after a failure changes nothing."""
        self.write(batch)


def pk_hash(df: DataFrame, keys: Sequence[str] | None) -> DataFrame:
    """``df`` with __pk_hash for a sink that needs a key: constant without key columns, else a hash of ``keys``, or of all columns where there is no key (None)."""
    if keys is not None and not keys:
        value: Column = F.lit(1)
    else:
        value = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in (df.columns if keys is None else keys)]), {"ignoreNullFields": "false"}), 256)
    return df.withColumn("__pk_hash", value)


def expired(df: DataFrame, time: str, ttl_seconds: int, now: Column | None = None) -> DataFrame:
    """``df`` without rows older than their retention."""
    return df.filter(F.col(time) >= (now if now is not None else F.current_timestamp()) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds)))


#: Calendar widths of partitions in seconds, hour to year.
WIDTHS = {"hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}


def partition_width(ttl_seconds: int, parts: int = 10) -> str:
    """The widest calendar unit that still cuts the retention into ``parts`` partitions, an hour at least."""
    fitting = [name for name, s in WIDTHS.items() if s * parts <= ttl_seconds]
    return fitting[-1] if fitting else "hour"
