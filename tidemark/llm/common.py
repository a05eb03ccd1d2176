"""What the operators share: text conventions, the shared scratch folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to words.
SPACE = r"[\x20\x09-\x0D]+"

#: A table is broadcast only when its measured size is at most this; beyond it, it is shuffled.
BROADCAST_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local one is made if everything runs in one process, else it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def table(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage like ``checkpoint()`` and survives lost executors, but is
    columnar and compressed, so later steps read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its counted rows fit ``limit`` bytes, else as it is (a shuffled join then).

    ``df`` should be a written table: it is counted here.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def batches(items: Iterable, schema: pa.Schema, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``rows`` from an iterable of row tuples."""
    block: list = []
    for item in items:
        block.append(item)
        if len(block) >= rows:
            yield record_batch(block, schema)
            block = []
    if block:
        yield record_batch(block, schema)


def record_batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def each_list(column: pa.ListArray) -> Iterator[list]:
    """The lists of numbers of a column without nulls, one at a time, so that a batch is never all Python objects."""
    ends, values = column.offsets.to_numpy(), column.values
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield values.slice(start, end - start).to_numpy(zero_copy_only=False).tolist()


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 with only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower()
