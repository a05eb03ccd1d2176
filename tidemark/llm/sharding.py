"""Operator 5 [native]: shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``bits`` bits: numbers by equal-depth cut points over
all rows, strings by hash. Rows are sorted by the index of their cell on the curve
and the order is cut into runs of equal row counts (law ``rows``: counts differ by one
at most). Neighbours on the curve are close in every dimension, so a shard's file
covers a narrow range of each of them and readers can skip it.

Only narrow columns are shuffled, once, to the range partitions of the order; a row's
rank is its place in its partition plus the rows of the partitions before. The
order ends in the text's hash and the id, so a hot cell or a text that a third of the
rows repeat is spread over many partitions, while equal texts with equal metadata stay
adjacent and at most one run in a cut is divided.

Defined cases: null text has no bytes; null in a dimension goes to bin 0; repeated
rows take their own slots; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial
from operator import gt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, small, table, text_of

BITS = 6
SHARDS = 16
#: Row numbers within a partition, in monotonically_increasing_id.
_PLACE = (1 << 33) - 1


def quantised(df: DataFrame, dims: Mapping[str, str], bits: int) -> list[Column]:
    """A bin from 0 to 2**bits - 1 for each dimension; ``dims`` maps columns to ``number`` or ``hash``."""
    numbers = [c for c, kind in dims.items() if kind == "number"]
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in numbers]).first() if numbers else {}
    out = []
    for c, kind in dims.items():
        if kind == "number":
            bounds = F.array(*[F.lit(x) for x in sorted(set(cuts[c] or [])) or [0]])
            bin_ = F.size(F.filter(bounds, partial(gt, F.col(c))))
        else:
            bin_ = F.pmod(F.xxhash64(c), F.lit(1 << bits)).cast("int")
        out.append(F.when(F.col(c).isNull(), 0).otherwise(bin_))
    return out


def hilbert_index(bins: list[Column], bits: int) -> Column:
    """The cell's index on the Hilbert curve, by the transposed-coordinates method, as one expression over an array."""
    n = len(bins)
    if n * bits > 62:
        raise ValueError("the index must fit 62 bits")
    steps = ", ".join(f"named_struct('q', {1 << b}, 'i', {i})" for b in range(bits - 1, 0, -1) for i in range(n))
    flips = ", ".join(str(1 << b) for b in range(bits - 1, 0, -1))
    x = "x"
    if bits > 1:
        # undo the excess rotations, from the highest bit down
        x = f"""aggregate(array({steps}), {x}, (x, s) -> transform(x, (v, j) ->
            CASE WHEN (x[s.i] & s.q) != 0 THEN IF(j = 0, v ^ (s.q - 1), v)
                 WHEN s.i != 0 AND (j = 0 OR j = s.i) THEN v ^ ((x[0] ^ x[s.i]) & (s.q - 1)) ELSE v END))"""
    # Gray code: each coordinate takes the xor of those before it
    gray = f"aggregate({x}, cast(array() as array<int>), (a, v) -> array_append(a, IF(size(a) = 0, v, v ^ a[size(a) - 1])))"
    if bits > 1:
        gray = f"""transform(array({gray}), g -> transform(g, v -> v ^ aggregate(array({flips}), 0, (t, q) -> IF((g[{n - 1}] & q) != 0, t ^ (q - 1), t))))[0]"""
    index = " + ".join(f"shiftleft(cast(shiftright(g[{i}], {b}) & 1 as bigint), {b * n + n - 1 - i})" for b in range(bits) for i in range(n))
    whole = f"transform(array({gray}), g -> {index})[0]"
    return F.expr(f"transform(array(bins), x -> {whole})[0]") if bins else F.lit(0).cast("long")


def hilbert_shards(df: DataFrame, dims: Mapping[str, str], n_shards: int = SHARDS, bits: int = BITS, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with hilbert, shard and slot (gapless in its shard). ``df`` should be narrow: it is written twice and shuffled.

    ``ties``: columns that order rows of one cell.
    """
    df = table(df)
    placed = df.withColumn("bins", F.array(*quantised(df, dims, bits))).withColumn("hilbert", hilbert_index(list(dims), bits)).drop("bins")
    order = ["hilbert", *ties]
    # the written table fixes the partitions: a range partitioning computed anew could differ
    ordered = table(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    parts = table(ordered.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_rows")))
    total = parts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0] or 1
    # a row for each range partition, so this window is over as many rows as there are partitions
    before = parts.withColumn("_before", F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).drop("_rows")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit(_PLACE))
    ranked = ordered.withColumn("_part", F.shiftright("_at", 33)).join(small(before, 64), "_part").withColumn("_rank", rank)
    shard = F.expr(f"_rank * {n_shards} div {total}L")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr(f"_rank - (cast(shard as bigint) * {total}L + {n_shards - 1}) div {n_shards}")).drop("_part", "_at", "_before", "_rank")


def document_metadata(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), F.col("lang"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("lines"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions that depend on the text alone, so that equal texts are neighbours: language, size, lines."""
    placed = hilbert_shards(document_metadata(read(spark, sf_dir, "documents")), {"lang": "hash", "size": "number", "lines": "number"}, ties=("text_hash", "doc_id"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
