r"""Operator 7: blocks of lines that an earlier document has, found by pairwise alignment.

What links documents are hashes of lines that are rare enough to mean a passage: every shortest
run of adjacent lines that reaches ``min_words``, from each line on and up to each line (a line
alone if it has as many words). A block that is deleted holds such runs from its first line to
its last, so none is missed, and a short line that many documents have links nothing. Each run
is linked to the earliest document (smallest doc_id) that has it, and documents are paired with
those that their runs link to; so a run that n documents share makes n - 1 pairs, not n^2,
however frequent it is, and no threshold is needed between rare and frequent lines. A pair's
line hashes are aligned by patience diff: lines that are unique in both are matched in the longest increasing order, and between and
around the matches the alignment recurses and grows over equal neighbours; blocks in another order are added by
their runs. Aligned runs
of at least ``min_words`` words are deleted from the later document. The first occurrence of a line is
never deleted, so nothing is lost from the corpus.

Lines are compared without outer white space; blank lines never begin or end a block.
Defined cases: null text stays null; an empty text stays; rows that share a doc_id
count as one document and each loses the blocks it has at those places; null ids are
left alone; an empty table gives no rows; other columns pass unchanged, except
``n_chars``, which follows the text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import each_list, read, table, unused

#: Words of an aligned block that is deleted, at least.
MIN_WORDS = 40


def line_hashes(text: str | None) -> tuple[list[int], list[int]]:
    """Of each line: a signed 64-bit hash (0 for a blank one) and its words."""
    hashes, words = [], []
    for line in (text or "").split("\n"):
        parts = line.split()
        hashes.append((xxhash.xxh64_intdigest(line.strip().encode("utf-8", "surrogatepass")) | 1) - (1 << 63) if parts else 0)
        words.append(len(parts))
    return hashes, words


def runs(hashes: list[int], words: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(start, end, hash) of the shortest runs of lines with ``min_words`` words, from each line on and up to each line; their ends aren't blank."""
    sums = np.concatenate([[0], np.cumsum(words)])
    full = np.flatnonzero(np.array(words) > 0)
    start, end = full, np.searchsorted(sums, sums[full] + min_words)  # from each line on
    found = [(i, j) for i, j in zip(start.tolist(), end.tolist(), strict=True) if j < len(sums)]
    first = np.searchsorted(sums, sums[full + 1] - min_words, "right") - 1  # up to each line
    found += [(i, j + 1) for i, j in zip(first.tolist(), full.tolist(), strict=True) if i >= 0]
    data = np.array(hashes, np.int64).tobytes()
    return [(i, j, xxhash.xxh64_intdigest(data[8 * i : 8 * j]) - (1 << 63)) for i, j in sorted(set(found))]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal, non-blank lines, increasing in both."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        alo, ahi, blo, bhi = stack.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        in_a, in_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        at = {h: j for j, h in enumerate(b[blo:bhi], blo) if h and in_b[h] == 1}
        unique = [(i, at[h]) for i, h in enumerate(a[alo:ahi], alo) if in_a[h] == 1 and h in at]
        if not unique:  # repeated lines only: the first of each that keeps the order
            after: dict[int, list[int]] = {}
            for j in range(blo, bhi):
                after.setdefault(b[j], []).append(j)
            j = blo
            for i in range(alo, ahi):
                places = after.get(a[i]) if a[i] else None
                if places and (k := bisect_left(places, j)) < len(places):
                    out.append((i, places[k]))
                    j = places[k] + 1
            continue
        tops, last, back = [], [], {}
        for i, j in unique:  # longest increasing run of places in b
            k = bisect_left(tops, j)
            back[i, j] = last[k - 1] if k else None
            if k == len(tops):
                tops.append(j)
                last.append((i, j))
            else:
                tops[k], last[k] = j, (i, j)
        chain, x = [], last[-1]
        while x is not None:
            chain.append(x)
            x = back[x]
        chain.reverse()
        out += chain
        edges = [(alo - 1, blo - 1), *chain, (ahi, bhi)]
        stack += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Places of ``b`` in aligned runs of at least ``min_words`` words; ``words`` are those of b's lines.

    An alignment keeps the order of both, so blocks that cross it, or that ``b`` has again, are left over; if enough
    shared lines are, those in runs that both have are added.
    """
    out: set[int] = set()
    run: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if run and (i, j) != (before[0] + 1, before[1] + 1):
            while run and not b[run[-1]]:
                run.pop()
            while run and not b[run[0]]:
                run.pop(0)
            if sum(words[k] for k in run) >= min_words:
                out.update(run)
            run = []
        run.append(j)
        before = (i, j)
    in_a = set(a)
    if sum(w for k, (h, w) in enumerate(zip(b, words, strict=True)) if h in in_a and k not in out) >= min_words:
        known = dict(zip(b, words, strict=True))  # a line that only a has ends every run that b could have
        shared = {h for _, _, h in runs(a, [known.get(h, min_words) for h in a], min_words)}
        for i, j, h in runs(b, words, min_words):
            if h in shared:
                out.update(range(i, j))
    return sorted(out)


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, lines): the places and hashes of the lines to delete, for documents that have any."""

    def hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            both = [line_hashes(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in both], pa.list_(pa.int64())), pa.array([w for _, w in both], pa.list_(pa.int32())), pa.array([[x for _, _, x in runs(h, w, min_words)] for h, w in both], pa.list_(pa.int64()))], ["doc_id", "h", "w", "r"])

    own = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # what is joined below is written first, so that the joins' sides are plain shuffles, which adaptive execution splits at hot keys
    seqs = own.mapInArrow(hashed, "doc_id long, h array<long>, w array<int>, r array<long>").filter(F.size("h") > 0)
    seqs = table(seqs.groupBy("doc_id").agg(F.min(F.struct("h", "w", "r")).alias("x")).select("doc_id", "x.h", "x.w", "x.r"))
    keys = seqs.select("doc_id", F.explode(F.array_distinct("r")).alias("run"))
    first = table(keys.groupBy("run").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1).drop("n"))
    pairs = table(keys.join(first, "run").filter(F.col("first") < F.col("doc_id")).select("doc_id", "first").distinct())
    # both texts' hashes meet; a document that many link to is a hot key of the second join
    earlier = seqs.select(F.col("doc_id").alias("first"), F.col("h").alias("a"))
    later = seqs.select("doc_id", F.col("h").alias("b"), "w")
    met = pairs.join(later, "doc_id").join(earlier, "first").select("doc_id", "a", "b", "w")

    def aligned(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids, found = [], []
            for doc_id, a, b, w in zip(batch.column(0).to_pylist(), *(each_list(batch.column(i)) for i in (1, 2, 3)), strict=True):
                if places := common_blocks(a, b, w, min_words):
                    ids.append(doc_id)
                    found.append([{"at": p, "h": b[p]} for p in places])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.struct([("at", pa.int32()), ("h", pa.int64())])))], ["doc_id", "lines"])

    blocks = met.mapInArrow(aligned, "doc_id long, lines array<struct<at: int, h: long>>")
    each = blocks.select("doc_id", F.explode("lines").alias("x")).distinct()
    return table(each.groupBy("doc_id").agg(F.collect_list("x").alias("lines")))


def without_blocks(docs: DataFrame, min_words: int = MIN_WORDS, deleted: str = "_deleted") -> DataFrame:
    """``docs`` with the text left after the deletions, and a column ``deleted``: how many lines went."""
    names = docs.columns
    at, id_, lines_ = names.index("text"), unused(names, "_id"), unused(names, "_lines")
    gone = deletions(docs, min_words).withColumnsRenamed({"doc_id": id_, "lines": lines_})
    joined = docs.join(gone, F.col("doc_id") == F.col(id_), "left").drop(id_)
    schema = StructType([*docs.schema.fields, gone.schema[lines_], StructField(deleted, IntegerType())])

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts, counts = batch.column(at).to_pylist(), [0] * batch.num_rows
            marks = batch.column(len(names))
            for row in np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False)).tolist():
                if texts[row] is None:
                    continue
                drop = {(x["at"], x["h"]) for x in marks[row].as_py()}
                hashes, lines = line_hashes(texts[row])[0], texts[row].split("\n")
                keep = [line for i, (line, h) in enumerate(zip(lines, hashes, strict=True)) if (i, h) not in drop]
                texts[row], counts[row] = "\n".join(keep), len(lines) - len(keep)
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], [*batch.schema.names, deleted])

    out = joined.select(*names, lines_).mapInArrow(cut, schema).drop(lines_)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(deleted) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the blocks; documents of which nothing but white space is left go."""
    deleted = unused(docs.columns, "_deleted")
    out = without_blocks(docs, min_words, deleted)
    return out.filter((F.col(deleted) == 0) | F.col("text").rlike(r"\S")).drop(deleted)


def op7_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_blocks(read(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("_deleted").cast("long").alias("n_deleted"), F.length(text).cast("long").alias("n_chars_left"), F.crc32(text).alias("text_crc32"))
