"""Operator 1: cost-balanced packing of documents into fixed-length token sequences.

A document's cost in a sequence is estimated as ``linear * n + quadratic * n**2``
(feed-forward plus attention within the document). Documents are taken in
descending cost and each goes to the lowest-cost sequence that still has room.

Every input partition is packed on its own, in blocks of a bounded number of
tokens, so nothing is shuffled and a task needs memory for one block and one
document. A block of T tokens gets ``T // max_len`` sequences of ``max_len``; the
rest of T is spread over sequences whose lengths are the powers of two of its
binary form. The room of all sequences is therefore exactly T: a document that
fits nowhere is cut to fill the sequence with the most room, its remainder goes
back in line, and no token of padding is left.

Defined cases: null text is an empty text and yields one end token; repeated rows
are packed once per row; an empty table gives no rows; extra columns are ignored.
Sequence ids are unique in one evaluation; evaluations with another partitioning
of the input pack differently.
"""

from __future__ import annotations

import heapq
import json
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, read, text_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
#: A new block begins after this many tokens.
BLOCK_TOKENS = 2_000_000


def capacities(tokens: int, max_len: int) -> list[int]:
    """Room of the sequences for ``tokens`` tokens: full ones, then powers of two that need no padding."""
    rest = tokens % max_len
    return [max_len] * (tokens // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], max_len: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int, float]]:
    """Pieces ``(document, start, length, sequence, offset, cost)`` that cover every token once."""
    cost = lambda n: linear * n + quadratic * n * n
    room = capacities(sum(lengths), max_len)
    # open: (cost so far, sequence) of those that may have room for the piece at hand; shut: (-room, sequence) of the others
    opened, shut = [], [(-r, s) for s, r in enumerate(room)]
    heapq.heapify(shut)
    at, load = [0] * len(room), [0.0] * len(room)
    line = [(-min(n, max_len), d, 0, n) for d, n in enumerate(lengths) if n]  # longest first, which is the costliest
    heapq.heapify(line)
    pieces = []
    while line:
        head, d, start, end = heapq.heappop(line)
        n = -head
        while shut and -shut[0][0] >= n:
            _, s = heapq.heappop(shut)
            heapq.heappush(opened, (load[s], s))
        while opened and room[opened[0][1]] - at[opened[0][1]] < n:
            _, s = heapq.heappop(opened)
            if at[s] < room[s]:
                heapq.heappush(shut, (at[s] - room[s], s))
        if opened:
            s = heapq.heappop(opened)[1]
        else:  # nothing has room for all of it: fill what has the most
            left, s = heapq.heappop(shut)
            n = -left
        pieces.append((d, start, n, s, at[s], cost(n)))
        at[s] += n
        load[s] += cost(n)
        if at[s] < room[s]:
            heapq.heappush(opened, (load[s], s))
        if start + n < end:
            heapq.heappush(line, (-min(end - start - n, max_len), d, start + n, end))
    return pieces


def byte_bpe(path: str) -> Callable[[str], bytes]:
    """An encoder of texts to little-endian unsigned 32-bit ids, for a byte-level BPE file of the library ``tokenizers``.

    The file's vocabulary and merges are run by ``tiktoken``, whose ids are the same
    (tests compare them) at several times the speed. Special tokens' strings, if the
    file has any that occur in a text, get their special ids, as ``tokenizers`` does.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = {c: b for b, c in _byte_letters().items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    everything = set(special)

    def whole(text: str) -> bytes:
        ids = bpe.encode(text, allowed_special=everything) if any(s in text for s in special) else bpe.encode_ordinary(text)
        return np.frombuffer(array("I", ids), np.uint32).astype("<u4", copy=False).tobytes()

    def encode(text: str) -> bytes:
        return whole(text.encode("utf-8", "replace").decode("utf-8"))

    return encode


def _byte_letters() -> dict[int, str]:
    """The printable letters that stand for bytes in byte-level BPE files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def pack_documents(df: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece (schema ``PIECES``): which tokens of which document lie where in which sequence.

    ``tokenizer``: path of a byte-level BPE file, readable on the executors. ``end_id`` is
    appended to every document. ``cost`` is the piece's estimated cost.
    """
    schema = pa.schema([(n, pa.float64() if n == "cost" else pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost")])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = byte_bpe(tokenizer), end_id.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40

        def rows(docs: list) -> Iterator[tuple]:
            nonlocal sequence
            lengths = [len(ids) // 4 for _, ids in docs]
            for d, start, n, s, at, cost in pack(lengths, max_len, linear, quadratic):
                doc_id, ids = docs[d]
                yield doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), lengths[d], sequence + s, at, cost
            sequence += len(capacities(sum(lengths), max_len))

        def pieces() -> Iterator[tuple]:
            docs, tokens = [], 0
            for batch in source:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    docs.append((doc_id, encode(text) + end))
                    tokens += len(docs[-1][1]) // 4
                    if tokens >= block_tokens:
                        yield from rows(docs)
                        docs, tokens = [], 0
            yield from rows(docs)

        yield from batches(pieces(), schema)

    return df.select(F.col("doc_id").cast("long"), text_of()).mapInArrow(run, PIECES)


def op1_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
