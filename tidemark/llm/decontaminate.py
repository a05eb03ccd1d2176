r"""Operator 8: benchmark passages in documents by spaced-seed hashing.

A seed is a mask over a window of tokens; masked-out places may hold any token, so a
substitution there doesn't break the hit. Every benchmark item's windows are hashed
under every mask of `SEEDS`, and every document's windows are looked up. At identity 0.8 every
overlap of six tokens or more has a hit. A hit fixes a
diagonal, along which the texts are compared token by token, with substitutions, and the
longest stretch with ``identity`` is taken, wherever the hits lie in it; an overlap of ``min_tokens`` tokens (or of the whole item, if
shorter) contaminates the document.

Tokens are words in lower case without outer punctuation. Windows are hashed for a
whole document at once as sums of token hashes times a factor of their place.

The benchmark's index goes to the executors in blocks of items of a bounded size; each
block is one pass over the documents, and a usual benchmark is one block. Nothing
is shuffled.

Defined cases: null and empty texts are clean; an item without tokens matches
nothing; repeated rows are judged alike; an empty benchmark leaves all documents clean;
an empty table gives no rows; other columns pass ``clean_documents`` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, read, text_of

#: 1: the token counts. Every place is masked out in one of them, so any one substitution in twelve tokens leaves a hit; the last takes runs of up to four.
MASKS = ("011011011011", "101101101101", "110110110110", "111111110000")
#: What is looked up: with a fifth of the tokens substituted at any places, one of these fits into six tokens or more.
SEEDS = ("1111", "11011")
MIN_TOKENS = 13
IDENTITY = 0.8
#: Tokens of the benchmark in a block; an index entry is about 30 bytes for each mask.
BLOCK_TOKENS = 400_000
CACHE_WORDS = 300_000
#: Tokens before and after a hit among which an overlap's equal ones are counted first, and hits of a text that are looked at in one go.
REACH = 2 * MIN_TOKENS
HITS = 20_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


class Hashes(dict):
    """Token hashes of words, 0 for a word of punctuation only."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        w = _EDGES.sub("", word.lower())
        self[word] = h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) | 1 if w else 0
        return h


def token_hashes(text: str | None, known: Hashes) -> np.ndarray:
    words = (text or "").split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return h[h != 0]


def window_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    n = len(tokens) - len(mask) + 1
    out = np.zeros(max(0, n), np.uint64)
    if n > 0:
        with np.errstate(over="ignore"):
            for i, on in enumerate(mask):
                if on == "1":
                    out += tokens[i : i + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3)) & (2**64 - 1) | 1)
            out ^= out >> np.uint64(31)
    return out


def masks_for(length: int) -> tuple[str, ...]:
    """The masks of items with ``length`` tokens; items under six are hashed whole."""
    return SEEDS if length >= 6 else ("1" * length,)


class Index:
    """Hashes of all items' windows, sorted, by mask, with a bit table in front."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = [(i, t) for i, t in items if len(t)]
        # the items' tokens in a row, with room between them that equals no token
        gap = np.zeros(REACH + 5, np.uint64)
        self.flat = np.concatenate([gap, *(x for _, t in self.items for x in (t, gap))])
        self.starts = np.cumsum([len(gap), *(len(t) + len(gap) for _, t in self.items)])
        self.lengths = np.array([len(t) for _, t in self.items], np.int64)
        entries: dict[str, list[tuple[np.ndarray, int]]] = {}
        for k, (_, tokens) in enumerate(self.items):
            for mask in masks_for(len(tokens)):
                entries.setdefault(mask, []).append((window_hashes(tokens, mask), k))
        self.masks = {}
        for mask, own in entries.items():
            h = np.concatenate([x for x, _ in own])
            item = np.concatenate([np.full(len(x), k, np.int32) for x, k in own])
            place = np.concatenate([np.arange(len(x), dtype=np.int32) for x, _ in own])
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[h & np.uint64((1 << 22) - 1)] = True
            self.masks[mask] = h[order], item[order], place[order], bits

    def overlaps(self, tokens: np.ndarray, min_tokens: int, identity: float) -> list[tuple[int, int, int, int]]:
        """(item, start, tokens, equal tokens) of the longest overlap with each item that has one."""
        best: dict[int, tuple[int, int, int]] = {}
        gap = np.full(REACH + 5, 2, np.uint64)
        padded = np.concatenate([gap, tokens, gap])
        diagonals: set[tuple[int, int]] = set()
        for mask, (h, item, place, bits) in self.masks.items():
            windows = window_hashes(tokens, mask)
            maybe = np.flatnonzero(bits[windows & np.uint64((1 << 22) - 1)])
            if not len(maybe):
                continue
            lo, hi = np.searchsorted(h, windows[maybe], "left"), np.searchsorted(h, windows[maybe], "right")
            ends = np.cumsum(hi - lo)
            for first in range(0, int(ends[-1]), HITS):
                of = np.arange(first, min(first + HITS, int(ends[-1])))
                row = np.searchsorted(ends, of, "right")
                entry = hi[row] - (ends[row] - of)
                k, at, p = item[entry].astype(np.int64), maybe[row], place[entry].astype(np.int64)
                # some stretch of under 2 * min_tokens around one of its hits has the identity, if a longer one has
                reach = np.arange(-REACH, REACH + 5) if min_tokens <= MIN_TOKENS else np.arange(5)
                near = (padded[(at + len(gap))[:, None] + reach] == self.flat[(self.starts[k] + p)[:, None] + reach]).sum(axis=1)
                enough = near >= np.ceil(identity * np.minimum(min_tokens, self.lengths[k]) - 1e-9) if min_tokens <= MIN_TOKENS else near > 0
                diagonals.update(zip(k[enough].tolist(), (at - p)[enough].tolist(), strict=True))
        for k, shift in sorted(diagonals):
            whole, start, n, same = self._longest(tokens, self.items[k][1], shift, identity)
            if whole >= min(min_tokens, len(self.items[k][1])) and n > best.get(k, (0, 0, 0))[1]:
                best[k] = start, n, same
        return [(self.items[k][0], *x) for k, x in sorted(best.items())]

    @staticmethod
    def _longest(tokens: np.ndarray, item: np.ndarray, shift: int, identity: float) -> tuple[int, int, int, int]:
        """Tokens of the longest stretch of the diagonal with ``identity``; and of it from the first equal token to the last: start, tokens, equal tokens."""
        lo, hi = max(0, shift), min(len(tokens), shift + len(item))
        same = tokens[lo:hi] == item[lo - shift : hi - shift]
        sums = np.concatenate([[0.0], np.cumsum(same - identity)])
        # of each end the first start from which the sum doesn't fall
        left = np.searchsorted(-np.minimum.accumulate(sums), -sums - 1e-9)
        right = int(np.argmax(np.arange(len(sums)) - left))
        inside = np.flatnonzero(same[left[right] : right]) + int(left[right])
        return (right - int(left[right]), lo + int(inside[0]), int(inside[-1] - inside[0]) + 1, len(inside)) if len(inside) else (0, lo, 0, 0)


def indexes(benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> Iterator[Index]:
    """Indexes of the benchmark's items, in blocks of about ``block_tokens`` tokens; items stream to the driver."""
    known, block, size = Hashes(), [], 0
    for row in benchmark.select("item_id", text_of().alias("text")).toLocalIterator():
        block.append((row["item_id"], token_hashes(row["text"], known)))
        size += len(block[-1][1])
        if size >= block_tokens:
            yield Index(block)
            block, size = [], 0
    if block:
        yield Index(block)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, identity: float = IDENTITY) -> DataFrame:
    """(doc_id, item_id, start, n_tokens, n_equal): each document's longest overlap with each item it has one with, places in tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("n_equal", pa.int64())])
    ddl = "doc_id long, item_id long, start long, n_tokens long, n_equal long"
    rows = docs.select(F.col("doc_id").cast("long"), text_of())
    out = None
    for index in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(source: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = Hashes()

            def found() -> Iterator[tuple]:
                for batch in source:
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        for x in sent.value.overlaps(token_hashes(text, known), min_tokens, identity):
                            yield doc_id, *x

            yield from batches(found(), schema)

        part = rows.mapInArrow(run, ddl)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], ddl)


def clean_documents(docs: DataFrame, benchmark: DataFrame, min_tokens: int = MIN_TOKENS, identity: float = IDENTITY) -> DataFrame:
    """``docs`` without the contaminated rows, one pass for each block of the benchmark."""
    at = docs.columns.index("text")
    for index in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(source: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = Hashes()
            for batch in source:
                clean = [not sent.value.overlaps(token_hashes(t, known), min_tokens, identity) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
