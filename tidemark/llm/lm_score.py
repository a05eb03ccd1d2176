r"""Operator 10: log-probabilities of documents by a weighted backoff automaton.

Tokens are words (A-Z lower-cased, runs of non-space) and one end token per text.
Training texts are counted whole: every word, pair and triple of tokens that they hold is in
the model, however rare, so the model grows with the corpus. Words, pairs and the start are
states, known by their last tokens. A state's arc for a token that followed it carries the
smoothed log-probability, (count + MASS * p(token | shorter state)) / (visits + MASS); its failure
arc to the state one token shorter carries log(MASS / (visits + MASS)), what the arcs leave
over. At the root a token has its add-one probability, which unknown tokens have too, so all
tokens sum to one in every state. A text is traversed once from left to right; as a state is
given by the two tokens before, a text's states, arcs and failures are found for all its
tokens at once.

The automaton is never in one place. Texts are tokenised once and written in blocks of about
`BLOCK` tokens. A block asks for its distinct n-grams, by sorted 64-bit hashes, with how often
its training texts have them; the sorted hashes are cut into ranges (buckets), a bucket sums
up over the blocks and answers each with the totals, and the answers meet the block's texts
again. So hot words and copied texts are summed before the shuffle, every bucket holds
about `BUCKET` hashes at any size of the corpus, and nothing but two numbers comes to the
driver. What is shuffled is six to seven bytes for each n-gram that a block has; with more
blocks than hashes in a slice (beyond some 10^12 tokens) a row's overhead adds to that.

Defined cases: null text is empty and has just the end token; repeated rows are
scored and trained on once each; with no training text every token has probability
1; an empty table gives no rows; other columns are ignored; a very long text is a
block of its own, in memory linear in its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read, table, text_of

#: The end token; no word holds white space.
END = b"\n"
#: What a state's failure arc weighs, in visits, for words and for pairs.
MASS = (3000.0, 5.0)
#: Tokens of a block, and hashes of a bucket as blocks ask for them, about.
BLOCK, BUCKET = 3 << 19, 1 << 19
#: Stands for the place before a text.
START = np.uint64(0x9E3779B97F4A7C15)
ZSTD, UNZSTD = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def tokens(text: str | None) -> list[bytes]:
    return [*ascii_lower(text).split(), END]


class Places(dict):
    """Words by their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def planes(values: np.ndarray) -> bytes:
    """Integers byte by byte of their places, each place compressed where that makes it shorter, after the number of integers and the parts' lengths."""
    parts = [x.tobytes() for x in values.view(np.uint8).reshape(len(values), values.itemsize).T]
    parts = [min(x, ZSTD.compress(x), key=len) for x in parts]
    return b"".join([np.array([len(values), *map(len, parts)], np.uint32).tobytes(), *parts])


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    count, *lengths = np.frombuffer(data, np.uint32, size + 1).tolist()
    out, at = np.empty((count, size), np.uint8), 4 * (size + 1)
    for i, n in enumerate(lengths):
        part = data[at : at + n]
        out[:, i] = np.frombuffer(part if n == count else UNZSTD.decompress(part), np.uint8)
        at += n
    return out.reshape(-1).view(kind)


def packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as their differences."""
    return planes(np.diff(hashes, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes; their first byte says in how many."""
    out = counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))
    return bytes([out.itemsize]) + planes(out)


def from_narrow(data: bytes) -> np.ndarray:
    return from_planes(data[1:], {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[data[0]]).astype(np.int64)


def tokenised(rows: DataFrame, most: int = BLOCK) -> DataFrame:
    """Blocks of texts with ``most`` tokens or one text more, as a written table. ``rows``: doc_id, text, trains, scored.

    ``words`` are the hashes of a block's distinct tokens, ``ids`` each token's place among them.
    """
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("trains", pa.list_(pa.bool_())), ("scored", pa.list_(pa.bool_())), ("words", pa.binary()), ("ids", pa.binary()), ("train_tokens", pa.int64()), ("train_texts", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        places, held, ids, size = Places(), [], [], 0

        def done() -> pa.RecordBatch:
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in places), np.uint64, len(places))
            doc_ids, lengths, trains, scored = (list(c) for c in zip(*held, strict=True))
            learned = [n for n, t in zip(lengths, trains, strict=True) if t]
            row = (block, doc_ids, lengths, trains, scored, planes(words), planes(np.concatenate(ids)), sum(learned), len(learned))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in source:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                doc_id, text, trains, scored = (c[i].as_py() for c in columns)
                parts = tokens(text)
                ids.append(np.fromiter(map(places.__getitem__, parts), np.uint32, len(parts)))
                held.append((doc_id, len(parts), trains, scored))
                size += len(parts)
                if size >= most:
                    yield done()
                    block += 1
                    places, held, ids, size = Places(), [], [], 0
        if held:
            yield done()

    ddl = "block long, doc_ids array<long>, lengths array<long>, trains array<boolean>, scored array<boolean>, words binary, ids binary, train_tokens long, train_texts long"
    return table(rows.select("doc_id", "text", "trains", "scored").mapInArrow(run, ddl))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """The tokens of a block and the hashes of the n-grams that end at each."""

    def __init__(self, words: bytes, ids: bytes, lengths: list[int]):
        self.words, self.ids, self.lengths = from_planes(words, np.uint64), from_planes(ids, np.uint32), np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.first = np.zeros(len(self.ids), bool)
        self.first[self.starts] = True
        h = self.words[self.ids]
        with np.errstate(over="ignore"):
            before = np.append(START, h[:-1])
            before[self.first] = START
            self.pairs = mixed(before * np.uint64(0xD6E8FEB86659FD93) + h)
            # the pair before a token and the token; a text's first token has no such pair
            self.triples = mixed(np.append(START, self.pairs[:-1]) * np.uint64(0xA0761D6478BD642F) + h)

    def asked(self, trains: list[bool]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each length: sorted distinct hashes, and how often training texts have them."""
        learned = np.repeat(np.array(trains, bool), self.lengths)
        times = np.bincount(self.ids, learned, len(self.words)).astype(np.int64)
        order = np.argsort(self.words)
        out = [(self.words[order], times[order])]
        for hashes, on in ((self.pairs, learned), (self.triples[~self.first], learned[~self.first])):
            # sorted with the training mark in the lowest bit, which sorts faster than by places
            marked = np.sort((hashes & ~np.uint64(1)) | on)
            keys = marked & ~np.uint64(1)
            begins = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
            sums = np.append(0, np.cumsum(marked & np.uint64(1), dtype=np.int64))
            out.append((keys[begins], np.diff(sums[np.append(begins, len(keys))])))
        return out

    def logs(self, totals: list[np.ndarray], total: int, kinds: int, texts: int, mass: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: its count in training, its log at the root, and its log by the walk. ``totals``: training counts of what `asked` gave."""
        ranks = np.empty(len(self.words), np.int64)
        ranks[np.argsort(self.words)] = np.arange(len(self.words))
        ones = totals[0][ranks][self.ids]
        twos = totals[1][np.unique(self.pairs & ~np.uint64(1), return_inverse=True)[1]]
        threes = np.zeros(len(ones), np.int64)
        threes[~self.first] = totals[2][np.unique(self.triples[~self.first] & ~np.uint64(1), return_inverse=True)[1]]
        visits = np.append(texts, ones[:-1])
        visits[self.first] = texts
        root = (ones + 1) / (total + kinds + 1)
        log_root = np.log10(root)
        # every token that follows a word or a pair is counted, so visits are the counts of the state's own n-gram
        p2, log2 = _walked(twos, visits, mass[0], root, log_root)
        visits = np.append(0, twos[:-1])
        visits[self.first] = 0
        return ones, log_root, _walked(threes, visits, mass[1], p2, log2)[1]


def _walked(times: np.ndarray, visits: np.ndarray, mass: float, shorter: np.ndarray, log_shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and logs in states of ``visits``: the arc where it is there, else the failure and what the shorter state gives."""
    arc = times > 0
    p = np.where(arc, times + mass * shorter, mass * shorter) / (visits + mass)
    return p, np.where(arc, np.log10(p), np.log10(mass / (visits + mass)) + log_shorter)


def ask(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, hashes, times): each block's distinct n-grams, cut at equal ranges of hashes; lengths have buckets of their own."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("times", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                block, lengths, trains, words, ids = (batch.column(c)[i].as_py() for c in range(5))
                for k, (hashes, times) in enumerate(Block(words, ids, lengths).asked(trains)):
                    cuts = [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]
                    used = [(b, s, e) for b, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)) if e > s]
                    columns = ([k * buckets + b for b, _, _ in used], [block] * len(used), [packed(hashes[s:e]) for _, s, e in used], [narrow(times[s:e]) for _, s, e in used])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return blocks.select("block", "lengths", "trains", "words", "ids").mapInArrow(run, "bucket int, block long, hashes binary, times binary")


def answers(asked: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, totals, kinds), as a written table: each block's slices with their sums over all blocks; ``kinds`` counts a bucket's trained words, once."""

    def run(rows: pa.Table) -> pa.Table:
        hashes = [unpacked(x.as_py()) for x in rows["hashes"]]
        keys, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(inverse, np.concatenate([from_narrow(x.as_py()) for x in rows["times"]]), len(keys)).astype(np.int64)
        ends = np.cumsum([len(x) for x in hashes])
        totals = [narrow(sums[part]) for part in np.split(inverse, ends[:-1])]
        words = int((sums > 0).sum()) if rows["bucket"][0].as_py() < buckets else 0
        return pa.table({"block": rows["block"], "bucket": rows["bucket"], "totals": pa.array(totals, pa.binary()), "kinds": pa.array([words] + [0] * (len(totals) - 1), pa.int64())})

    return table(asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, totals binary, kinds long"))


def score_rows(rows: DataFrame, mass: tuple[float, float] = MASS) -> DataFrame:
    """`score_documents` over one table of doc_id, text, trains (the text is learned from) and scored (it is in the result)."""
    blocks = tokenised(rows)
    # blocks ask for 1.5 n-grams a token, about
    size, total, texts = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum("train_tokens"), F.sum("train_texts")).first()
    size, total, texts = size or 0, total or 0, texts or 0
    buckets = 1 + 3 * size // (2 * BUCKET)
    answered = answers(ask(blocks, buckets), buckets)
    kinds = answered.agg(F.sum("kinds")).first()[0] or 0
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def walk(texts_: pa.Table, totals: pa.Table) -> pa.Table:
        doc_ids, lengths, scored, words, ids = (texts_[c][0].as_py() for c in ("doc_ids", "lengths", "scored", "words", "ids"))
        slices: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        for bucket, data in sorted(zip(totals["bucket"].to_pylist(), totals["totals"].to_pylist(), strict=True)):
            slices[bucket // buckets].append(from_narrow(data))
        block = Block(words, ids, lengths)
        times, root, logs = block.logs([np.concatenate(s) for s in slices], total, kinds, texts, mass)
        sums = [np.add.reduceat(x, block.starts) for x in ((times > 0).astype(np.int64), root, logs)]
        return pa.table([pa.array(doc_ids, pa.int64()), pa.array(lengths, pa.int64()), *map(pa.array, sums)], schema=schema).filter(pa.array(scored))

    met = blocks.select("block", "doc_ids", "lengths", "scored", "words", "ids").groupBy("block").cogroup(answered.groupBy("block"))
    out = met.applyInArrow(walk, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _rows(docs: DataFrame, trains: Column, scored: bool) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"), F.lit(scored).alias("scored"))


def score_documents(docs: DataFrame, training: DataFrame, mass: tuple[float, float] = MASS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` by a model of ``training``."""
    return score_rows(_rows(docs, F.lit(False), True).union(_rows(training, F.lit(True), False)), mass)


def op10_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scored = score_rows(_rows(read(spark, sf_dir, "documents"), ~held_out, True))
    return scored.withColumn("held_out", held_out)
