r"""Operator 9: SimHash near-duplicates by a self-join of binary tries.

A document's words (A-Z lower-cased, runs of non-space) form shingles; each bit of the
fingerprint is 1 if it is set in over half of the shingles' hashes. Fingerprints are
linked when few bits differ.

The self-join walks a trie of the fingerprints with pairs of nodes: a pair starts at
the root, adds the bits by which the two branches differ, and is dropped as soon as it
exceeds the budget. Tries are distributed by pigeonhole: of three parts of the bits,
one is equal in any pair within a budget of two, and again one of three of the rest, so
each fingerprint goes to nine groups that share about 36 bits, and a group is one
subtree. Groups hold distinct fingerprints only. A task turns the links of a
subtree into a spanning forest at once, so what is sent on has fewer rows than came
in; no link between different fingerprints is lost to the components.

`near_duplicates` is the general form, for a similarity (Jaccard) over sets of shingles:
256-bit fingerprints, candidates when their bits differ in at most
`max_differing(similarity)`. That budget is too wide for one trie, so a number of tables
each project the fingerprint on a few bits drawn at random, the tries of the projections
are joined with a budget of two, and a pair met there is held against its whole
fingerprints. The number of bits grows with the logarithm of the documents, and the
number of tables follows, so that a pair at the similarity meets in some table but for one in
a thousand. Texts of so few shingles that similar ones differ in a single shingle (up to eight at 0.8) are
candidates by the hashes of their sets as well, since their fingerprints say little.
Candidates are checked exactly, by their sets of shingles. Of each group of candidates goes on a
spanning forest in which every text has its first partner. Where one of these pairs fails, it may have kept out a pair that
would have passed, so the texts of the components that it stands between are joined once more, exactly, by their rarest
shingles (`rare_pairs`); groups of copies that are all in one component cost nothing more, and pairs are never
listed for being in one group.

Groups larger than `GROUP` rows are dealt out again as pairs of salted parts, each
part against each, so no task holds an unbounded group and no pair is skipped.

Defined cases: null and empty texts have fingerprint zero and are linked like any
other; fewer words than a shingle has make one shingle of them all; equal texts share
a fingerprint; rows that repeat a doc_id are one node; a null doc_id is in no component; an empty table gives no rows;
other columns pass `keep_one_of_each` unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read, record_batch, small, table, text_of
from .components import components

#: Fingerprints that one task joins in one group at most; larger groups are dealt out as pairs of parts.
GROUP = 50_000
#: A trie node with at most this many fingerprints is compared directly.
LEAF = 48
WIDE = 4
#: Shingles in one Arrow batch, but for a longer text.
SET_ROWS = 200_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle, repeats included."""
    parts = ascii_lower(text).split()
    joined, n = b" ".join(parts), len(parts)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)] if n else [], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=False)), np.uint64, n - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """256 bits over the set of hashes: four mixtures of them."""
    out, hashes = [], np.unique(hashes)
    with np.errstate(over="ignore"):
        for i in range(WIDE):
            x = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
            out.append(fingerprint(x ^ (x >> np.uint64(29))).to_bytes(8, "big"))
    return b"".join(out)


def set_keys(hashes: np.ndarray, few: int) -> tuple[int | None, list[int]]:
    """A key of the set of hashes and the keys of it without one of them, if it has one to ``few``."""
    h = np.unique(hashes)
    if not 0 < len(h) <= few:
        return None, []
    with np.errstate(over="ignore"):
        terms = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        whole = terms.sum(dtype=np.uint64)
        return int(whole.view(np.int64)), (whole - terms).view(np.int64).tolist() if len(h) > 1 else []


class Forest:
    """Union-find over places 0 to n - 1; ``edges`` are the links that joined two trees."""

    def __init__(self, n: int):
        self.up, self.edges = list(range(n)), []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, i: int, j: int) -> None:
        x, y = self.root(i), self.root(j)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((min(i, j), max(i, j)))

    def link_all(self, x: np.ndarray, y: np.ndarray) -> None:
        """Links of pairs; those within a tree are dropped together, so dense groups cost a step for each tree, not for each link."""
        while len(x):
            places = np.unique(np.concatenate([x, y]))
            roots = np.array([self.root(i) for i in places.tolist()])
            of = roots[np.searchsorted(places, x)], roots[np.searchsorted(places, y)]
            apart = of[0] != of[1]
            x, y, rx = x[apart], y[apart], np.maximum(of[0], of[1])[apart]
            _, first = np.unique(rx, return_index=True)
            for i, j in zip(x[first].tolist(), y[first].tolist(), strict=True):
                self.link(i, j)


def trie_pairs(keys: np.ndarray, bits: int, budget: int, whole: np.ndarray | None = None, limit: int = 0, sides: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """The links among sorted ``keys`` (uint64) in blocks: places, places, and how many bits of ``whole`` differ.

    Linked: at most ``budget`` of the low ``bits`` bits differ and, if ``whole`` (n x m uint64) is
    given, at most ``limit`` of its bits. With ``sides`` (booleans) only pairs across the sides
    count.
    """

    def leaf(a: slice, b: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        near = np.bitwise_count(keys[a, None] ^ keys[None, b]) <= budget
        if a == b:
            near = np.triu(near, 1)
        if sides is not None:
            near &= sides[a, None] != sides[None, b]
        x, y = np.nonzero(near)
        x, y = x + a.start, y + b.start
        if whole is None or not len(x):
            return x, y, None
        differ = np.bitwise_count(whole[x] ^ whole[y]).sum(axis=1, dtype=np.int64)
        close = differ <= limit
        return x[close], y[close], differ[close]

    def halves(lo: int, hi: int, bit: int) -> list[tuple[int, int]]:
        mid = lo + int(np.searchsorted((keys[lo:hi] >> np.uint64(bit)) & np.uint64(1), 1))
        return [(lo, mid), (mid, hi)]

    # node pairs (first, second, next bit, bits that differ so far)
    stack = [((0, len(keys)), (0, len(keys)), bits - 1, 0)]
    while stack:
        a, b, bit, differ = stack.pop()
        if a[0] == a[1] or b[0] == b[1] or (a == b and a[1] - a[0] == 1 and bit < 0):
            continue
        if bit < 0 or max(a[1] - a[0], b[1] - b[0]) <= LEAF:
            for s in range(a[0], a[1], 1024):  # many equal keys
                for t in range(s if a == b else b[0], b[1], 1024):
                    found = leaf(slice(s, min(s + 1024, a[1])), slice(t, min(t + 1024, b[1])))
                    if len(found[0]):
                        yield found
            continue
        left, right = halves(*a, bit), halves(*b, bit)
        for i in (0, 1):
            for j in (0, 1):
                if differ + (i != j) <= budget and not (a == b and i > j):
                    stack.append((left[i], right[j], bit - 1, differ + (i != j)))


def trie_links(keys: np.ndarray, bits: int, budget: int, whole: np.ndarray | None = None, limit: int = 0, sides: np.ndarray | None = None, names: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of places, of the links of `trie_pairs`.

    With ``names``, unlike numbers, each key is first paired with its partner of the smallest name, and what is needed to span is
    added. So groups that share keys name the same pairs, and all of them together name few.
    """
    forest = Forest(len(keys))
    order = np.argsort(names) if names is not None else None
    rank = np.argsort(order) if names is not None else None
    partner = np.full(len(keys), len(keys))
    for x, y, _ in trie_pairs(keys, bits, budget, whole, limit, sides):
        if rank is not None:
            np.minimum.at(partner, x, rank[y])
            np.minimum.at(partner, y, rank[x])
        forest.link_all(x, y)
    if names is None:
        return forest.edges
    paired, own = Forest(len(keys)), np.flatnonzero(partner < len(keys))
    first = [(min(e), max(e)) for e in zip(own.tolist(), order[partner[own]].tolist(), strict=True)]
    for e in [*first, *forest.edges]:
        paired.link(*e)
    return sorted({*first, *paired.edges})


def group_links(bits: int, budget: int, limit: int = 0):
    """A mapInArrow function: rows (key, lo, hi, part, node, proj[, whole]) sorted by the first three -> edges (a, b), a spanning forest of each group's links."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined(table_: pa.Table) -> Iterator[pa.RecordBatch]:
            key, lo, hi, part, node, proj = (table_.column(i).to_numpy() for i in range(6))
            proj = proj.view(np.uint64)
            whole = np.frombuffer(b"".join(table_.column(6).to_pylist()), np.uint64).reshape(len(key), -1) if table_.num_columns > 6 else None
            cut = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            sizes = ends - starts
            pairs = starts[sizes == 2]
            near = np.bitwise_count(proj[pairs] ^ proj[pairs + 1]) <= budget
            near &= (lo[pairs] == hi[pairs]) | (part[pairs] != part[pairs + 1])
            if whole is not None:
                near &= np.bitwise_count(whole[pairs] ^ whole[pairs + 1]).sum(axis=1, dtype=np.int64) <= limit
            a, b = [node[pairs[near]]], [node[pairs[near] + 1]]
            for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
                order = s + np.argsort(proj[s:e], kind="stable")
                given = proj[order], bits, budget, None if whole is None else whole[order], limit, part[order] != lo[s] if lo[s] != hi[s] else None, None if whole is None else node[order]
                if found := trie_links(*given):
                    x, y = np.array(found).T
                    a.append(node[order[x]])
                    b.append(node[order[y]])
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

        rows = 0
        for batch in source:
            held.append(batch)
            rows += batch.num_rows
            if rows >= GROUP:  # all groups but the last one are complete
                whole_table = pa.Table.from_batches(held)
                last = [whole_table.column(i)[-1].as_py() for i in range(3)]
                tail = np.logical_and.reduce([whole_table.column(i).to_numpy() == last[i] for i in range(3)])
                at = int(np.argmax(tail))
                if at:
                    yield from joined(whole_table.slice(0, at).combine_chunks())
                held = whole_table.slice(at).combine_chunks().to_batches()
                rows = whole_table.num_rows - at
        if rows:
            yield from joined(pa.Table.from_batches(held).combine_chunks())

    return run


def linked(rows: DataFrame, bits: int, budget: int, limit: int = 0) -> DataFrame:
    """Edges (a, b) among ``rows`` (key, node, proj[, whole]): a spanning forest of each key's links."""
    counts = table(rows.groupBy("key").count().filter(F.col("count") > GROUP))
    rest = [c for c in rows.columns if c not in ("key",)]
    if counts.isEmpty():
        zero = F.lit(0)
        dealt = rows.select("key", zero.alias("lo"), zero.alias("hi"), zero.alias("part"), *rest)
    else:
        parts = F.coalesce(F.ceil(F.col("count") / F.lit(GROUP / 2)), F.lit(1)).cast("int")
        dealt = rows.join(small(counts, 16), "key", "left").withColumn("_n", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
        dealt = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("key", F.least("part", "_j").alias("lo"), F.greatest("part", "_j").alias("hi"), "part", *rest)
    order = ["key", "lo", "hi"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(group_links(bits, budget, limit), "a long, b long")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a long)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            fps = np.array([fingerprint(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of()).mapInArrow(run, "doc_id long, fp long")


def _bits(fp: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))


def trie_keys(fp: Column) -> Column:
    """The nine groups of a 64-bit fingerprint: one of three parts whole, and one of three parts of the rest."""
    keys, parts = [], [(0, 21), (21, 21), (42, 22)]
    for i, (at, n) in enumerate(parts):
        rest = [(p, m) for j, (p, m) in enumerate(parts) if j != i]
        # the rest, put together and cut in three
        (p, m), (q, k) = rest
        both = _bits(fp, p, m).bitwiseOR(F.shiftleft(_bits(fp, q, k), m))
        for j in range(3):
            step = (m + k + 2) // 3
            sub = _bits(both, j * step, min(step, m + k - j * step))
            keys.append(F.lit((3 * i + j) << 40).bitwiseOR(F.shiftleft(_bits(fp, at, n), 16)).bitwiseOR(sub))
    return F.array(*keys)


def simhash_components(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of at most ``budget`` (0 to 2) differing bits."""
    if not 0 <= budget <= 2:
        raise ValueError("three parts hold for a budget of two at most")
    fps = table(fingerprints(docs, words))
    nodes = table(fps.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")))
    rows = nodes.select(F.explode(trie_keys(F.col("fp"))).alias("key"), "node", F.col("fp").alias("proj"))
    found = components(linked(rows, 64, budget))
    known = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return fps.join(known, "fp", "left").select("doc_id", "fp", own)


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def max_differing(similarity: float, bits: int = 64 * WIDE) -> int:
    """Bits that differ in a pair of the similarity at most, but for one pair in a hundred.

    The angle between two texts' shingles gives the share of bits. With very few shingles, where majorities are often
    tied, it is up to a quarter more (five shingles and four of them at 0.8: 3 of 16 bits, where the angle gives 0.151);
    these are found by their `set_keys`.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + 2.33 * math.sqrt(bits * p * (1 - p)))


def tables_for(rows: int, similarity: float) -> tuple[int, int]:
    """(bits of a projection, tables) so that a pair of the similarity meets in a table but for one in a thousand."""
    bits = min(60, max(24, math.ceil(math.log2(max(2, rows))) + 6))
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    meets = sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(3))
    return bits, math.ceil(math.log(0.001) / math.log(1 - meets))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, s): each text's set of shingle hashes. ``texts``: node and text."""

    def sets(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("s", pa.list_(pa.int64()))])
        held, size = [], 0
        for batch in source:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((node, np.unique(shingle_hashes(text.as_py(), words)).view(np.int64)))
                size += len(held[-1][1])
                if size >= SET_ROWS:
                    yield record_batch(held, schema)
                    held, size = [], 0
        if held:
            yield record_batch(held, schema)

    return texts.select("node", "text").mapInArrow(sets, "node long, s array<long>")


def verified(edges: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The edges (a, b) whose texts' sets of shingles have the similarity. ``texts``: node and text, once each.

    Only the texts that edges name are hashed again; a text that many edges name is a
    hot key of a plain join, which adaptive execution splits.
    """
    named = table(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct())
    own = table(shingle_sets(texts.join(small(named, 16), "node", "left_semi"), words))
    met = edges.join(own.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    # texts without words are equal
    return met.filter(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)).select("a", "b")


def rare_pairs(open_: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes with different labels that can have the similarity, all that do among them. ``open_``: node and label.

    Two sets of the similarity have in common one of each one's rarest shingles, as many as it may lack and one more. What a
    group of copies shares is frequent in it, so copies that resemble each other just too little, which differ in their
    rarest shingles, meet nowhere; shingles of a single label are left out before rows meet.
    """
    sets = table(shingle_sets(texts.join(open_, "node", "left_semi"), words))
    each = sets.select("node", F.size("s").alias("n"), F.explode("s").alias("h"))
    counts = each.groupBy("h").agg(F.count("*").alias("c"))
    ranked = each.join(counts, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("r"))
    least = F.ceil(F.col("n") * F.lit(similarity) - 1e-9)
    rarest = ranked.select("node", "n", F.posexplode(F.slice("r", F.lit(1), (F.col("n") - least + 1).cast("int"))).alias("at", "x")).select("node", "n", "at", F.col("x.h").alias("h"), F.col("x.c").alias("c"))
    own = table(rarest.filter("c > 1").drop("c").join(open_, "node"))
    shared = own.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("h")
    own = own.join(shared, "h")
    x = own.select("h", *[F.col(c).alias(f"{c}_x") for c in ("node", "n", "at", "label")])
    y = own.select("h", *[F.col(c).alias(f"{c}_y") for c in ("node", "n", "at", "label")])
    needed = F.lit(similarity / (1 + similarity)) * (F.col("n_x") + F.col("n_y")) - 1e-9
    # no more than what follows in both orders can still be common
    possible = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) >= needed
    met = x.join(y, "h").filter((F.col("node_x") < F.col("node_y")) & (F.col("label_x") != F.col("label_y")) & possible)
    return met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def unjoined(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """(node, label) of the nodes in components (node, component) between which a candidate pair has failed, a written table.

    All others are in one component with everything that they are candidates with.
    """
    named = candidates.select(F.col("a").alias("node")).union(candidates.select(F.col("b").alias("node"))).distinct()
    labels = table(named.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("label")))
    ends = candidates.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").filter("x <> y")
    open_ = table(ends.select(F.explode(F.array("x", "y")).alias("label")).distinct())
    return table(labels.join(small(open_, 16), "label", "left_semi").select("node", "label"))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of the documents that are in a group of two or more and aren't its first."""
    limit = max_differing(similarity)

    few = math.ceil((1 + similarity) / (1 - similarity)) - 1 if similarity < 1 else 0

    def wide(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            hashes = [shingle_hashes(t, words) for t in batch.column(1).to_pylist()]
            keys = [set_keys(h, few) for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(wide_fingerprint, hashes), pa.binary()), pa.array([k for k, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.list_(pa.int64()))], ["doc_id", "whole", "own", "less"])

    known = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    fps = table(known.mapInArrow(wide, "doc_id long, whole binary, own long, less array<long>"))
    nodes = table(fps.groupBy("whole").agg(F.min(F.struct("doc_id", "own", "less")).alias("x")).select("whole", F.col("x.doc_id").alias("node"), "x.own", "x.less"))
    bits, tables = tables_for(nodes.count(), similarity)
    rng = np.random.default_rng(42)
    draws = [rng.choice(64 * WIDE, bits, replace=False) for _ in range(tables)]
    cuts = [bits * i // 3 for i in range(4)]

    def projected(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in (batch.slice(at, 2048) for at in range(0, batch.num_rows, 2048)):
                whole = part.column(1).to_pylist()
                flags = np.unpackbits(np.frombuffer(b"".join(whole), np.uint8).reshape(len(whole), -1), axis=1).astype(np.int64)
                for t, draw in enumerate(draws):
                    proj = flags[:, draw] @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                    for i in range(3):
                        value = proj >> cuts[i] & (1 << (cuts[i + 1] - cuts[i])) - 1
                        yield pa.RecordBatch.from_arrays([pa.array((3 * t + i) << 24 | value), part.column(0), pa.array(proj), *part.columns[1:]], ["key", "node", "proj", *part.schema.names[1:]])

    texts = known.withColumnRenamed("doc_id", "node")
    # texts of few shingles: one is the other without one of its shingles
    more_by_one = nodes.select(F.col("node").alias("x"), F.explode("less").alias("own")).join(nodes.filter("own IS NOT NULL").select(F.col("node").alias("y"), "own"), "own").filter("x <> y")
    rows = nodes.select("node", "whole").mapInArrow(projected, "key long, node long, proj long, whole binary")
    candidates = table(linked(rows, bits, 2, limit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(more_by_one.select(F.least("x", "y"), F.greatest("x", "y"))).distinct())
    edges = table(verified(candidates, texts, words, similarity))
    found = components(edges)
    left = unjoined(candidates, found)
    if not left.isEmpty():  # a candidate has failed: what its place has kept out is checked now
        more = table(rare_pairs(left, texts, words, similarity).join(candidates, ["a", "b"], "left_anti"))
        found = components(edges.union(verified(more, texts, words, similarity)))
    copies = fps.join(nodes, "whole").select("doc_id", "node")
    placed = copies.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    return placed.filter(F.col("doc_id") != F.col("component_id")).distinct()


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without near-duplicates: of each group the row with the smallest doc_id stays."""
    gone = table(near_duplicates(docs, words, similarity).select("doc_id"))
    return docs.join(small(gone, 16), "doc_id", "left_anti").select(docs.columns)
