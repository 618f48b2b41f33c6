"""SimHash near-dedup: a self-join of the binary trie of fingerprints, then components.

A fingerprint bit is 1 if it is set in over half the XXH64 hashes of a text's word shingles. Two
fingerprints link if at most ``bits`` of their 64 bits differ. Only distinct fingerprints meet:

1. Cut into bits + 1 blocks, linked fingerprints agree in one block. For each block, those that
   agree there share a trie of their other bits.
2. Node pairs of a trie are walked down together, level by level, with the number of differing
   bits so far; a pair over the budget is dropped with all below it.
3. Each trie returns a spanning star for each of its components, not all links, and alternating
   large-star and small-star rounds join these to components over all blocks.

A block's trie that holds more than ``trie_rows`` fingerprints is cut into blocks, whose pairs
are joined as groups of their own, so that no task holds a hot trie.

Module neardup builds on this for similarity rather than a count of bits.

Null and wordless texts have fingerprint 0, which links like any other. A null doc_id never
becomes a component's id unless all of its documents have none. Repeated rows are one fingerprint
and come out once each; empty tables give none; a text is taken whole, whatever its length. Other
columns than ``keep`` play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, text_slices

SEED = 42


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every run of so many lower-cased words; of all words if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    begins = [0, *ends[: len(words) - k].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : e - 1], SEED) for a, e in zip(begins, ends[k - 1 :].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, name: str = "fp") -> DataFrame:
    """docs' other columns and the fingerprint as a (signed) long; text is dropped. Map-only."""
    rest = [f for f in docs.schema if f.name != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.uint64)
            for first, end, data, offsets in text_slices(b.column(b.num_columns - 1)):
                raw = data.tobytes()
                for k in range(end - first):
                    out[first + k] = fingerprint(raw[offsets[k] : offsets[k + 1]], shingle)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out.view(np.int64))], names=[*b.schema.names[:-1], name])

    return docs.select(*[f.name for f in rest], "text").mapInArrow(run, f"{kinds}, {name} long")


class Labels:
    """The smallest index known to be linked with each index."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            if not np.any(low != high):
                return
            np.minimum.at(self.of, high, low)
            while np.any((up := self.of[self.of]) != self.of):
                self.of = up


def trie_join(group: np.ndarray, side: np.ndarray, prints: np.ndarray, bits: int, block: int = 1 << 18, levels: int = 64, near=None) -> np.ndarray:
    """For each row, the first row of its component among links within its group.

    Rows are sorted by (group, side, print). Those of side 0 link with each other, those of side
    1 with those of side 2 only. Only the first ``levels`` bits are compared; near(a, b) tells
    which pairs of rows that they let through do link (all, if not given).
    """
    n = len(prints)
    labels = Labels(n)
    if n < 2:
        return labels.of
    ones = np.zeros((65, n + 1), np.int32)
    for d in range(64):
        ones[d, 1:] = np.cumsum(prints >> np.uint64(63 - d) & np.uint64(1))
    new_group = np.r_[True, group[1:] != group[:-1]]
    new_side = new_group | np.r_[True, side[1:] != side[:-1]]
    first_side = np.flatnonzero(new_side)
    last_side = np.r_[first_side[1:], n]
    starts_group = new_group[first_side]
    two = starts_group & np.r_[~starts_group[1:], False]
    one = (side[first_side] == 0) & (last_side - first_side > 1)
    at = np.flatnonzero(two)
    lo1, hi1 = np.r_[first_side[one], first_side[at]], np.r_[last_side[one], last_side[at]]
    lo2, hi2 = np.r_[first_side[one], first_side[at + 1]] if len(at) else first_side[one], np.r_[last_side[one], last_side[at + 1]] if len(at) else last_side[one]
    stack = [(0, np.column_stack([lo1, hi1, lo2, hi2, np.zeros(len(lo1), np.int64)]).astype(np.int32))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > block:
            stack += [(depth, p) for p in np.array_split(pairs, -(-len(pairs) // block))]
            continue
        lo1, hi1, lo2, hi2, diff = pairs.T
        leaf = (hi1 - lo1 == 1) & (hi2 - lo2 == 1) & (lo1 != lo2)
        if leaf.any():
            a, b = lo1[leaf], lo2[leaf]
            ok = np.bitwise_count((prints[a] ^ prints[b]) >> np.uint64(64 - levels)) <= bits
            labels.add(*_kept(a[ok], b[ok], labels, near))
        pairs = pairs[~leaf & ((lo1 != lo2) | (hi1 - lo1 > 1))]
        if depth == levels:  # several rows that agree in all bits compared
            for lo1, hi1, lo2, hi2 in pairs[:, :4].tolist():
                both = np.r_[lo1:hi1, lo2:hi2]
                labels.add(*_kept(np.full(len(both), lo1), both, labels, near))
                rest = np.flatnonzero(labels.of[lo1:hi1] != labels.of[lo1]) + lo1  # the others are linked by their first
                other = np.flatnonzero(labels.of[lo2:hi2] != labels.of[lo1]) + lo2
                for x, span in [*((i, np.arange(lo2, hi2)) for i in rest), *((j, np.arange(lo1, hi1)) for j in other)]:
                    labels.add(*_kept(np.full(len(span), x), span, labels, near))
            continue
        if not len(pairs):
            continue
        lo1, hi1, lo2, hi2, diff = pairs.T
        mid1 = hi1 - (ones[depth, hi1] - ones[depth, lo1])
        mid2 = hi2 - (ones[depth, hi2] - ones[depth, lo2])
        own = lo1 == lo2
        nxt = [
            np.column_stack([lo1, mid1, lo2, mid2, diff]), np.column_stack([mid1, hi1, mid2, hi2, diff]),
            np.column_stack([lo1, mid1, mid2, hi2, diff + 1]), np.column_stack([mid1, hi1, lo2, mid2, diff + 1])[~own],
        ]
        pairs = np.concatenate(nxt)
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= bits)]
        if len(pairs):
            stack.append((depth + 1, pairs))
    return labels.of


def _kept(a: np.ndarray, b: np.ndarray, labels: Labels, near) -> tuple[np.ndarray, np.ndarray]:
    if near is None or not len(a):
        return a, b
    new = labels.of[a] != labels.of[b]
    a, b = a[new], b[new]
    ok = near(a, b)
    return a[ok], b[ok]


def block_masks(bits: int) -> list[int]:
    """Masks of bits + 1 blocks that make up the 64 bits."""
    cuts = [round(64 * k / (bits + 1)) for k in range(bits + 2)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def split_hot(keyed: DataFrame, counts: DataFrame, rows: int, by: str) -> DataFrame:
    """keyed with side; groups of column g that have more than ``rows`` rows become pairs of blocks.

    counts: (g, n) of all groups. A hot group's rows are dealt to blocks by a hash of column ``by``, and every pair
    of blocks is a group of its own, with the rows of one as side 1 and of the other as side 2; so every
    pair of rows still meets once, whatever the size, and no task holds more than two blocks.
    """
    hot = checkpoint(counts.where(F.col("n") > rows).select("g", F.ceil(F.col("n") / rows).cast("int").alias("blocks")))
    if hot.isEmpty():
        return keyed.withColumn("side", F.lit(0))
    dealt = keyed.join(hot, "g", "left").withColumn("own", F.pmod(F.xxhash64(by, F.lit(5)), F.coalesce("blocks", F.lit(1))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    g = F.when(F.col("blocks").isNull(), F.col("g")).otherwise(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return dealt.withColumns({"g": g, "side": side}).drop("blocks", "own", "other")


def links(prints: DataFrame, bits: int = 2, trie_rows: int = 50_000) -> DataFrame:
    """(a, b): links that span the components within each trie, of the distinct fingerprints in column fp."""
    one = [F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for k, m in enumerate(block_masks(bits))]
    keyed = prints.select("fp", F.explode(F.array(*one)).alias("s")).select("fp", F.xxhash64("s.t", "s.k").alias("g"))
    grouped = split_hot(keyed, keyed.groupBy("g").agg(F.count(F.lit(1)).alias("n")), trie_rows, "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, side, p in whole_groups(((b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)) for b in batches), 200_000):
            order = np.lexsort((p, side, g))
            at = trie_join(g[order], side[order], p[order], bits)
            p = p[order]
            far = np.flatnonzero(p != p[at])
            yield pa.RecordBatch.from_arrays([pa.array(p[far].view(np.int64)), pa.array(p[at[far]].view(np.int64))], names=["a", "b"])

    dealt = grouped.select("g", F.col("side").cast("int"), "fp").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def whole_groups(parts: Iterable[tuple[np.ndarray, ...]], rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of sorted batches, joined up to runs of whole groups (of the first column) of about so many rows."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for part in parts:
        if not len(part[0]):
            continue
        new = size >= rows and part[0][-1] != held[-1][0][-1]
        cut = int(np.searchsorted(part[0], held[-1][0][-1], "right")) if new else 0
        if new:
            held.append(tuple(x[:cut] for x in part))
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
        held.append(tuple(x[cut:] for x in part))
        size += len(part[0]) - cut
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node of the (a, b) edges with the smallest node of its component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) until nothing changes.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        own = both.join(least, "a")
        if large:
            return own.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        moved = own.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        return moved.where("a != b").distinct()

    current = checkpoint(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    before = state(current)
    for _ in range(max_rounds):
        if not before[0]:
            break
        current = checkpoint(star(star(current, True), False))
        now = state(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def cluster(docs: DataFrame, shingle: int = 3, bits: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, fp, root (the component's smallest fingerprint) and component_id (its smallest doc_id)."""
    named = checkpoint(fingerprints(docs.select(*keep, "text"), shingle))
    return named.join(resolve(named, F.min("doc_id"), bits).withColumnRenamed("least", "component_id"), "fp")


def resolve(named: DataFrame, least: Column, bits: int) -> DataFrame:
    """(fp, root, least): each distinct fingerprint with its component and the aggregate over all of that."""
    nodes = checkpoint(named.groupBy("fp").agg(least.alias("rep")))
    linked = components(links(nodes.select("fp"), bits))
    ids = linked.join(nodes, linked["node"] == nodes["fp"]).groupBy("root").agg(F.min("rep").alias("over"))
    resolved = nodes.join(linked, nodes["fp"] == linked["node"], "left").join(ids, "root", "left")
    return resolved.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("over")).alias("least"))
