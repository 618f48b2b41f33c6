"""Near copies by similarity: SimHash tries propose, exact sets of word runs decide.

Two texts are near copies if the Jaccard similarity of their sets of five-word runs is at least
0.8. A text with a group of near copies is found in three steps:

1. Eight fingerprints of the distinct runs make a 512-bit signature. Bands of 64 bits are drawn from
   it; signatures that agree in a band's first bits share a trie of the others, whose node
   pairs are walked down together within a budget of differing bits. What the tries let through
   is filtered by 64 more bits and by the numbers of runs; pairs that span each trie's components go on. A text sends its number and
   128 bits to each of its tries. How many bands there are, and how wide they are, follows from the similarity and the recall alone.
2. The components of these are families: of texts that may be near copies of each other. Families
   are cut into blocks of bounded size, and inside a block all sets are compared exactly.
3. In a family of several blocks, one member of each group so found is compared with those of the
   other groups, as in 2; then each member outside the family's largest group is compared with all
   members of other blocks. So no link between the members of a family is missed, and a family whose
   members are alike costs no more than in proportion to its size.

Groups are the components of exact links. Null and empty texts have no runs and are copies of each
other; repeated rows are copies; an empty table gives none; texts are taken whole. Other columns
pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import acos, ceil, comb, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, mix, text_slices
from .simhash import SEED, Labels, components, majority, shingle_hashes, split_hot, trie_join, whole_groups

#: 64-bit words of a signature.
WORDS = 8
#: Bounds of a block of a family: members, and word runs of all of them.
BLOCK_ROWS, BLOCK_RUNS = 1_000, 1_000_000


def signature(h: np.ndarray) -> list[int]:
    """Fingerprints of distinct hashes by different bits of them; last, how many hashes there are."""
    return [*(majority(mix(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))) for k in range(WORDS)), len(h)]


def flip_share(similarity: float) -> float:
    """The expected share of differing bits at a Jaccard similarity of two sets of like size."""
    return acos(2 * similarity / (1 + similarity)) / pi


def most_errors(similarity: float, bits: int, missed: float = 0.005) -> int:
    """The least budget of differing bits that so small a share of the pairs at the similarity exceeds."""
    flip, held, k = flip_share(similarity), 0.0, -1
    while held < 1 - missed:
        k += 1
        held += comb(bits, k) * flip**k * (1 - flip) ** (bits - k)
    return k


def near_prints(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, bits: int, similarity: float, grace: float = 3.0) -> np.ndarray:
    """Which pairs of prints (rows of 64-bit words, so many bits in use) may be of sets, of m and n runs, whose Jaccard similarity is that high; exact sets decide later.

    The numbers of runs bound it exactly (the smaller over the larger), and tell the angle of
    two such sets; the differing bits are let exceed what is expected there by ``grace`` standard deviations.
    Sets of under 32 runs, whose bits are no normal sample, may differ in 0.3 of the bits.
    """
    m, n = m.astype(float), n.astype(float)
    least, most = np.minimum(m, n), np.maximum(m, n)
    cosine = similarity * (m + n) / ((1 + similarity) * np.sqrt(np.maximum(m * n, 1)))
    share = np.arccos(np.clip(cosine, 0, 1)) / np.pi
    differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    limit = bits * share + grace * np.sqrt(bits * share * (1 - share))
    return (least / np.maximum(most, 1) >= similarity) & (differ <= np.where(least < 32, np.maximum(limit, 0.3 * bits), limit))


def proposals(nodes: DataFrame, similarity: float = 0.8, recall: float = 0.95, block: int = 20, trie_rows: int = 50_000) -> DataFrame:
    """(a, b), a < b: pairs of ids that span the components of what the tries propose. nodes: id and sig.

    Two that agree in the ``block`` first bits of a band, which one in a million of different texts do by chance, meet in
    its trie. So many bands are drawn that ``recall`` of the pairs at the similarity itself share one and keep the
    budget there; tries that are large all the same are cut (see split_hot).
    """
    errors = most_errors(similarity, 64 - block)
    hit = (1 - flip_share(similarity)) ** block * 0.99
    bands = ceil(log(1 - recall) / log(1 - hit))
    # a band's bits come from the words other than the one that goes along with them
    places = [np.random.default_rng(t).choice(np.setdiff1d(np.arange(64 * WORDS), np.arange(64) + t % WORDS * 64), 64, replace=False) for t in range(bands)]
    top = np.uint64(64 - block)

    def keyed(sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        raw = np.unpackbits(np.ascontiguousarray(sig[:, :WORDS]).astype(">u8", order="C").view(np.uint8), axis=1)
        for t, at in enumerate(places):
            value = np.ascontiguousarray(np.packbits(raw[:, at], axis=1)).view(">u8").ravel().astype(np.uint64)
            yield ((value >> top) + np.uint64(t << block)).view(np.int64), (value << np.uint64(block)).view(np.int64), sig[:, t % WORDS].view(np.int64)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _signatures(b.column(1))
            size = pa.array(np.minimum(sig[:, WORDS], np.uint64(2**31 - 1)).astype(np.int32))
            for g, value, more in keyed(sig):
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(value), pa.array(np.ascontiguousarray(more)), size, b.column(0)], names=["g", "value", "more", "size", "id"])

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, _, _ in keyed(_signatures(b.column(0))):
                names, n = np.unique(g, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], names=["g", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (tuple(c.to_numpy() for c in b.columns) for b in batches)
        for g, side, value, more, size, ids in whole_groups(parts, 100_000):
            value = value.view(np.uint64)
            order = np.lexsort((value, side, g))
            prints, size, ids = np.column_stack([value, more.view(np.uint64)])[order], size[order], ids[order]
            found: list[tuple[np.ndarray, np.ndarray]] = []

            def near(a: np.ndarray, b: np.ndarray, prints=prints, size=size, ids=ids, found=found) -> np.ndarray:
                ok = near_prints(prints[a], prints[b], size[a], size[b], 128 - block, similarity)
                x, y = ids[a[ok]], ids[b[ok]]
                found.append((np.minimum(x, y), np.maximum(x, y)))
                return ok

            trie_join(g[order], side[order], prints[:, 0], errors, levels=64 - block, near=near)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(*(np.concatenate(x) for x in zip(*found, strict=True)))], names=["a", "b"])

    counts = nodes.select("sig").mapInArrow(tally, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") > 1)
    own = nodes.select("id", "sig").mapInArrow(deal, "g long, value long, more long, size int, id long")
    grouped = split_hot(own, counts, trie_rows, "id")
    dealt = grouped.select("g", F.col("side").cast("int"), "value", "more", "size", "id").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _signatures(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, WORDS + 1).view(np.uint64)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end of the pairs, the smallest of its component, where that is another; so bands that find one family say much the same."""
    ids, ends = np.unique(np.r_[a, b], return_inverse=True)
    labels = Labels(len(ids))
    labels.add(ends[: len(a)], ends[len(a) :])
    root = ids[labels.of]
    return root[root != ids], ids[root != ids]


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of pairs that span the components of all of them, without cycles."""
    if not len(a):
        return np.zeros(0, np.int64)
    _, ends = np.unique(np.r_[a, b], return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    labels, chosen, open_ = Labels(int(ends.max()) + 1), [], np.arange(len(a))
    while True:
        open_ = open_[labels.of[x[open_]] != labels.of[y[open_]]]
        if not len(open_):
            return np.concatenate(chosen) if chosen else open_
        first = np.full(len(labels.of), len(a))
        np.minimum.at(first, labels.of[x[open_]], open_)
        np.minimum.at(first, labels.of[y[open_]], open_)
        new = np.unique(first[first < len(a)])
        chosen.append(new)
        labels.add(x[new], y[new])


def shared_runs(sizes: np.ndarray, runs: np.ndarray, dense: int = 12) -> np.ndarray:
    """How many runs each two of the sets have in common. runs: those of all sets, one after the other.

    Runs that few sets have are added up pair by pair, the others by a product of membership matrices.
    """
    n = len(sizes)
    _, which, count = np.unique(runs, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(which, kind="stable")
    order = order[count[which[order]] > 1]
    row, col = owner[order], which[order]
    few = count[col] <= dense
    flat = np.zeros(n * n)
    r, c = row[few], col[few]
    for lag in range(1, dense):
        same = c[lag:] == c[:-lag]
        if not same.any():
            break
        flat += np.bincount(r[:-lag][same] * n + r[lag:][same], minlength=n * n)
    common = flat.reshape(n, n)
    common = common + common.T
    r, c = row[~few], np.unique(col[~few], return_inverse=True)[1]
    for first in range(0, int(c[-1]) + 1 if len(c) else 0, 2048):
        a, e = np.searchsorted(c, [first, first + 2048])
        member = np.zeros((n, 2048), np.float32)
        member[r[a:e], c[a:e] - first] = 1
        common += member @ member.T
    return common


def alike(sizes: np.ndarray, runs: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: the sets whose Jaccard similarity is at least that; empty sets are copies of each other."""
    common = shared_runs(sizes, runs)
    union = sizes[:, None] + sizes[None, :] - common
    return np.nonzero(np.triu((common / np.maximum(union, 1) >= similarity) | (union == 0), 1))


def _blocked(members: DataFrame, key: str, rows: int, runs: int, salt: int) -> DataFrame:
    """members with blocks (of their key's group) and block, so that about so many rows and runs are in one."""
    size = members.groupBy(key).agg(F.ceil(F.greatest(F.count(F.lit(1)) / rows, F.sum(F.size("runs")) / runs)).cast("int").alias("blocks"))
    return members.join(size, key).withColumn("block", F.pmod(F.xxhash64("id", F.lit(salt)), F.col("blocks")).cast("int"))


def linked_inside(members: DataFrame, similarity: float, rows: int, runs: int, salt: int) -> DataFrame:
    """(family, id, root, blocks): the smallest id of each member's component within its block. members: family, id, runs."""

    def run(table: pa.Table) -> pa.Table:
        ids, (sizes, flat) = table["id"].to_numpy(), _lists(table["runs"])
        order = np.argsort(ids, kind="stable")
        labels = Labels(len(ids))
        labels.add(*alike(sizes[order], _taken(sizes, flat, order), similarity))
        return pa.table({"family": table["family"], "id": ids[order], "root": ids[order][labels.of], "blocks": table["blocks"]})

    dealt = _blocked(members, "family", rows, runs, salt).select("family", "blocks", "block", "id", "runs")
    return dealt.repartition("family", "block").groupBy("family", "block").applyInArrow(run, "family long, id long, root long, blocks int")


def linked_across(members: DataFrame, similarity: float, rows: int, runs: int) -> DataFrame:
    """(a, b): roots to be joined, as members of theirs are alike. members: family, id, root, runs.

    The members outside each family's largest root, in blocks, meet all members, in blocks.
    """
    largest = members.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    sided = members.join(largest, "family")
    rest = _blocked(sided.where("root != largest"), "family", rows, runs, 1).withColumnsRenamed({"block": "s", "blocks": "s_blocks"})
    every = _blocked(sided, "family", rows, runs, 2).withColumnsRenamed({"block": "f", "blocks": "f_blocks"})
    size = lambda df, c: df.groupBy("family").agg(F.max(c).alias(c))
    rest = rest.join(size(every, "f_blocks"), "family").withColumn("f", F.explode(F.sequence(F.lit(0), F.col("f_blocks") - 1)))
    every = every.join(size(rest, "s_blocks"), "family").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("s_blocks") - 1)))
    names = ["family", "s", "f", "id", "root", "runs"]
    both = rest.select(*names, F.lit(0).alias("side")).unionByName(every.select(*names, F.lit(1).alias("side")))

    def run(table: pa.Table) -> pa.Table:
        root, side, (sizes, flat) = table["root"].to_numpy(), table["side"].to_numpy(), _lists(table["runs"])
        i, j = alike(sizes, flat, similarity)
        ok = (side[i] != side[j]) & (root[i] != root[j])
        pairs = np.unique(np.sort(np.column_stack([root[i[ok]], root[j[ok]]]), axis=1), axis=0).reshape(-1, 2)
        keep = _spanning(pairs[:, 0], pairs[:, 1])
        return pa.table({"a": pairs[keep, 0], "b": pairs[keep, 1]})

    return both.repartition("family", "s", "f").groupBy("family", "s", "f").applyInArrow(run, "a long, b long")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values of all) of a column of lists."""
    whole = column.combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    return np.diff(whole.offsets.to_numpy()).astype(np.int64), whole.flatten().to_numpy()


def _taken(sizes: np.ndarray, flat: np.ndarray, order: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    return np.concatenate([flat[starts[k] : starts[k] + sizes[k]] for k in order]) if len(order) else flat


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (family, id, root) after the links (a, b) between roots."""
    links = checkpoint(links)
    if links.isEmpty():
        return roots
    over = components(links).withColumnsRenamed({"node": "old", "root": "new"})
    return checkpoint(roots.join(over, roots["root"] == over["old"], "left").select("family", "id", F.coalesce("new", "root").alias("root")))


def similar_roots(families: DataFrame, sets: DataFrame, similarity: float = 0.8, rows: int = BLOCK_ROWS, runs: int = BLOCK_RUNS) -> DataFrame:
    """(node, root): the components of all exact links inside the families (node, root). sets: id and runs of their nodes."""
    members = checkpoint(sets.join(families.select(F.col("node").alias("id"), F.col("root").alias("family")), "id"))
    found = checkpoint(linked_inside(members, similarity, rows, runs, 0))
    roots = found.select("family", "id", "root")
    if not found.where("blocks > 1").isEmpty():
        wide = found.where("blocks > 1").select("family").distinct()
        own = checkpoint(members.join(wide, "family", "left_semi"))
        ones = own.join(roots.select(F.col("root").alias("id")).distinct(), "id", "left_semi")
        again = linked_inside(ones, similarity, rows, runs, 3)
        roots = merged(roots, again.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
        roots = merged(roots, linked_across(own.join(roots.select("id", "root"), "id"), similarity, rows, runs))
    return roots.select(F.col("id").alias("node"), "root")


def representatives(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, trie_rows: int = 50_000, rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id (null last), then of the smallest text hash.

    Sets of runs are known by 64-bit hashes and a set as a whole by 128 bits, so that no two different sets are taken for one.
    """
    key, check, own_key, nth = fresh(docs, "text_key", "text_check", "doc_key", "nth")
    hashed = lambda c, *salt: F.xxhash64(*salt, F.coalesce(c, F.lit("")))
    keyed = docs.withColumns({key: hashed("text"), check: hashed("text", F.lit(7)), own_key: F.xxhash64("doc_id")})
    own = docs.select("doc_id", hashed("text").alias("k"), hashed("text", F.lit(7)).alias("c"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, high, low = np.zeros((b.num_rows, WORDS + 1), np.uint64), *(np.zeros(b.num_rows, np.uint64) for _ in range(2))
            for first, end, data, offsets in text_slices(b.column(3)):
                raw = data.tobytes()
                for k in range(end - first):
                    h = np.unique(shingle_hashes(raw[offsets[k] : offsets[k + 1]], shingle))
                    whole = xxhash.xxh3_128_intdigest(h.tobytes(), SEED)
                    out[first + k], high[first + k], low[first + k] = signature(h), whole >> 64, whole & (1 << 64) - 1
            sig = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (WORDS + 1)), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), sig], names=["doc_id", "k", "c", "high", "low", "sig"])

    def shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_slices(b.column(1)):
                raw = data.tobytes()
                runs = [np.unique(shingle_hashes(raw[offsets[k] : offsets[k + 1]], shingle)) for k in range(end - first)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]).astype(np.int32)), pa.array(np.concatenate(runs).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), lists], names=["id", "runs"])

    signed = own.mapInArrow(sign, f"doc_id {kind}, k long, c long, high long, low long, sig array<long>")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), "k", "c")
    nodes = signed.groupBy("high", "low").agg(F.min(order).alias("least"), F.any_value("sig").alias("sig"))
    nodes = checkpoint(nodes.select(F.monotonically_increasing_id().alias("id"), "least", "sig"))
    families = components(proposals(nodes, similarity, trie_rows=trie_rows))

    wanted = nodes.join(families, nodes["id"] == families["node"], "left_semi").select("id", F.col("least.d").alias("d"), F.col("least.k").alias("wk"), F.col("least.c").alias("wc"))
    texts = own.join(wanted, own["doc_id"].eqNullSafe(wanted["d"]) & (own["k"] == wanted["wk"]) & (own["c"] == wanted["wc"])).select("id", "text")
    sets = texts.dropDuplicates(["id"]).mapInArrow(shingles, "id long, runs array<long>")
    linked = similar_roots(families, sets, similarity, rows)

    named = nodes.select("id", "least").join(linked, nodes["id"] == linked["node"], "left")
    first = named.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("least").alias("x")).select("x.d", F.col("x.k").alias("wk"), F.col("x.c").alias("wc"), F.xxhash64("x.d").alias("wd"))
    same = (keyed[own_key] == first["wd"]) & (keyed[key] == first["wk"]) & (keyed[check] == first["wc"])  # so the join's partitions serve the window too
    kept = keyed.join(first, same & F.coalesce(keyed["doc_id"] == first["d"], keyed["doc_id"].isNull() & first["d"].isNull()), "left_semi")
    once = Window.partitionBy(own_key, key, check, "doc_id").orderBy(F.lit(0))
    return kept.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).select(*docs.columns)
