"""Merkle manifest of a dataset: an external-memory node store, and proofs read from it by coordinate.

Rows are leaves. Those of a group, in the order of their key, are the lowest level of a tree; every
``width`` consecutive nodes become one of the next level until one remains, the subroot. The subroots,
in the order of their groups, are the leaves of one more tree, whose last node is the root.

1. ``leaves`` digests each row where it lies; no text moves.
2. Leaves are dealt by ranges of (group, key, leaf) and written as sorted runs. A run's rows know their place in
   it, and the few counts of (run, group) give each leaf its coordinate: tree, position.
3. Leaves are dealt in blocks of ``width ** levels`` positions and stream through ``build`` in order. Each level is
   read from the one below it, in sequence, and all go to Parquet, partitioned by level. The blocks' last nodes are the
   leaves of the next pass; a tree of a hundred million leaves takes three passes.
4. Proofs go from the top down: blocks' paths, nodes and leaves are merged in the order of their
   coordinates, and one scan of each block extracts what stands beside each leaf. The path above a block is the same for all of its leaves.

A task holds one block at a time. Digests are SHA-256; inputs of an inner node are the hex texts of the nodes below.
Nothing goes to the driver but the root. Null groups come first, then bytewise by UTF-8; null keys come first in a
group; rows of one key are ordered by their leaves, so repeated rows give the same tree in any order. An empty table has no root.
Columns other than the fields and ``extra`` play no part. A text is digested whole, in a copy or two of its size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256
from itertools import batched, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint_folder, remove, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = pa.schema([("tree", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("top", pa.bool_()), ("level", pa.int32())])
STORE = "tree long, at long, n long, digest binary, top boolean, level int"
STEPS = "array<struct<place int, others array<binary>>>"


@dataclass(frozen=True)
class MerkleParams:
    """``width`` nodes make one of the next level; a pass builds so many levels, of blocks of ``width ** levels`` leaves."""

    width: int = 3
    levels: int = 7


def leaf(fields: dict[str, Column]) -> Column:
    """The digest (binary) of a row's fields: each ``-`` if null, else its number of UTF-8 bytes, a colon and its text."""
    each = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return F.unhex(F.sha2(F.concat(*each).cast("binary"), 256))


def join(digests: Iterable[bytes]) -> bytes:
    """The node over these nodes."""
    return sha256("".join([d.hex() for d in digests]).encode()).digest()


def height(n: int, width: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    k = 0
    while n > 1:
        n, k = -(-n // width), k + 1
    return k


@dataclass(frozen=True)
class Tree:
    """The node store of one set of trees: ``nodes`` (see STORE; n is the tree's number of leaves), partitioned by level, and the tops of all trees (tree, n, digest)."""

    nodes: DataFrame
    tops: DataFrame
    passes: int


@dataclass(frozen=True)
class Manifest:
    """root: 64 hex digits, None for an empty table. leaves: tree, at, n, group, key, digest and the extra columns."""

    folder: str
    root: str | None
    leaves: DataFrame
    groups: Tree
    dataset: Tree
    key: str
    extra: tuple[str, ...]
    p: MerkleParams

    def proofs(self) -> DataFrame:
        """Each leaf's key, leaf, subroot, root (hex), steps from the leaf to the root, and the extra columns.

        A step has the node's place in its run and the run's other nodes, left to right.
        """
        tops = self.groups.tops.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), "digest", "n")
        whole = self.dataset.tops.select("tree", "n", F.lit(None).cast("binary").alias("subroot"), F.array().cast(STEPS).alias("steps"))
        above = _paths(self.dataset, tops, whole, self.p, ("n",)).select(F.col("at").alias("tree"), "n", F.col("digest").alias("subroot"), "steps")
        extra = [f"x{k}" for k in range(len(self.extra))]
        found = _paths(self.groups, self.leaves, above, self.p, ("key", *extra))
        hexed = lambda c: F.lower(F.hex(c)).alias(c)
        named = [F.col(x).alias(c) for x, c in zip(extra, self.extra, strict=True)]
        return found.select(F.col("key").alias(self.key), hexed("digest").alias("leaf"), hexed("subroot"), F.lit(self.root).alias("root"), "steps", *named)

    def remove(self) -> None:
        """Delete the store."""
        remove(self.leaves.sparkSession, self.folder)


def fold(digest: Column, steps: Column) -> Column:
    """The root (hex) that follows from a leaf (hex) and its steps."""
    texts = lambda a: F.array_join(F.transform(a, lambda d: F.lower(F.hex(d))), "")
    left, right = lambda s: F.slice(s["others"], 1, s["place"]), lambda s: F.slice(s["others"], s["place"] + 1, F.size(s["others"]))
    return F.aggregate(steps, digest, lambda h, s: F.sha2(F.concat(texts(left(s)), h, texts(right(s))).cast("binary"), 256))


def siblings(steps: Column) -> Column:
    """The proof as text: all other nodes' digests (hex) from the leaf's level upwards."""
    return F.array_join(F.transform(F.flatten(F.transform(steps, lambda s: s["others"])), lambda d: F.lower(F.hex(d))), "")


def build(spark: SparkSession, docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, extra: dict[str, Column] | None = None, p: MerkleParams = MerkleParams()) -> Manifest:
    """Write the node store of a table to a folder of its own in the shared folder. extra: more columns that go along with the leaves."""
    folder, extra = f"{checkpoint_folder(spark)}/merkle-{uuid.uuid4().hex}", extra or {}
    digests = docs.select(
        F.col(group).cast("string").alias("group"), F.col(key).alias("key"), leaf({c: F.col(c) for c in fields}).alias("digest"),
        F.rand(7).alias("tie"), *(c.alias(f"x{k}") for k, c in enumerate(extra.values())),
    )
    leaves = _numbered(stored(digests, f"{folder}/digests"), ("group",), ("key", "digest", "tie"), folder)
    groups = _levels(leaves, f"{folder}/groups", p)
    top = groups.tops.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), F.lit(groups.tops.count()).cast("bigint").alias("n"), "digest")
    dataset = _levels(top, f"{folder}/dataset", p)
    root = [r.digest.hex() for r in dataset.tops.collect()]  # one row
    return Manifest(folder, root[0] if root else None, leaves, groups, dataset, key, tuple(extra), p)


def _numbered(rows: DataFrame, group: tuple[str, ...], order: tuple[str, ...], folder: str) -> DataFrame:
    """rows with tree (the place of their group among all), at (their place in the group) and n (its size). The order is by columns that are in the table, so a repeated task deals alike."""
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    runs = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("nth", F.monotonically_increasing_id()).drop("tie")
    runs = stored(runs, f"{folder}/runs").withColumn("run", F.shiftright("nth", 33))
    counts = runs.groupBy("run", *group).agg(F.min("nth").alias("first"), F.count("*").alias("size"))  # a row for each group and run
    inside = Window.partitionBy(*group)
    counts = counts.withColumns({"before": F.sum("size").over(inside.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), "n": F.sum("size").over(inside)})
    counts = stored(counts, f"{folder}/counts")
    trees = _ranked(counts.where(F.col("before").isNull()).select(*group), group, folder)
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in group]
    placed = counts.join(trees, same(counts, trees)).select(*(counts[c] for c in ("run", *group, "first", "before", "n")), "tree")
    out = runs.join(placed, [runs["run"] == placed["run"], *same(runs, placed)]).select(
        "tree", (F.col("nth") - F.col("first") + F.coalesce("before", F.lit(0))).alias("at"), "n", *(runs[c] for c in runs.columns if c not in ("run", "nth", *group)),
    )
    return stored(out, f"{folder}/leaves")


def _ranked(groups: DataFrame, names: tuple[str, ...], folder: str) -> DataFrame:
    """Distinct groups with tree, their place in ascending order: numbers inside ranges, and what the ranges before hold."""
    keys = [F.col(c).asc_nulls_first() for c in names]
    sorted_ = stored(groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("nth", F.monotonically_increasing_id()), f"{folder}/group_runs")
    sorted_ = sorted_.withColumn("run", F.shiftright("nth", 33))
    sizes = sorted_.groupBy("run").count()  # a row for each partition
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))
    at = F.coalesce("before", F.lit(0)) + F.col("nth").bitwiseAND((1 << 33) - 1)
    return sorted_.join(before, "run").select(*names, at.alias("tree"))


def _levels(leaves: DataFrame, folder: str, p: MerkleParams) -> Tree:
    """Passes until every tree has its top. leaves: tree, at, n, digest."""
    span = p.width**p.levels

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            tree, number, n, below = (block[0][c] for c in ("tree", "block", "n", "level"))
            digests, rows, top = [r["digest"] for r in block], [], height(n, p.width)
            for level in range(below + 1, min(below + p.levels, top) + 1):  # each level reads the one below
                digests = [join(x) for x in batched(digests, p.width)]
                first = number * p.width ** (below + p.levels - level)
                rows += [(tree, first + k, n, d, level == top, level) for k, d in enumerate(digests)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), NODES.types, strict=True)], schema=NODES)

    spark, path, k = leaves.sparkSession, f"{folder}/nodes", 0
    open_ = leaves.where("n > 1").select("tree", "at", "n", "digest", F.lit(0).alias("level"))
    while k == 0 or not open_.isEmpty():
        blocks = open_.withColumn("block", F.expr(f"at DIV {span}")).repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
        blocks.mapInArrow(run, STORE).write.partitionBy("level").mode("append").parquet(path)
        k += 1
        nodes = spark.read.schema(STORE).parquet(path)
        open_ = nodes.where((F.col("level") == k * p.levels) & ~F.col("top")).drop("top")
    tops = leaves.where("n = 1").select("tree", "n", "digest").unionByName(nodes.where("top").select("tree", "n", "digest"))
    return Tree(nodes, tops, k)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each (tree, block), which stand together."""
    for _, rows in groupby((r for b in batches for r in b.to_pylist()), itemgetter("tree", "block")):
        yield list(rows)


def _paths(store: Tree, leaves: DataFrame, above: DataFrame, p: MerkleParams, keep: tuple[str, ...] = ()) -> DataFrame:
    """Leaves (tree, at, digest, keep) with subroot, and steps that end with those of their tree. above: tree, n, subroot, steps.

    Passes go from the top down. A block gets its path from the pass above or, if it has its tree's top, from ``above``;
    sorted by coordinate, a scan meets the path, then the nodes from the top down, then the leaves.
    """
    span, found = p.width**p.levels, None
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    about = [none("binary", "subroot"), none(STEPS, "steps")]
    for k in reversed(range(store.passes)):
        base, kept = k * p.levels, keep if k == 0 else ()
        path = above.where((F.col("n") <= span ** (k + 1)) & ((F.col("n") > span**k) | F.lit(k == 0))).withColumn("block", F.lit(0).cast("bigint")).drop("n")
        if found is not None:
            path = path.unionByName(found.select("tree", F.col("at").alias("block"), "subroot", "steps"))
        blank = [none(leaves.schema[c].dataType, c) for c in kept]
        rows = path.select("tree", "block", F.lit(p.levels + 1).alias("level"), F.lit(0).cast("bigint").alias("at"), none("binary", "digest"), "subroot", "steps", *blank)
        inner = store.nodes.where((F.col("level") > base) & (F.col("level") <= base + p.levels)).withColumn("level", F.col("level") - base)
        block = F.expr("CASE level " + " ".join(f"WHEN {j} THEN at DIV {p.width ** (p.levels - j)}" for j in range(1, p.levels + 1)) + " END")
        rows = rows.unionByName(inner.select("tree", block.alias("block"), "level", "at", "digest", *about, *blank))
        low = leaves if k == 0 else store.nodes.where((F.col("level") == base) & ~F.col("top"))
        rows = rows.unionByName(low.select("tree", F.expr(f"at DIV {span}").alias("block"), F.lit(0).alias("level"), "at", "digest", *about, *kept))
        rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("level"), "at")
        found = rows.mapInArrow(_scan(p.width, kept), rows.drop("block", "level").schema)
    return found


def _scan(width: int, kept: tuple[str, ...]):
    """The kernel of ``_paths``: a leaf's steps inside its block, then those of the block."""
    kinds = {"tree": pa.int64(), "at": pa.int64(), "digest": pa.binary(), "subroot": pa.binary(), "steps": pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.binary()))]))}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, pa.DataType] = {}

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                held.update({c: b.schema.field(c).type for c in kept})
                yield b

        for path, *rows in _blocks(seen()):
            levels = {k: list(nodes) for k, nodes in groupby(rows, itemgetter("level"))}
            top = max(levels)

            @cache
            def steps(level: int, q: int, levels=levels, top=top, path=path) -> list[dict]:
                if level == top:
                    return path["steps"]
                run = levels[level][q - q % width : q - q % width + width]
                others = [r["digest"] for k, r in enumerate(run) if k != q % width]
                return [{"place": q % width, "others": others}, *steps(level + 1, q // width)]

            leaves = levels[0]
            out = {c: [r[c] for r in leaves] for c in ("tree", "at", "digest")} | {"subroot": [path["subroot"]] * len(leaves), "steps": [steps(0, q) for q in range(len(leaves))]}
            out |= {c: [r[c] for r in leaves] for c in kept}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c) or held[c]) for c, v in out.items()], names=list(out))

    return run
