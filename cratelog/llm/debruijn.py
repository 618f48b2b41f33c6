"""Substring dedup: repeated word runs found as compacted paths of a De Bruijn graph.

Each window of ``window`` words is an edge, from the node of its first window - 1 words to that of
its last. An edge that starts at two places or more, in one document or several, is repeated.

1. Seeds. Of the runs of (window + 1) // 2 words in a window, the one of the least hash is its seed.
   Equal windows have equal seeds at equal places, so a window can only be repeated if its seed is:
   seeds are a tenth of the words, and only texts that hold repeated ones are looked at further.
2. Pieces. Neighbouring edges that share a seed are a piece: a path that is compacted where it stands.
   It is known by a 128-bit digest of its words and counted by a group-by. Edges of pieces that occur
   once are looked up one by one among all edges, by 96 bits, as the ends of repeated passages lie there.
3. Compaction. Pieces that are repeated are the arcs of the graph. Where a node has one arc in and one
   out these are one path; pointer doubling by joins gives each arc its path and its place there.
4. Source coordinates. A path stands at the sources of its arcs, in stretches. Wherever a text runs along a stretch that
   is one span, and its words are compared with those at the stretch's source; single edges go by their 96 bits.
   If any words differ, digests have met by chance: all is done again with another seed and twice the bits.

Texts are known by 96 bits, so a text that occurs many times asks and is answered once. Hot seeds,
pieces and edges are added up in each task before the shuffle; the joins are plain ones, whose skewed partitions
adaptive execution splits. A null text has no words; texts shorter than the window keep all of theirs;
repeated rows come out once each, an empty table gives none; other columns than ``keep`` play no part.
A text is taken whole, so a very long one takes some fifty times its size in a Python worker.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, checkpoint_folder, mix, powers, remove, scratch, stored, text_slices, word_bounds, word_hashes

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)
SPANS = "array<struct<first:bigint,last:bigint,path:bigint>>"


def run_hashes(words: np.ndarray, before: np.ndarray, size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of so many words, its first word) of all rows; ``before``: words before each row and in all."""
    up, down = powers(len(words) + 1, base)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    count = np.maximum(np.diff(before) - size + 1, 0)
    at = np.repeat(before[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return mix((sums[at + size] - sums[at]) * down[at]), at


@dataclass
class Words:
    """The words of a slice of texts, and the seed of each window."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    before: np.ndarray
    hashes: np.ndarray
    at: np.ndarray
    seed_at: np.ndarray
    seeds: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray, window: int) -> Words:
        starts, ends, before = word_bounds(data, offsets)
        hashes, size = word_hashes(data, starts, ends), (window + 1) // 2
        found, where = run_hashes(hashes, before, size, _BASES[0])
        whole = np.full(len(hashes), np.uint64(2**64 - 1))
        whole[where] = found
        count = np.maximum(np.diff(before) - window + 1, 0)
        at = np.repeat(before[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        # The least of the upper halves, the leftmost if equal, over window - size + 1 runs.
        least, span, reach = (whole & ~_LOW) | np.arange(len(whole), dtype=np.uint64), 1, window - size + 1
        while 2 * span <= reach:
            least, span = np.minimum(least[:-span], least[span:]) if len(least) > span else least[:0], 2 * span
        if span < reach:
            gap = reach - span
            least = np.minimum(least[:-gap], least[gap:]) if len(least) > gap else least[:0]
        seed_at = (least[at] & _LOW).astype(np.int64)
        return Words(data, starts, ends, before, hashes, at, seed_at, whole[seed_at])

    def rows(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.before, at, "right") - 1


def seed_counts(texts: DataFrame, window: int) -> DataFrame:
    """(seed, n): at how many places each seed stands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.zeros(0, np.uint64)]
            for _, _, data, offsets in text_slices(b.column(0)):
                w = Words.of(data, offsets, window)
                held.append(w.seeds[np.unique(w.seed_at, return_index=True)[1]])
            seeds, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(n)], names=["seed", "n"])

    return texts.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))


def text_seeds(texts: DataFrame, window: int) -> DataFrame:
    """(seed, k, c): the seeds of each text, once for each different text of a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, keys, checks, w in _distinct(b, window):
                at, first = np.unique(w.seed_at, return_index=True)
                row = pa.array(w.rows(at))
                yield pa.RecordBatch.from_arrays([pa.array(w.seeds[first].view(np.int64)), keys.take(row), checks.take(row)], names=["seed", "k", "c"])

    return texts.select("text", "k", "c").mapInArrow(run, "seed long, k long, c int")


def _distinct(b: pa.RecordBatch, window: int) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array, Words]]:
    """(times, k, c, words) of the different texts of a batch of text, k, c, in slices."""
    if not b.num_rows:
        return
    keys = np.rec.fromarrays([b.column(1).to_numpy(), b.column(2).to_numpy()])
    _, first, times = np.unique(keys, return_index=True, return_counts=True)
    own = b.take(pa.array(first))
    for a, e, data, offsets in text_slices(own.column(0)):
        yield times[a:e], own.column(1).slice(a, e - a), own.column(2).slice(a, e - a), Words.of(data, offsets, window)


def looked_at(texts: DataFrame, asked: DataFrame, keep: tuple[str, ...], with_text: bool, path: str) -> DataFrame:
    """keep, k, c, n_words, and of texts with repeated seeds the text and these seeds, of others the digest of all words (and the words, if with_text); lead: the first of a text in its batch. Written at a path."""
    own = texts.join(asked, ["k", "c"], "left").select(*keep, "k", "c", "seeds", "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            open_ = b.column(b.num_columns - 2).is_valid()
            count, digest, whole = np.zeros(b.num_rows, np.int64), [None] * b.num_rows, [None] * b.num_rows
            lead = np.zeros(b.num_rows, bool)
            lead[np.unique(np.rec.fromarrays([b.column(at).to_numpy() for at in (len(keep), len(keep) + 1)]), return_index=True)[1]] = True
            done = ~open_.to_numpy(zero_copy_only=False)
            for first, end, data, offsets in text_slices(b.column(b.num_columns - 1)):
                raw = data.tobytes()
                for i in range(first, end):
                    words = raw[offsets[i - first] : offsets[i - first + 1]].split()
                    count[i] = len(words)
                    if done[i]:
                        body = b" ".join(words)
                        digest[i], whole[i] = hashlib.sha256(body).hexdigest(), body.decode() if with_text else None
            text = pc.if_else(open_, b.column(b.num_columns - 1), pa.scalar(None, b.column(b.num_columns - 1).type))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text, pa.array(count), pa.array(digest, pa.string()), pa.array(whole, pa.string()), pa.array(lead)], names=[*b.schema.names, "n_words", "digest", "kept_text", "lead"])

    return stored(own.mapInArrow(run, f"{kinds}, n_words long, digest string, kept_text string, lead boolean"), path)


def pieces(held: DataFrame, window: int, path: str, seed: int = 0, bits: int = 128) -> DataFrame:
    """(s, t, k, c, pos, m, u, v, e, f, w): pieces of m edges at word pos of text (k, c), which occurs w times in its batch.

    s and t are the digest of the words, of so many bits, u and v the nodes at the ends, e and f the hashes of the edges. Written at a path.
    """
    masks = np.array([(1 << min(bits, 64)) - 1, (1 << max(bits - 64, 0)) - 1], np.uint64).view(np.int64)
    kinds = "s long, t long, k long, c int, pos int, m int, u long, v long, e array<long>, f array<int>, w long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = np.unique(np.asarray(b.column(3).flatten())).view(np.uint64) if b.num_rows else None
            for times, keys, checks, w in _distinct(b.select([0, 1, 2]), window):
                on = np.isin(w.seeds, known)
                first = np.flatnonzero(on & np.r_[True, ~on[:-1] | (w.seed_at[1:] != w.seed_at[:-1])][: len(on)])
                last = np.flatnonzero(on & np.r_[~on[1:] | (w.seed_at[1:] != w.seed_at[:-1]), True][-len(on) :]) + 1 if len(on) else first
                if not len(first):
                    continue
                edge, _ = run_hashes(w.hashes, w.before, window, _BASES[0])
                check, _ = run_hashes(word_hashes(w.data, w.starts, w.ends, _BASES[1]), w.before, window, _BASES[1])
                node, node_at = run_hashes(w.hashes, w.before, window - 1, _BASES[0])
                begin, size = w.at[first], last - first
                row, raw = w.rows(begin), w.data.tobytes()
                digest = [xxhash.xxh3_128_digest(b" ".join(raw[x:y].split()), seed) for x, y in zip(w.starts[begin].tolist(), w.ends[begin + size + window - 2].tolist(), strict=True)]
                digest = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2) & masks
                bounds = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
                inner = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                ends = [node[np.searchsorted(node_at, x)].view(np.int64) for x in (begin, begin + size)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), keys.take(pa.array(row)), checks.take(pa.array(row)), pa.array((begin - w.before[row]).astype(np.int32)), pa.array(size.astype(np.int32)), *map(pa.array, ends),
                    pa.ListArray.from_arrays(bounds, pa.array(edge[inner].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array((check[inner] >> np.uint64(32)).astype(np.uint32).view(np.int32))), pa.array(times[row].astype(np.int64)),
                ], names=["s", "t", "k", "c", "pos", "m", "u", "v", "e", "f", "w"])

    return stored(held.where("seeds IS NOT NULL").select("text", "k", "c", "seeds").mapInArrow(run, kinds), path)


def compacted(arcs: DataFrame) -> DataFrame:
    """(id, path): the path of each arc, by the id of its first. arcs: id, u, v, and the source (k, c, pos) of each.

    Two arcs are neighbours on a path if they meet at a node that no other arc enters or leaves. Neighbours
    that also follow each other at their sources are joined there first, to stretches. Then, each round, every
    open stretch points on to where the one it points to points, so rounds are the logarithm of the most stretches of a
    path. As long as a path has open stretches, each round closes some; what is open after a round that
    closed none lies on circles, which have no first arc: there the path is the least id of the circle's stretches, which
    doubling finds as well.
    """
    alone = lambda c, name: arcs.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias(name)).where("n = 1").select(F.col(c).alias("node"), name)
    before = alone("u", "id").join(alone("v", "prev"), "node").where("id != prev").select("id", "prev")
    source = Window.partitionBy("k", "c").orderBy("pos")
    head = F.coalesce(F.col("prev") != F.lag("id").over(source), F.lit(True))
    stretch = F.last(F.when(F.col("head"), F.col("id")), ignorenulls=True).over(source.rowsBetween(Window.unboundedPreceding, 0))
    placed = checkpoint(arcs.join(before, "id", "left").withColumn("head", head).select("id", "prev", "head", stretch.alias("stretch")))
    joined = placed.where("head").select(F.col("id").alias("own"), "prev").join(placed.select(F.col("id").alias("prev"), F.col("stretch").alias("to")), "prev", "left")
    state = checkpoint(joined.select(F.col("own").alias("id"), F.coalesce("to", "own").alias("path"), F.col("to").isNull().alias("done")))
    start, parts, open_ = state, state.rdd.getNumPartitions(), state.where("NOT done").count()
    while open_:
        ahead = state.select(F.col("id").alias("path"), F.col("path").alias("further"))
        stepped = state.where("NOT done").join(ahead, "path").select("id", F.col("further").alias("path"), (F.col("path") == F.col("further")).alias("done"))
        state, last = checkpoint(state.where("done").unionByName(stepped).coalesce(parts)), open_
        open_ = state.where("NOT done").count()
        if open_ == last:
            ring = checkpoint(start.join(state.where("NOT done").select("id"), "id", "left_semi").select("id", "path", F.col("id").alias("least")))
            moved = 1
            while moved:  # until looking twice as far shows nothing smaller to any
                ahead = ring.select(F.col("id").alias("path"), F.col("path").alias("further"), F.col("least").alias("there"))
                ring = checkpoint(ring.join(ahead, "path").select("id", F.col("further").alias("path"), F.least("least", "there").alias("least"), (F.col("there") < F.col("least")).alias("moved")).coalesce(parts))
                moved = ring.where("moved").count()
            state = state.where("done").select("id", "path").unionByName(ring.select("id", F.col("least").alias("path")))
            break
    return placed.select("id", F.col("stretch").alias("own")).join(state.select(F.col("id").alias("own"), "path"), "own").select("id", "path")


def stretches(arcs: DataFrame, paths: DataFrame) -> DataFrame:
    """(s, t, path, sk, sc, spos, off): each arc lies off words after the start, at word spos of text (sk, sc), of a stretch of its path."""
    source = Window.partitionBy("k", "c").orderBy("pos")
    goes_on = (F.lag("path").over(source) == F.col("path")) & (F.lag(F.col("pos") + F.col("m")).over(source) == F.col("pos"))
    start = F.last(F.when(~F.coalesce(goes_on, F.lit(False)), F.col("pos")), ignorenulls=True).over(source.rowsBetween(Window.unboundedPreceding, 0))
    placed = arcs.join(paths, "id").withColumn("spos", start)
    return placed.select("s", "t", "path", F.col("k").alias("sk"), F.col("c").alias("sc"), "spos", (F.col("pos") - F.col("spos")).alias("off"))


def claims(placed: DataFrame, window: int, path: str) -> DataFrame:
    """(k, c, path, sk, sc, spos, first, last, off): words first to last of text (k, c) are those from off on of a stretch. Written at a path.

    placed: k, c, pos, m of arcs wherever they stand, with their place in a stretch. Those that follow each other in both are one claim.
    """
    at = ["k", "c", "path", "sk", "sc", "spos"]
    here = Window.partitionBy("k", "c").orderBy("pos", "m")
    same = F.lit(True)
    for name in at[2:]:
        same = same & (F.lag(name).over(here) == F.col(name))
    same = same & (F.lag(F.col("pos") - F.col("off")).over(here) == F.col("pos") - F.col("off")) & (F.lag(F.col("pos") + F.col("m")).over(here) >= F.col("pos"))
    run = F.last(F.when(~F.coalesce(same, F.lit(False)), F.col("pos")), ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))
    runs = placed.withColumn("run", run).groupBy(*at, "run").agg(F.max(F.col("pos") + F.col("m")).alias("end"), F.min("off").alias("off"))
    return stored(runs.select(*at, F.col("run").cast("long").alias("first"), (F.col("end") + (window - 1)).cast("long").alias("last"), "off"), path)


def source_words(held: DataFrame, claimed: DataFrame, path: str) -> DataFrame:
    """(sk, sc, spos, words): of each stretch that is claimed elsewhere as many words as are claimed, from its source. Written at a path."""
    asked = claimed.where(_elsewhere()).groupBy("sk", "sc", "spos").agg(F.max(F.col("off") + F.col("last") - F.col("first")).alias("size"))
    asked = asked.groupBy("sk", "sc").agg(F.collect_list(F.struct("spos", "size")).alias("asked"))
    texts = held.where("seeds IS NOT NULL AND lead").select(F.col("k").alias("sk"), F.col("c").alias("sc"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_slices(b.column(3)):
                raw, row, pos, found = data.tobytes(), [], [], []
                for i in range(first, end):
                    words = raw[offsets[i - first] : offsets[i - first + 1]].split()
                    for x in b.column(2)[i].as_py():
                        row.append(i)
                        pos.append(x["spos"])
                        found.append(b" ".join(words[x["spos"] : x["spos"] + x["size"]]).decode())
                keys = [b.column(n).take(pa.array(row, pa.int64())) for n in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(pos, pa.int32()), pa.array(found, pa.string())], names=["sk", "sc", "spos", "words"])

    found = texts.join(asked, ["sk", "sc"]).select("sk", "sc", "asked", "text").mapInArrow(run, "sk long, sc int, spos int, words string")
    return stored(found.dropDuplicates(["sk", "sc", "spos"]), path)


def _elsewhere() -> Column:
    """Whether a claim is for other words than those of the source."""
    return (F.col("k") != F.col("sk")) | (F.col("c") != F.col("sc")) | (F.col("first") != F.col("spos") + F.col("off"))


def mark(docs: DataFrame, window: int = 35, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False, digest_bits: int = 128) -> DataFrame:
    """keep, n_words, n_removed, kept_sha256 and repeated_spans; with_text adds kept_text.

    Spans are of words, last exclusive, in order; path is the same number wherever spans lie on the same path of
    the graph, and null for what only ends of passages have in common. digest_bits is what pieces are told by at first; spans
    on paths are compared word for word, so it changes no result. The result is a written table; the tables it is made of go.
    """
    spark, bits = docs.sparkSession, digest_bits
    for attempt in range(8):
        with scratch(spark, "substrings") as at:
            name = f"{checkpoint_folder(spark)}/substring-result-{uuid.uuid4().hex}"
            out = stored(_marked(docs, window, keep, with_text, at, attempt, min(bits, 128)), name)
        if not out.where("unequal > 0").limit(1).count():
            return out.drop("unequal")
        remove(spark, name)
        bits *= 2
    raise RuntimeError("digests of different words met eight times")


def _marked(docs: DataFrame, window: int, keep: tuple[str, ...], with_text: bool, at: str, seed: int, bits: int) -> DataFrame:
    """The result of ``mark``, which reads tables below a folder, and how many spans are unequal to their source."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(*keep, text.alias("text"), F.xxhash64(text).alias("k"), F.hash(text).alias("c"))
    repeated = checkpoint(seed_counts(texts, window).where("n > 1").select("seed"))
    asked = checkpoint(text_seeds(texts, window).join(repeated, "seed").groupBy("k", "c").agg(F.collect_set("seed").alias("seeds")))
    held = looked_at(texts, asked, keep, with_text, f"{at}/texts")
    found = pieces(held, window, f"{at}/pieces", seed, bits)

    counted = found.groupBy("s", "t").agg(F.sum("w").alias("n"), F.min("u").alias("u"), F.min("v").alias("v"), F.min(F.struct("k", "c", "pos", "m")).alias("source"))
    arcs = checkpoint(counted.where("n > 1").select(F.monotonically_increasing_id().alias("id"), "s", "t", "u", "v", "source.*"))
    paths = stored(stretches(arcs, compacted(arcs.drop("s", "t", "m"))), f"{at}/paths")
    claimed = claims(found.select("s", "t", "k", "c", "pos", "m").join(paths, ["s", "t"]), window, f"{at}/claims")

    edges = found.select("w", F.explode(F.arrays_zip("e", "f")).alias("x")).groupBy("x.e", "x.f").agg(F.sum("w").alias("n"))
    edges = stored(edges.where("n > 1").select("e", "f"), f"{at}/edges")
    once = found.where("w = 1").join(arcs.select("s", "t"), ["s", "t"], "left_anti").select("k", "c", "pos", F.posexplode(F.arrays_zip("e", "f")).alias("i", "x"))
    once = once.select("k", "c", (F.col("pos") + F.col("i")).cast("long").alias("first"), "x.e", "x.f").join(edges, ["e", "f"])
    none = F.lit(None)
    ends = stored(once.select("k", "c", F.struct("first", (F.col("first") + window).alias("last"), none.cast("long").alias("path"), none.cast("string").alias("words")).alias("span")), f"{at}/ends")
    remove(docs.sparkSession, f"{at}/pieces")

    sources = source_words(held, claimed, f"{at}/words").withColumn("elsewhere", F.lit(True))
    compared = claimed.withColumn("elsewhere", _elsewhere()).join(sources, ["sk", "sc", "spos", "elsewhere"], "left")
    cut = F.expr("substring_index(substring_index(words, ' ', int(off + last - first)), ' ', int(first - last))")
    words = F.when(F.col("elsewhere"), F.coalesce(cut, F.lit("")))
    whole = compared.select("k", "c", F.struct("first", "last", "path", words.alias("words")).alias("span"))
    spans = whole.unionByName(ends).groupBy("k", "c").agg(F.collect_list("span").alias("spans"))

    opened = held.where("seeds IS NOT NULL").join(spans, ["k", "c"], "left").select(*keep, "n_words", "spans", "text")
    out = covered(opened, with_text)
    closed = held.where("seeds IS NULL").select(*keep, "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"), F.array().cast(SPANS).alias("repeated_spans"), *(["kept_text"] if with_text else []), F.lit(0).cast("long").alias("unequal"))
    return closed.unionByName(out)


def covered(opened: DataFrame, with_text: bool) -> DataFrame:
    """The result for texts with their spans, which may overlap, and how many of these differ from the words they should be; opened: what is kept, n_words, spans, text."""
    rest = opened.schema.fields[:-2]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + f", n_removed long, kept_sha256 string, repeated_spans {SPANS}" + ", kept_text string" * with_text + ", unequal long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, digest, spans, texts, unequal = [], [], [], [], []
            given = b.column(b.num_columns - 2).to_pylist()
            for first, end, data, offsets in text_slices(b.column(b.num_columns - 1)):
                raw = data.tobytes()
                for i in range(first, end):
                    words = raw[offsets[i - first] : offsets[i - first + 1]].split()
                    own = sorted(given[i] or [], key=lambda s: (s["first"], s["last"]))
                    unequal.append(sum(s["words"] is not None and b" ".join(words[s["first"] : s["last"]]) != s["words"].encode() for s in own))
                    joined: list[dict] = []
                    for s in own:
                        if joined and s["first"] <= joined[-1]["last"] and s["path"] == joined[-1]["path"]:
                            joined[-1]["last"] = max(joined[-1]["last"], s["last"])
                        else:
                            joined.append({name: s[name] for name in ("first", "last", "path")})
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s in joined:
                        gone[s["first"]] += 1
                        gone[s["last"]] -= 1
                    cover = np.cumsum(gone[:-1]) > 0
                    kept = b" ".join([w for w, g in zip(words, cover.tolist(), strict=True) if not g])
                    removed.append(int(cover.sum()))
                    digest.append(hashlib.sha256(kept).hexdigest())
                    spans.append(joined)
                    texts.append(kept.decode() if with_text else None)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("path", pa.int64())]))
            more = [pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, kind), *([pa.array(texts, pa.string())] if with_text else []), pa.array(unequal, pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *more], names=[*b.schema.names[:-2], "n_removed", "kept_sha256", "repeated_spans", *(["kept_text"] if with_text else []), "unequal"])

    return opened.mapInArrow(run, kinds)
