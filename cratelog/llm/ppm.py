"""LM scoring: prediction by partial matching over a byte-context trie, beside a word unigram base.

Training counts, over all training texts, every byte (A-Z lower-cased, and one end symbol) with
the ``order`` symbols before it, a gram. From these counts follow those of all shorter contexts, and
the trie: for each context its symbols, its total and its escape weight (one for each symbol seen,
method D). A symbol not found in a context escapes to the next shorter one, where the symbols
of the longer one are excluded. So the code length of a position is a function of its gram.

Nothing is pruned, and the trie is never in one place:

1. One map-only pass counts grams and words, added up in each task before the shuffle.
2. Grams are dealt by the last two symbols of their contexts. Such a group holds every context that
   ends so, and with the counts of the contexts of up to one symbol, of which there are 66,306 at most
   and which are broadcast, it is a trie of its own; it gives the log10 probability of each of its grams.
3. A second map-only pass adds up what each document's grams and words are worth. The most
   frequent answers, as many as ``head_grams`` and ``head_words`` allow, are broadcast; a document's other grams and
   words are answered by a join. Both come from the same tables, so the split changes no result.

Nulls are empty texts and have their end only; repeated rows teach and come out once each; columns
other than ``keep`` play no part; empty tables give none. With no training rows each symbol costs
log10(257). A text is taken whole, so a very long one takes a hundred times its size while it is scored.
Words are known by 96 hash bits. A group of step 2 is held by one task: a share of the distinct
grams, which natural text keeps far below the number of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fold_case, mix, text_slices, word_bounds, word_hashes
from .simhash import whole_groups

_BITS, _END, _ALPHABET = 9, 257, 257


@dataclass(frozen=True)
class PpmParams:
    """``head_grams`` and ``head_words`` bound what is broadcast of the answers; they change no result."""

    order: int = 5
    head_grams: int = 1 << 20
    head_words: int = 1 << 19


@dataclass(frozen=True)
class Trie:
    """For each length: contexts with their denominators and escapes, and their symbols (grams one longer) with log10 weights."""

    order: int
    contexts: list[np.ndarray]
    nodes: list[np.ndarray]
    grams: list[np.ndarray]
    log_weight: list[np.ndarray]
    floor: float


def position_grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(the last order + 1 symbols of each position as one number, first position of each row)."""
    size = np.diff(offsets)
    begin = np.concatenate([[0], np.cumsum(size + 1 + order)])
    symbols = np.zeros(begin[-1], np.int64)
    at = np.arange(len(data)) + np.repeat(begin[:-1] + order - offsets[:-1], size)
    symbols[at] = fold_case(data).astype(np.int64) + 1
    symbols[begin[1:] - 1] = _END
    key = np.zeros(max(len(symbols) - order, 0), np.int64)
    for k in range(order + 1):
        key <<= _BITS
        key |= symbols[k : len(symbols) - order + k]
    keep = np.repeat(begin[:-1], size + 1) + np.arange(len(data) + len(size)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    return key[keep], np.cumsum(size + 1) - size - 1


def build(counts: dict[int, tuple[np.ndarray, np.ndarray]], order: int) -> Trie:
    """counts: of the grams of each length from 1 to order + 1, sorted by gram. For a context among
    them, all of its symbols must be there, and all shorter contexts.

    A symbol seen c times in a context weighs 2c - 1, the escape 1 for each symbol (method D).
    """
    mask = [(1 << _BITS * m) - 1 for m in range(order + 2)]
    safe = lambda x: np.log10(np.maximum(x, 1e-300))
    contexts, parents, weights, total, seen = [], [], [], [], []
    for k in range(order + 1):
        grams, n = counts[k + 1]
        known, parent = np.unique(grams >> _BITS, return_inverse=True)
        contexts.append(known)
        parents.append(parent)
        weights.append(2.0 * n - 1)
        total.append(np.bincount(parent, weights=weights[-1], minlength=len(known)))
        seen.append(np.bincount(parent, minlength=len(known)))
    nodes = []
    for k in range(order + 1):
        whole = safe(total[k] + seen[k])
        own = [whole, safe(seen[k]) - whole, np.zeros(len(whole)), np.zeros(len(whole))]
        if k:
            up = np.searchsorted(contexts[k - 1], contexts[k] & mask[k - 1])
            shorter = np.searchsorted(counts[k][0], counts[k + 1][0] & mask[k])
            excluded = np.bincount(parents[k], weights=weights[k - 1][shorter], minlength=len(whole))
            left, on = np.maximum(total[k - 1][up] - excluded, 0), seen[k - 1][up] - seen[k]
            on = np.where(left == 0, np.maximum(on, 1), on)
            own[2:] = [safe(left + on), safe(on) - safe(left + on)]
        nodes.append(np.column_stack([c.astype(np.float32) for c in own]))
    logs = [safe(w).astype(np.float32) for w in weights]
    return Trie(order, contexts, nodes, [counts[k + 1][0] for k in range(order + 1)], logs, float(-np.log10(max(_ALPHABET - int(seen[0].sum()), 1))))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def gram_scores(trie: Trie, grams: np.ndarray) -> np.ndarray:
    """log10 probability of the last symbol of each gram after the symbols before it."""
    out = np.zeros(len(grams))
    todo = np.arange(len(grams))
    came = np.full(len(grams), -1)
    for k in range(trie.order, -1, -1):
        if not len(todo):
            break
        g = grams[todo]
        node = _find(trie.contexts[k], g >> _BITS & (1 << _BITS * k) - 1)
        child = np.where(node >= 0, _find(trie.grams[k], g & (1 << _BITS * (k + 1)) - 1), -1)
        if not len(trie.nodes[k]):
            continue
        den, esc = trie.nodes[k][node, 0], trie.nodes[k][node, 1]
        if k < trie.order and len(trie.nodes[k + 1]):
            entry, above = came[todo] < 0, trie.nodes[k + 1][came[todo]]
            den, esc = np.where(entry, den, above[:, 2]), np.where(entry, esc, above[:, 3])
        hit = child >= 0
        out[todo[hit]] += trie.log_weight[k][child[hit]] - den[hit]
        missed = ~hit & (node >= 0)
        out[todo[missed]] += esc[missed]
        came[todo] = node
        todo = todo[~hit]
    out[todo] += trie.floor
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, 32-bit check, words of each row) of the lower-cased words."""
    starts, ends, before = word_bounds(data, offsets)
    data = fold_case(data)
    check = word_hashes(data, starts, ends, 0xC2B2AE3D27D4EB4F) >> np.uint64(32)
    return word_hashes(data, starts, ends).view(np.int64), check.astype(np.uint32).view(np.int32), np.diff(before)


GRAM, WORD, ROWS = 0, 1, 2

#: Keys that a counting task holds of each kind before it hands their sums on; rows of a batch that it hands on;
#: bytes of text that a pass looks at together.
_HELD, _BATCH, _SLICE = 1 << 20, 1 << 16, 1 << 19


def _paired(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Numbers that are equal for equal pairs, and different for different ones of a task but for a chance of 2**-64 each two."""
    return (keys.view(np.uint64) ^ mix(checks.view(np.uint32).astype(np.uint64))).view(np.int64)


def _starts(x: np.ndarray) -> np.ndarray:
    """Where new values begin in a sorted array."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, how often each occurs) of a sorted array."""
    first = _starts(x)
    return x[first], np.diff(np.r_[first, len(x)])


class _Counter:
    """Keys with how often they occur in all and in learning texts, added up as they come."""

    def __init__(self, kind: int):
        self.kind, self.held, self.size = kind, [], 0

    def add(self, keys: np.ndarray, checks: np.ndarray, learns: np.ndarray) -> None:
        """Grams are counted by sorting, those that teach apart from the others; words by their pairs. A slice's counts fit in 32 bits."""
        if self.kind == GRAM:
            for on, teach in ((learns, 1), (~learns, 0)):
                k, n = _counted(np.sort(keys[on]))
                n = n.astype(np.int32)
                self._hold(k, np.zeros(0, np.int32), n, n if teach else np.zeros(len(n), np.int32))
        else:
            keys, checks, m, n = self._added(keys, checks, np.ones(len(keys), np.int32), learns.astype(np.int32))
            self._hold(keys, checks, m.astype(np.int32), n.astype(np.int32))

    def _hold(self, keys: np.ndarray, *rest: np.ndarray) -> None:
        if len(keys):
            self.held.append((keys, *rest))
            self.size += len(keys)

    def _added(self, keys: np.ndarray, checks: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(keys if self.kind == GRAM else _paired(keys, checks), kind="stable")
        keys = keys[order]
        if self.kind == GRAM:
            first = _starts(keys)
            checks = np.zeros(len(first), np.int32)
        else:
            checks = checks[order]
            first = _starts(_paired(keys, checks))
            checks = checks[first]
        sums = (np.add.reduceat(x[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64) for x in (m, n))
        return keys[first], checks, *sums

    def take(self, least: int) -> Iterator[pa.RecordBatch]:
        """The sums, in batches, if more keys than ``least`` are held. What is held is let go before."""
        if self.size > least:
            columns = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            self.held, self.size = [], 0
            columns = self._added(*columns)
            for at in range(0, len(columns[0]), _BATCH):
                yield _count_rows(self.kind, *(x[at : at + _BATCH] for x in columns))


def _count_rows(kind: int, keys, checks, m, n) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys, pa.int64()), pa.array(checks, pa.int32()), pa.array(m, pa.int64()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "check", "m", "n"])


def count(docs: DataFrame, learn: str, order: int) -> DataFrame:
    """(kind, key, check, m, n): how often each gram and word occurs in all texts and in those that teach; ROWS counts texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words, rows, taught = _Counter(GRAM), _Counter(WORD), 0, 0
        for b in batches:
            learns = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            rows, taught = rows + b.num_rows, taught + int(learns.sum())
            for first, end, data, offsets in text_slices(b.column(0), _SLICE):
                own = learns[first:end]
                key, _ = position_grams(data, offsets, order)
                grams.add(key, np.zeros(0, np.int32), np.repeat(own, np.diff(offsets) + 1))
                key, check, size = _words(data, offsets)
                on = np.repeat(own, size)
                words.add(key[on], check[on], np.ones(int(on.sum())))
                yield from grams.take(_HELD)
                yield from words.take(_HELD)
        yield from grams.take(0)
        yield from words.take(0)
        yield _count_rows(ROWS, [0], [0], [rows], [taught])

    counted = docs.select("text", learn).mapInArrow(run, "kind byte, key long, check int, m long, n long")
    return counted.groupBy("kind", "key", "check").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))


def _short(grams: DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts of the learned grams of one or two symbols, sorted; 258 or 66,306 at most."""
    own = grams.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << _BITS * length) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(own["key"].to_numpy())
    return own["key"].to_numpy()[order], own["n"].to_numpy()[order]


def gram_answers(grams: DataFrame, order: int) -> DataFrame:
    """(key, value, m): the log10 probability of each gram's last symbol after those before it. grams: key, m, n of all lengths' longest."""
    short = {1: _short(grams, 1), 2: _short(grams, 2)}
    shared = grams.sparkSession.sparkContext.broadcast(short)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, m, n in whole_groups((tuple(c.to_numpy() for c in b.columns) for b in batches), 400_000):
            if not len(shared.value[1][0]):
                value = np.full(len(key), -np.log10(_ALPHABET))
            else:
                counts, by = dict(shared.value), np.argsort(key)
                learned = by[n[by] > 0]
                longest, times = key[learned], n[learned]
                for length in range(order + 1, 2, -1):
                    short, at = np.unique(longest & (1 << _BITS * length) - 1, return_inverse=True)
                    counts[length] = short, np.bincount(at, weights=times, minlength=len(short)).astype(np.int64)
                value = np.empty(len(key))
                value[by] = gram_scores(build(counts, order), key[by])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value), pa.array(m)], names=["key", "value", "m"])

    pair = F.shiftright("key", _BITS).bitwiseAND(F.lit((1 << 2 * _BITS) - 1))
    dealt = grams.select(pair.alias("pair"), "key", "m", "n").repartition("pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(run, "key long, value double, m long")


@dataclass(frozen=True)
class Model:
    """answers: kind, key, check, value (a gram's log10 probability, a word's count) and m; the heads are its most frequent rows, sorted by key."""

    order: int
    answers: DataFrame
    grams: tuple[np.ndarray, np.ndarray]
    words: tuple[np.ndarray, np.ndarray, np.ndarray]
    tokens: int
    kinds: int
    ends: int


def _head(answers: DataFrame, kind: int, most: int) -> tuple[np.ndarray, ...]:
    """(key, check, value) of the most frequent answers, at most so many, sorted by key. Frequencies are cut at steps of an eighth of a power of two."""
    own = answers.where(F.col("kind") == kind).withColumn("step", F.floor(F.log2("m") * 8))
    held, least = 0, None
    for r in own.groupBy("step").count().orderBy(F.desc("step")).collect():
        held += r["count"]
        if held > most:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)
    got = own.where(F.col("step") >= least).select("key", "check", "value").toArrow()
    order = np.argsort(got["key"].to_numpy(), kind="stable")
    return tuple(got[c].to_numpy()[order] for c in ("key", "check", "value"))


def train(docs: DataFrame, learn: str, p: PpmParams = PpmParams()) -> Model:
    """What the rows with the boolean column ``learn`` teach about all grams and words of docs."""
    counts = checkpoint(count(docs.select(F.coalesce("text", F.lit("")).alias("text"), learn), learn, p.order))
    grams = gram_answers(counts.where(F.col("kind") == GRAM).select("key", "m", "n"), p.order)
    words = counts.where((F.col("kind") == WORD) & (F.col("n") > 0))
    one = lambda df, kind, check, value: df.select(F.lit(kind).cast("byte").alias("kind"), "key", check.alias("check"), value.alias("value"), "m")
    answers = checkpoint(one(grams, GRAM, F.lit(0), F.col("value")).unionByName(one(words, WORD, F.col("check"), F.col("n").cast("double"))))
    sums = counts.where(F.col("kind") != GRAM).groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).collect()
    of = {r["kind"]: r for r in sums}
    ends = of[ROWS]["n"] if ROWS in of else 0
    key, _, value = _head(answers, GRAM, p.head_grams)
    spoken = (of[WORD]["n"], of[WORD]["v"]) if WORD in of else (0, 0)
    return Model(p.order, answers, (key, value), _head(answers, WORD, p.head_words), spoken[0] + ends, spoken[1] + (ends > 0), ends)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, n_known, train_tokens, base_score and score of every row."""
    own = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.order, model.grams, model.words))
    asks = pa.list_(pa.struct([("kind", pa.int8()), ("key", pa.int64()), ("check", pa.int32()), ("times", pa.int32())]))

    def rest(row: np.ndarray, keys: np.ndarray, checks: np.ndarray, kind: int) -> tuple[np.ndarray, ...]:
        """Each row's keys that the head doesn't have, once with their number."""
        order = np.lexsort((checks, keys, row))
        row, keys, checks = row[order], keys[order], checks[order]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])][: len(row)])
        return row[first], np.full(len(first), kind, np.int8), keys[first], checks[first], np.diff(np.r_[first, len(row)]).astype(np.int32)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, (grams, logs), (words, checks, counts) = shared.value
        word_logs = np.log10(counts + 1)
        for b in batches:
            rows = b.num_rows
            if not rows:
                continue
            total, base, size, known, parts = np.zeros(rows), np.zeros(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64), []
            for first, end, data, offsets in text_slices(b.column(b.num_columns - 1), _SLICE):
                keys, begin = position_grams(data, offsets, order)
                codes, distinct = pd.factorize(keys)
                at, by = np.empty(len(distinct), np.int64), np.argsort(distinct)  # sorted questions find their place faster
                at[by] = _find(grams, distinct[by])
                value = np.where(at >= 0, logs[at] if len(logs) else 0.0, 0.0)
                total[first:end] = np.add.reduceat(value[codes], begin)
                if (at < 0).any():
                    row = np.repeat(np.arange(first, end), np.diff(offsets) + 1)
                    lost = at[codes] < 0
                    parts.append(rest(row[lost], keys[lost], np.zeros(int(lost.sum()), np.int32), GRAM))
                keys, check, sizes = _words(data, offsets)
                size[first:end] = sizes
                row = np.repeat(np.arange(end - first), sizes)
                at = _find(words, keys)
                hit = (at >= 0) & (checks[at] == check) if len(words) else np.zeros(len(keys), bool)
                base[first:end] = np.bincount(row[hit], weights=word_logs[at[hit]] if len(words) else None, minlength=end - first)
                known[first:end] = np.bincount(row[hit], minlength=end - first)
                if not hit.all():
                    parts.append(rest(first + row[~hit], keys[~hit], check[~hit], WORD))
            joined = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (np.int64, np.int8, np.int64, np.int32, np.int32)]
            by = np.argsort(joined[0], kind="stable")
            bounds = np.searchsorted(joined[0][by], np.arange(rows + 1))
            fields = pa.StructArray.from_arrays([pa.array(x[by]) for x in joined[1:]], fields=list(asks.value_type))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), fields)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, (size, known, base, total)), lists], names=[*b.schema.names[:-1], "w_", "k_", "b_", "s_", "asks_"])

    kinds = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in keep)
    made = own.mapInArrow(run, f"{kinds}, w_ long, k_ long, b_ double, s_ double, asks_ array<struct<kind:tinyint,key:bigint,check:int,times:int>>")
    made = checkpoint(made).withColumn("at_", F.monotonically_increasing_id())
    asked = made.select("at_", F.explode("asks_").alias("a")).select("at_", "a.*").join(model.answers.select("kind", "key", "check", "value"), ["kind", "key", "check"])
    word, times = F.col("kind") == WORD, F.col("times")
    sums = asked.groupBy("at_").agg(
        F.sum(F.when(word, times)).alias("k2_"), F.sum(F.when(word, times * F.log10(F.col("value") + 1))).alias("b2_"), F.sum(F.when(~word, times * F.col("value"))).alias("s2_"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    tokens = F.col("w_") + 1
    return made.join(sums, "at_", "left").select(
        *keep, tokens.alias("n_tokens"), (plus("k_", "k2_") + int(model.ends > 0)).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (plus("b_", "b2_") + float(np.log10(model.ends + 1)) - tokens * float(np.log10(model.tokens + model.kinds + 1))).alias("base_score"), plus("s_", "s2_").alias("score"),
    )
