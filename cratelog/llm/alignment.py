"""Cross-tokenizer alignment: where the tokens of two tokenizers end at the same byte, and which ids go together.

Each byte of a text gets a label: no token ends there, one of A, one of B, or one of each. A span up to
the next byte at which both end is a group, and the labels counted in it say how many tokens of A and
of B it holds. A regular expression scans the labels, those of no token left out, for the spans that
have further tokens; each other group is one token of A and one of B. The last A token and the last B
token of a group end together: a link. Groups' texts are put together from eight bytes a token.

1. One map-only pass tokenizes every text once and writes its counts, its groups' digest or text and
   its distinct linked id pairs.
2. The pairs are counted over all texts, added up in each task before the shuffle; a pair is best if
   no other A id is linked more often with its B id (at most as many rows as B has ids).
3. Each text's pairs look their counts up. The most frequent pairs, at most ``head_pairs``, are
   broadcast; the others are joined. Both come from one table, so the split changes no result.

Special tokens' strings are plain text. A is asked for a space and the text, B for the text, before
which it puts a space of its own. Null and empty texts, and those that the tokens' bytes do not spell
(B writes U+2581 for a space, so a text with that character), have no tokens. Repeated rows come out
once each and count as often; an empty table gives none; columns other than ``keep``, which holds none of the result's names, play no part. Texts are
taken whole: one needs some 60 times its size in a worker while it is handled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, one_thread, scratch, stored, text_slices, written
from .packing import byte_alphabet

NONE, A_END, B_END, BOTH = b".abx"
_LABELS = np.frombuffer(b".abx", np.uint8)
_SPAN = re.compile(rb"[ab]+x")


@dataclass(frozen=True)
class AlignParams:
    """Files of public_tokenizers. ``head_pairs`` bounds what is broadcast of the counts; it changes no result."""

    a: str = "byte_bpe_50k.json"
    b: str = "piece_bpe_32k.model"
    head_pairs: int = 1 << 18


class Vocabulary:
    """A tokenizer's ids of a text, and the bytes that they stand for."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode = encode
        self.bytes = np.array([*pieces, None], object)[:-1]
        self.size = np.array([len(x) for x in pieces], np.int64)
        if len(pieces) > 10**7:
            raise ValueError("an id and its sign must fit in eight bytes")
        self.inner, self.a_last, self.b_last = (np.array([b"%d%c" % (k, sign) for k in range(len(pieces))], "S8").view(np.uint64) for sign in (b",", b"|", b";"))

    def __len__(self) -> int:
        return len(self.size)


@cache
def byte_level(name: str) -> Vocabulary:
    """A byte-level BPE file, for a space and the text. No string in a text is a special token."""
    one_thread()
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    chars = byte_alphabet()
    pieces = [b""] * (max(model["vocab"].values()) + 1)
    for token, i in model["vocab"].items():
        pieces[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if all(model["vocab"].get(x + y) == 256 + k for k, (x, y) in enumerate(merged)):  # ids in merge order: tiktoken gives the same ids faster
        ranks = {pieces[i]: i for i in range(256 + len(merged))}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Vocabulary(lambda text: fast.encode_ordinary(" " + text), pieces)
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return Vocabulary(lambda text: slow.encode(" " + text, add_special_tokens=False).ids, pieces)


@cache
def pieces_of(name: str) -> Vocabulary:
    """A sentencepiece model, which puts a space before the text itself."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    raw = lambda k: bytes([int(model.id_to_piece(k)[3:-1], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode()
    return Vocabulary(model.encode, [raw(k) for k in range(model.get_piece_size())])


class _Counts(dict):
    """Tokens of A and of B in a span of labels, as one number; spans are few, so they are remembered, up to a bound."""

    def __missing__(self, span: bytes) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        self[span] = found = (span.count(b"a") + 1) << 32 | span.count(b"b") + 1
        return found


_counts = _Counts()


def labels(a_ends: np.ndarray, b_ends: np.ndarray, size: int) -> bytes:
    """The label of each byte."""
    kind = np.zeros(size, np.uint8)
    kind[a_ends - 1] = 1
    kind[b_ends - 1] += 2
    return _LABELS[kind].tobytes()


def token_groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B each group has; both cover the same bytes."""
    ends = labels(a_ends, b_ends, int(a_ends[-1]) if len(a_ends) else 0).translate(None, b".")
    kind = np.frombuffer(ends, np.uint8)
    both = np.flatnonzero(kind == BOTH)
    found = np.ones(len(both), np.int64) << 32 | 1
    found[(both > 0) & (kind[both - 1] != BOTH)] = np.fromiter(map(_counts.__getitem__, _SPAN.findall(ends)), np.int64)
    return found >> 32, found & 0xFFFFFFFF


def group_text(a: Vocabulary, b: Vocabulary, a_ids: np.ndarray, b_ids: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    a_stop, b_stop = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
    a_parts, b_parts = a.inner[a_ids], b.inner[b_ids]
    a_parts[a_stop], b_parts[b_stop] = a.a_last[a_ids[a_stop]], b.b_last[b_ids[b_stop]]
    parts = np.empty(len(a_ids) + len(b_ids), np.uint64)
    parts[np.arange(len(a_ids)) + np.repeat(b_stop + 1 - n_b, n_a)] = a_parts
    parts[np.arange(len(b_ids)) + np.repeat(a_stop + 1, n_b)] = b_parts
    return parts.tobytes().translate(None, b"\0")[:-1]


def align(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), p: AlignParams = AlignParams()) -> DataFrame:
    """``keep`` and, of each text: n_a, n_b, n_groups, groups (see ``group_text``), pairs (of linked ids, as A id * ids of B + B id) and pair_counts. Map-only."""
    narrow = len(byte_level(p.a)) * len(pieces_of(p.b)) < 1 << 31
    code = pa.int32() if narrow else pa.int64()
    kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(code), pa.list_(pa.int32())]
    names = ["n_a", "n_b", "n_groups", "groups", "pairs", "pair_counts"]
    long, pairs = T.LongType(), T.ArrayType(T.IntegerType() if narrow else T.LongType())
    schema = T.StructType([*docs.select(*keep).schema, *(T.StructField(n, t) for n, t in zip(names, [long, long, long, T.StringType(), pairs, T.ArrayType(T.IntegerType())], strict=True))])

    def one(a: Vocabulary, b: Vocabulary, text: str, raw: bytes) -> tuple:
        none = 0, 0, 0, "", [], []
        if not raw:
            return none
        a_ids, b_ids = (np.fromiter(found, np.int64, len(found)) for found in (a.encode(text), b.encode(text)))
        if not all(b"".join(v.bytes[i].tolist()) == b" " + raw for v, i in ((a, a_ids), (b, b_ids))):
            return none
        n_a, n_b = token_groups(np.cumsum(a.size[a_ids]), np.cumsum(b.size[b_ids]))
        linked = a_ids[np.cumsum(n_a) - 1] * len(b) + b_ids[np.cumsum(n_b) - 1]
        return len(a_ids), len(b_ids), len(n_a), group_text(a, b, a_ids, b_ids, n_a, n_b).decode(), *np.unique(linked, return_counts=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(p.a), pieces_of(p.b)
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(0)):
                raw = data.tobytes()
                each = [raw[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                columns = zip(*(one(a, b, x.decode(), x) for x in each), strict=True)
                made = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).slice(first, last - first) for k in range(len(keep))), *made], names=[*keep, *names])

    return docs.select("text", *keep).mapInArrow(run, schema)


def link_counts(aligned: DataFrame, p: AlignParams, path: str) -> DataFrame:
    """(pair, n, best) of all pairs: how many links hold it, and whether no other pair of its B id is in more. Written at a path."""
    b_id = F.col("pair") % len(pieces_of(p.b))
    n = stored(_each(aligned).groupBy("pair").agg(F.sum("k").alias("n")), path)
    top = n.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("top"))  # a row for each id of B at most
    return n.join(F.broadcast(top), b_id == F.col("b_id")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _each(aligned: DataFrame, *keep: str) -> DataFrame:
    each = aligned.select(*keep, F.explode(F.arrays_zip("pairs", "pair_counts")).alias("x"))
    return each.select(*keep, F.col("x.pairs").alias("pair"), F.col("x.pair_counts").alias("k"))


def _head_from(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most so many pairs have that count or more."""
    sizes = {r.e: r["count"] for r in counts.groupBy(F.length(F.bin("n")).alias("e")).count().collect()}  # 63 rows at most
    e, total = 64, 0
    while e > 1 and (total := total + sizes.get(e - 1, 0)) <= most:
        e -= 1
    return 1 << (e - 1)


def score(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), p: AlignParams = AlignParams()) -> DataFrame:
    """``keep``, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each text, written in the shared folder."""
    spark = docs.sparkSession
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    with scratch(spark, "alignment") as at:
        made = align(docs, keep, p).withColumn("groups_sha256", digest).drop("groups")
        (row,) = fresh(made, "row")
        made = made.withColumn(row, F.monotonically_increasing_id())
        aligned = stored(made, f"{at}/aligned")
        counts = stored(link_counts(aligned, p, f"{at}/counted"), f"{at}/counts")
        least = _head_from(counts, p.head_pairs)
        head, rest = counts.where(F.col("n") >= least), counts.where(F.col("n") < least)
        each = _each(aligned, row)
        worth = [F.sum(F.col("k") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best")]
        known = each.join(F.broadcast(head), "pair").groupBy(row).agg(*worth)
        asked = each.join(F.broadcast(head.select("pair")), "pair", "left_anti").join(rest, "pair").groupBy(row).agg(*worth)
        sums = known.unionByName(asked).groupBy(row).agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
        filled = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
        out = aligned.join(sums, row, "left").select(*keep, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *filled, "groups_sha256")
        return written(out, "alignment-result")
