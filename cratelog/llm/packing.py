"""Packing: order-preserving dynamic programming over document and sentence boundaries.

The documents of a partition form one stream of token ids, each document closed by an end id.
The stream is cut into windows of at most ``length`` ids. A cut after a document is free, one
after a sentence costs a little, one elsewhere costs more; a window costs its padding, and none
if it is full or a power of two long. The cheapest cuts follow from

    cost[j] = penalty[j] + min over i in reach of cost[i] + length - (at[j] - at[i])

in which cost[i] + at[i] is all that depends on i, so a monotone queue gives each minimum in
constant time; windows of a power of two are looked up beside it. The stream is solved in
blocks, and what follows a block's best last cut is carried over, so memory is bounded.

Null texts are empty: a document of the end id alone. Repeated rows are packed once each, an empty
table gives no pieces, other columns than doc_id and text play no part. A text is tokenized whole.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import one_thread, text_slices

PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class PackParams:
    tokenizer: str = "byte_bpe_50k.json"
    end_id: int = 1
    length: int = 2048
    sentence_penalty: float = 6.0
    token_penalty: float = 48.0
    spacing: int = 8
    block: int = 1 << 18


@cache
def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def encoder(name: str):
    """(text -> uint32 ids, ids that end a sentence) for a byte-level BPE file of public_tokenizers.

    The ids are those of tokenizers without special tokens added. If they follow the merge order, as
    here, tiktoken gives the same several times as fast for texts that hold no added token's string; those come from tokenizers itself.
    """
    one_thread()
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, added = whole["model"], [t["content"] for t in whole.get("added_tokens", [])]
    slow = Tokenizer.from_file(path)
    exact = lambda text: np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    chars = byte_alphabet()
    raw = {i: bytes(chars.get(c, 63) for c in token) for token, i in model["vocab"].items()}
    enders = np.zeros(max(raw) + 1, bool)
    for i, b in raw.items():
        enders[i] = b.rstrip(b" \"')").endswith((b".", b"!", b"?", b"\n"))
    merged = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    if all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(merged)):
        ranks = {raw[i]: i for i in range(256 + len(merged))}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: exact(text) if any(t in text for t in added) else np.asarray(fast.encode_ordinary(text), np.uint32), enders
    return exact, enders


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, enders: np.ndarray, p: PackParams, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts, ascending from 0, and their penalties."""
    total = len(ids)
    sentence = np.flatnonzero(enders[np.minimum(ids, len(enders) - 1)]) + 1
    if len(sentence) and p.spacing > 1:
        cell = sentence // p.spacing
        sentence = sentence[np.r_[True, cell[1:] != cell[:-1]]]
    penalty = np.full(total + 1, -1.0)
    penalty[sentence] = p.sentence_penalty
    if last:  # the stream's remainder may end in windows of a power of two
        two = [1 << k for k in range(p.length.bit_length()) if 1 << k < p.length]
        tail = {a + b + c for a in two for b in [0, *two] for c in [0, *two] if a + b + c < min(total, p.length)}
        tail = total - np.array(sorted(tail), np.int64)
        penalty[tail[penalty[tail] < 0]] = p.token_penalty
    penalty[doc_ends] = 0.0
    penalty[[0, total]] = 0.0
    at = np.flatnonzero(penalty >= 0)
    wide = np.flatnonzero(np.diff(at) > p.length // 2)
    if len(wide):  # an unbroken stretch can be cut anywhere at the price
        more = np.concatenate([np.arange(at[k] + p.length // 2, at[k + 1], p.length // 2) for k in wide])
        more = np.union1d(more, np.concatenate([at[k] + np.arange(p.length, at[k + 1] - at[k], p.length) for k in wide]))
        penalty[more.astype(np.int64)] = p.token_penalty
        at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int, last: bool) -> np.ndarray:
    """The cheapest cut positions, from 0 to the stream's end, or to the best of the last cuts if more follows."""
    n = len(at)
    exact: dict[int, list[int]] = {}
    for k in range(length.bit_length()):
        if 1 << k < length:
            want = at - (1 << k)
            found = np.searchsorted(at, want)
            for j in np.flatnonzero((want >= 0) & (at[np.minimum(found, n - 1)] == want)):
                exact.setdefault(int(j), []).append(int(found[j]))
    places, prices = at.tolist(), penalty.tolist()
    cost, back = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])
    key = [0.0] * n
    for j in range(1, n):
        here = places[j]
        while places[queue[0]] < here - length:
            queue.popleft()
        i = queue[0]
        best = key[i] + length - here
        for e in exact.get(j, ()):
            if cost[e] < best:
                best, i = cost[e], e
        cost[j], back[j] = best + prices[j], i
        key[j] = cost[j] + here
        while queue and key[queue[-1]] >= key[j]:
            queue.pop()
        queue.append(j)
    j = n - 1
    if not last:
        first = int(np.searchsorted(at, places[-1] - length, "right"))
        j = max(first, 1) + int(np.argmin(cost[max(first, 1) :]))
    cuts = [j]
    while j:
        j = back[j]
        cuts.append(j)
    return at[cuts[::-1]]


class _Stream:
    """The part of a partition's stream that is not cut yet."""

    def __init__(self, p: PackParams, enders: np.ndarray, first_sequence: int):
        self.p, self.enders, self.sequence = p, enders, first_sequence
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # doc_id, tokens of the document, tokens of it cut before, tokens here
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, len(ids), 0, len(ids)))
        self.size += len(ids)

    def cut(self, last: bool) -> dict[str, list]:
        """Pieces up to the last cut; the rest stays."""
        ids = np.concatenate(self.ids)
        sizes = np.array([d[3] for d in self.docs])
        ends = np.cumsum(sizes)
        cuts = best_cuts(*boundaries(ids, ends, self.enders, self.p, last), self.p.length, last)
        done = int(cuts[-1])
        edges = np.union1d(cuts, ends[ends < done])
        begins, lengths = edges[:-1], np.diff(edges)
        doc = np.searchsorted(ends, begins, "right")
        window = np.searchsorted(cuts, begins, "right") - 1
        doc_start = ends - sizes
        view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        out = {
            "doc_id": [self.docs[k][0] for k in doc.tolist()],
            "start": begins - doc_start[doc] + np.array([d[2] for d in self.docs])[doc],
            "length": lengths,
            "ids_crc32": [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(begins.tolist(), lengths.tolist(), strict=True)],
            "doc_tokens": np.array([d[1] for d in self.docs])[doc],
            "sequence_id": self.sequence + window,
            "offset": begins - cuts[window],
        }
        self.sequence += len(cuts) - 1
        keep = int(np.searchsorted(ends, done, "right"))
        rest = self.docs[keep:]
        if rest and (gone := done - int(doc_start[keep])) > 0:
            rest[0] = (*rest[0][:2], rest[0][2] + gone, rest[0][3] - gone)
        self.ids, self.docs, self.size = ([ids[done:].copy()] if done < len(ids) else []), rest, len(ids) - done
        return out


def pack(docs: DataFrame, p: PackParams = PackParams()) -> DataFrame:
    """The pieces of all documents, in stream order. One map-only stage; sequences don't cross partitions."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, enders = encoder(p.tokenizer)
        stream = _Stream(p, enders, TaskContext.get().partitionId() << 40)
        end = np.array([p.end_id], np.uint32)
        made = None
        for b in batches:
            keys = b.column(0)
            made = pa.schema([("doc_id", keys.type), *[(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])
            keys = keys.to_pylist()
            for first, last, data, offsets in text_slices(b.column(1)):
                raw = data.tobytes()
                for k in range(first, last):
                    text = raw[offsets[k - first] : offsets[k - first + 1]].decode()
                    stream.add(keys[k], np.concatenate([encode(text), end]))
                    if stream.size >= p.block:
                        yield pa.RecordBatch.from_pydict(stream.cut(False), made)
        if stream.size:
            yield pa.RecordBatch.from_pydict(stream.cut(True), made)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES.format(kind))
