"""Benchmark decontamination: Wu-Manber search for many word windows at once.

Texts become lower-case words between single spaces. Every run of ``n`` words of a benchmark
item (or the whole of a shorter item) is a test string, with a space on either side. For test
strings of similar length, a table tells by the last block of the search window how far the
window can move without missing one; where it can't, the block's bucket lists the test strings
that end so, and direct comparison decides.

Test strings are broadcast in parts of about ``part_bytes``: a benchmark of usual size is one part and the
search one map-only stage. A larger one takes a pass over the texts a part; a pass gives only
what was hit, once for each different text, and these meet the documents in one join.

Null or wordless texts and items match nothing; items without id take no part, repeated ones count
once. Repeated documents come out once each, empty tables give none. Texts are taken whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, fresh, text_slices

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SPANS = "array<struct<first:bigint,last:bigint>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def spaced(text: bytes, piece: int = 1 << 20) -> bytes:
    """The words of a text between single spaces; a long text's in pieces, so their list stays short."""
    parts, first = [], 0
    while first < len(text):
        end = first + piece
        while end < len(text) and _WORDS[text[end]] != 32:
            end += 1
        parts += [x] if (x := b" ".join(words_of(text[first:end]))) else []
        first = end
    return b" %b " % b" ".join(parts) if parts else b""


class WuManber:
    """Test strings, grouped so that within a group the longest is at most about twice the shortest."""

    def __init__(self, strings: list[bytes]):
        groups: dict[int, list[bytes]] = {}
        for s in strings:
            groups.setdefault(min(len(s).bit_length(), 7), []).append(s)
        self.groups = [self._tables(g) for g in groups.values()]

    @staticmethod
    def _tables(strings: list[bytes]) -> tuple[int, int, dict[bytes, int], dict[bytes, list[bytes]]]:
        reach = min(map(len, strings))
        block = max(1, min(12, reach // 3))
        shift: dict[bytes, int] = {}
        buckets: dict[bytes, list[bytes]] = {}
        far = reach - block + 1
        for s in sorted(set(strings)):
            for end in range(block, reach + 1):
                b = s[end - block : end]
                if reach - end < shift.get(b, far):
                    shift[b] = reach - end
            buckets.setdefault(s[reach - block : reach], []).append(s)
        return reach, block, shift, buckets

    def find(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(where it begins, test string) of every occurrence."""
        size = len(text)
        for reach, block, shift, buckets in self.groups:
            far, get, end = reach - block + 1, shift.get, reach
            while end <= size:
                step = get(text[end - block : end], far)
                if step:
                    end += step
                    continue
                for s in buckets[text[end - block : end]]:
                    if text.startswith(s, end - reach):
                        yield end - reach, s
                end += 1


def test_strings(benchmark: DataFrame, n: int) -> DataFrame:
    """(window, item_id) for every window of every item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in text_slices(b.column(1)):
                out: dict[str, list] = {"window": [], "item_id": []}
                raw = data.tobytes()
                for k in range(end - first):
                    w = words_of(raw[offsets[k] : offsets[k + 1]])
                    found = {b" %b " % b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
                    out["window"] += found
                    out["item_id"] += [b.column(0)[first + k].as_py()] * len(found)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("window", pa.binary()), ("item_id", pa.string())]))

    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    return items.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "window binary, item_id string").distinct()


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_built: dict[str, WuManber] = {}


def _search(token: str, items: dict[bytes, list[str]]) -> WuManber:
    """The tables of one part, built once in a Python worker; only the last part's are kept."""
    if token not in _built:
        _built.clear()
        _built[token] = WuManber(list(items))
    return _built[token]


def occurrences(text: bytes, search: WuManber, items: dict[bytes, list[str]]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words, spans of words, ids of items) for one text."""
    text = spaced(text)
    own, ids, at, word = [], set(), 0, 0
    for begin, s in search.find(text):
        if begin < at:
            at = word = 0
        word += text.count(b" ", at, begin)
        at = begin
        own.append((word, word + s.count(b" ") - 1))
        ids.update(items[s])
    return max(text.count(b" ") - 1, 0), own, ids


def _part(windows: DataFrame, parts: int, k: int):
    """A broadcast of (token, {window: ids of items}) for one part of the windows."""
    items: dict[bytes, list[str]] = {}
    for r in windows.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(parts)) == k).toLocalIterator():
        items.setdefault(bytes(r["window"]), []).append(r["item_id"])
    return windows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))


def _scanned(docs: DataFrame, shared, names: tuple[str, str, str], hits_only: bool) -> DataFrame:
    """docs with words, spans and items of one part's windows; docs' last column is the text."""
    kinds = T.StructType([*docs.schema.fields[:-1], *([] if hits_only else docs.schema.fields[-1:]), T.StructField(names[0], T.LongType())])
    kinds = kinds.add(names[1], T.ArrayType(T.StructType().add("first", T.LongType()).add("last", T.LongType()))).add(names[2], T.ArrayType(T.StringType()))
    lists = [pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, items = shared.value
        search = _search(token, items)
        for b in batches:
            if not b.num_rows:
                continue
            spans, found, count = [], [], np.zeros(b.num_rows, np.int64)
            for first, end, data, offsets in text_slices(b.column(b.num_columns - 1)):
                raw = data.tobytes()
                for k in range(end - first):
                    count[first + k], own, ids = occurrences(raw[offsets[k] : offsets[k + 1]], search, items)
                    spans.append([{"first": x, "last": y} for x, y in _merge(own)])
                    found.append(sorted(ids))
            out = pa.RecordBatch.from_arrays([*(b.columns[:-1] if hits_only else b.columns), pa.array(count), *map(pa.array, (spans, found), lists)], names=kinds.names)
            yield out.filter(pa.array([bool(x) for x in spans])) if hits_only else out

    return docs.mapInArrow(run, kinds)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, part_bytes: int = 16 << 20, names: tuple[str, str, str] = ("n_words", "contaminated_spans", "contaminated_items")) -> DataFrame:
    """docs with the words, contaminated spans (word positions, last exclusive) and contaminated items (sorted) of each text.

    Columns of docs that are named like these are replaced; ``names`` gives other names.
    """
    windows = test_strings(benchmark, n)
    parts = max(1, -(-(windows.agg(F.sum(F.length("window") + F.length("item_id"))).first()[0] or 0) // part_bytes))
    docs = docs.drop(*names)
    rest = [c for c in docs.columns if c != "text"]
    if parts == 1:
        return _scanned(docs.select(*rest, "text"), _part(windows, 1, 0), names, False).select(*docs.columns, *names)

    windows, (key, check) = checkpoint(windows), fresh(docs.withColumns({c: F.lit(0) for c in names}), "key", "check")
    keys = {key: F.xxhash64(F.coalesce("text", F.lit(""))), check: F.xxhash64(F.lit(7), F.coalesce("text", F.lit("")))}
    texts, hits = docs.select("text").withColumns(keys).select(key, check, "text"), None
    for k in range(parts):
        own = _scanned(texts, _part(windows, parts, k), names, True).groupBy(key, check).agg(F.any_value(names[1]).alias(names[1]), F.any_value(names[2]).alias(names[2]))
        own = checkpoint(own)
        hits = own if hits is None else hits.unionByName(own)
    hits = hits.groupBy(key, check).agg(F.flatten(F.collect_list(names[1])).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(names[2])))).alias(names[2]))
    step = lambda done, s: F.when(
        (F.size(done) > 0) & (s["first"] <= F.element_at(done, -1)["last"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], s["last"]).alias("last")))),
    ).otherwise(F.concat(done, F.array(s)))
    hits = hits.select(key, check, F.aggregate(F.array_sort("spans"), F.array().cast(SPANS), step).alias(names[1]), names[2])
    counted = _scanned(docs.select(*rest, "text"), docs.sparkSession.sparkContext.broadcast(("", {})), names, False).drop(names[1], names[2]).withColumns(keys)
    joined = counted.join(hits, [key, check], "left")
    return joined.withColumns({names[1]: F.coalesce(names[1], F.array().cast(SPANS)), names[2]: F.coalesce(names[2], F.array().cast("array<string>"))}).select(*docs.columns, *names)
