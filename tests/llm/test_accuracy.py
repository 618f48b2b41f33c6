"""Held-out accuracy, and kernels against plain code."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cratelog.llm import common, decontam, packing, ppm, quality, rabitq, secrets
from cratelog.llm import queries as llm

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "label", "folder", "recall", "false"), [("op1_quality", "quality", D, 0.97, 0.15), ("op8_toxicity", "toxic", "/root/testdata/sf0.1", 0.85, 0.01)])
def test_held_out(spark, name, label, folder, recall, false):
    rows = llm.queries()[name](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("predicted", label).toPandas()
    assert rows.predicted[rows[label] == 1].mean() >= recall
    assert rows.predicted[rows[label] == 0].mean() <= false


def test_languages(spark):
    rows = llm.queries()["op5_langid"](spark, D).where("held_out").join(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.97


def test_model_beats_base(spark):
    r = llm.queries()["op6_lm_score"](spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_ppm_is_a_distribution():
    data = np.frombuffer("the cat sat on the mat, thé hat".encode() * 5, np.uint8)
    order = 3
    grams, counts = np.unique(ppm.position_grams(data, np.array([0, len(data)]), order)[0], return_counts=True)
    tables, g, n = {}, grams, counts
    for m in range(order + 1, 0, -1):
        if m <= order:
            g, at = np.unique(g & ((1 << 9 * m) - 1), return_inverse=True)
            n = np.bincount(at, weights=n).astype(np.int64)
        tables[m] = g, n
    trie = ppm.build(tables, order)
    for context in [*(grams[:40] >> 9), 0, (5 << 18) + 7]:
        p = 10 ** ppm.gram_scores(trie, (int(context) << 9) | np.arange(1, 258))
        assert abs(p.sum() - 1) < 1e-5


def test_grams_are_counted_in_bounded_memory(spark):
    """A counting task holds a bounded number of keys and hands them on in small batches, and their sums are whole."""

    class Docs:
        def __getattr__(self, _):
            return lambda *a: self

        def mapInArrow(self, run, _):
            self.run = run
            return self

    docs, rng = Docs(), np.random.default_rng(0)
    ppm.count(docs, "learn", 5)
    texts = [rng.integers(97, 123, 1 << 16, dtype=np.uint8).tobytes().decode() for _ in range(64)]
    learns = [k % 7 != 2 for k in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(learns)], names=["text", "learn"])
    sums, rows = np.zeros((3, 2), np.int64), []
    tracemalloc.start()
    for b in docs.run(iter([batch])):
        rows.append(b.num_rows)
        sums[b.column(0)[0].as_py()] += b.column(3).to_numpy().sum(), b.column(4).to_numpy().sum()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sums.tolist() == [[64 * 65537, sum(learns) * 65537], [sum(learns)] * 2, [64, sum(learns)]]
    assert max(rows) <= 1 << 16 and sum(rows) > 3_000_000
    assert most < 250e6


def test_trees_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality.fit_trees(x[:1500], y[:1500]).predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


@pytest.mark.parametrize("dim", [64, 100])
def test_codes_bound_recall(dim):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, dim)).astype(np.float32)
    turn, p, centre = rabitq.rotation(dim), rabitq.CodeParams(), np.full(dim, 0.1)
    codes, ids = rabitq.encode(x.astype(float), centre, turn), np.arange(4000)
    q = rabitq.Queries.of(ids[:20], x[:20].astype(float), centre, turn, p.bits)
    signs = np.sign((x - centre) @ turn)
    for j in range(20):  # sums of bit counts are inner products, but for the rounding that is told
        got = q.products(j, codes[0], np.bitwise_count(codes[0]).sum(axis=1, dtype=np.int64))
        assert (np.abs(got - signs @ ((x[j] - centre) @ turn)) <= q.rounding[j] + 1e-6).all()
    found = rabitq.Nearest(q, p)
    for k in range(0, 4000, 1000):
        found.add(ids[k : k + 1000], x[k : k + 1000], *(c[k : k + 1000] for c in codes))
    for j in range(20):
        d = ((x - x[j]) ** 2).sum(1)
        d[j] = np.inf
        assert found.ids[j].tolist() == np.argsort(d)[:10].tolist() and (np.diff(found.distances[j]) >= 0).all()


@settings(max_examples=60, deadline=None)
@given(st.text("ab ", max_size=80), st.lists(st.text("ab", min_size=1, max_size=6), min_size=1, max_size=6))
def test_wu_manber(text, words):
    strings = [b" %b " % w.encode() for w in words]
    body = b" %b " % b" ".join(text.encode().split())
    want = sorted({(i, s) for s in strings for i in range(len(body)) if body.startswith(s, i)})
    assert sorted(decontam.WuManber(strings).find(body)) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_words_of_slices(texts):
    for _, _, data, offsets in common.text_slices(pa.array(texts, pa.string()), 16):
        starts, ends, before = common.word_bounds(data, offsets)
        raw = data.tobytes()
        for k in range(len(offsets) - 1):
            got = [raw[a:b] for a, b in zip(starts[before[k] : before[k + 1]], ends[before[k] : before[k + 1]], strict=True)]
            assert got == raw[offsets[k] : offsets[k + 1]].split()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=14), st.booleans())
def test_cuts_are_cheapest(sizes, last):
    length, at = 16, np.concatenate([[0], np.cumsum(np.minimum(sizes, 16))])
    penalty = np.array([0.0, *[float(s % 5) for s in sizes]])
    cuts = packing.best_cuts(at, penalty, length, True)
    pad = lambda n: 0 if n & (n - 1) == 0 else length - n
    price = dict(zip(at.tolist(), penalty.tolist(), strict=True))
    cost = {0: 0.0}
    for b in at[1:].tolist():
        cost[b] = price[b] + min(cost[a] + pad(b - a) for a in cost if b - a <= length)
    assert sum(pad(b - a) + price[b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)) == pytest.approx(cost[int(at[-1])])


def test_forest_walk_and_redaction(spark):
    found = secrets.labelled_findings(spark, 2000)
    forest = secrets.train(found)
    rows = found.select(secrets.features(F.col("candidate"), F.col("left"), F.col("right"), F.col("path")).alias("x"), "is_secret").withColumn("s", secrets.forest_score(F.col("x"), forest)).toPandas()
    assert np.allclose(forest.predict(np.array(rows.x.tolist())), rows.s)
    assert ((rows.s >= 0.5) == rows.is_secret).mean() > 0.98
    import hashlib

    key = hashlib.sha1(b"k").hexdigest()
    texts = [f'the token = "{key}" and on', None, "", "plain words only", f"commit {key} fixes", "see /usr/share/long/path/to/file.txt now", f'a="{key[:20]}" b'][:6]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("findings", F.lit(1)).withColumn("x", F.lit(2))
    got = {r.doc_id: r.text for r in secrets.redact(docs, forest).collect()}
    assert got[0] == 'the token = "[SECRET]" and on'
    assert [got[k] for k in range(1, 6)] == texts[1:]
    assert zlib.crc32(b"") == 0


def test_blocks_of_queries_one_by_one(spark):
    """However many blocks there are, the plan is the same, and what was broadcast is freed."""
    rows = spark.read.parquet(f"{D}/embeddings.parquet")
    pick = llm.F.col("vec_id") % 5 == 0
    one = rabitq.search(rows, pick)
    many = rabitq.search(rows, pick, rabitq.CodeParams(queries=9))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(one) == size(many) <= 3
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
