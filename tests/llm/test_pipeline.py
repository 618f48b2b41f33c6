"""The pipeline against plain code, stage by stage and as a whole."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from cratelog.llm import secrets, toxicity

from . import plain

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{D}/labels.parquet").collect() if r.toxic in (0, 1)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, D).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns

    texts, y = toxicity.labelled_sample(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet"), "toxic", corpus_pipeline.F.lit(True), 6000)
    assert Counter(y) == Counter(float(labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels)
    model = toxicity.fit(texts, y)
    scores = toxicity.score_column(model, pa.array([r["text"] for r in rows]), model.dense())
    rows = [r for r, s in zip(rows, scores, strict=True) if s < 0.7]
    assert Counter(r["doc_id"] for r in rows) == Counter(r.doc_id for r in seen["toxicity"].collect())

    kept = Counter(r.doc_id for r in seen["near_dedup"].collect())
    assert set(kept.values()) == {1}
    runs = {r["doc_id"]: plain.runs(r["text"]) for r in rows}
    alike = lambda a, b: len(runs[a] & runs[b]) / max(1, len(runs[a] | runs[b])) if runs[a] or runs[b] else 1.0
    for key in runs:
        near = [o for o in runs if o != key and alike(key, o) >= 0.55]
        assert key in kept or any(o < key for o in near)  # only what has a near copy went
        assert not (key in kept and any(o in kept for o in near if alike(key, o) >= 0.86))  # of near copies one stays
    rows = [r for r in rows if r["doc_id"] in kept]

    rows = [r for r in rows if not plain.contaminated(r["text"], items)[1]]
    assert Counter(r["doc_id"] for r in rows) == Counter(r.doc_id for r in seen["decontamination"].collect())

    forest = secrets.train(secrets.labelled_findings(spark))
    found = {r.doc_id: r.findings for r in secrets.findings(seen["decontamination"], forest, "source").collect()}
    pattern = re.compile(secrets.PATTERN.replace("++-----END", "+?-----END"))
    for r in rows:
        marks = iter(found[r["doc_id"]])
        r["text"] = pattern.sub(lambda m, marks=marks: secrets.MASK if next(marks).score >= 0.5 else m[0], r["text"])
    assert {r["doc_id"]: r["text"] for r in rows} == {r.doc_id: r.text for r in seen["secret_scan"].collect()}

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows}
    got = Counter()
    for r in docs.collect():
        got[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert dict(got) == want
    assert np.all([n > 0 for n in got.values()])


def test_representatives_of_repeated_rows(spark):
    from cratelog.llm import neardup

    a, b = "one two three four five six", "seven eight nine ten eleven"
    rows = [(3, a), (3, a), (2, a), (None, a), (None, b), (None, b), (9, None), (8, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", corpus_pipeline.F.lit(1))
    got = neardup.representatives(frame)
    assert got.columns == ["doc_id", "text", "root"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(2, a), (None, b), (8, "")])


def test_run_packs_everything(spark):
    got = corpus_pipeline.run(spark, D)
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)


def _versions(r, n, changed):
    """Two texts of n words, the second with the words at some places changed."""
    words = [f"w{x}" for x in r.integers(0, 1 << 40, n)]
    other = [f"v{x}" if i in changed else x for i, x in enumerate(words)]
    return " ".join(words), " ".join(other)


def test_representatives_at_the_similarity_itself(spark):
    """304 words are 300 runs: 265 of 335 shared are 0.791, 267 of 333 are 0.802."""
    from cratelog.llm import neardup

    r, texts, links = np.random.default_rng(5), [], []
    for k in range(40):
        texts += _versions(r, 304, set(range(20, 300, 45)) if k % 2 else {20, 60, 100, 140, 180, 220, 303, 302, 301})
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id for x in neardup.representatives(frame).collect()}
    exact = lambda a, b: len(plain.runs(a) & plain.runs(b)) / len(plain.runs(a) | plain.runs(b))
    for k in range(40):
        links.append(exact(texts[2 * k], texts[2 * k + 1]))
        assert 2 * k in got
        if links[-1] < 0.8:
            assert 2 * k + 1 in got
    high = [2 * k + 1 for k, x in enumerate(links) if x >= 0.8]
    assert 0.77 < max(x for x in links if x < 0.8) and min(x for x in links if x >= 0.8) < 0.82 and len(high) == 20
    assert sum(x in got for x in high) <= 3  # the bands propose 0.95 of them by design


def test_families_are_compared_exactly(spark):
    """A family's groups are those of its exact links, whether it is one block or many."""
    from cratelog.llm import neardup

    r, texts = np.random.default_rng(6), []
    words = [f"w{x}" for x in r.integers(0, 1 << 40, 304)]
    for _ in range(60):  # a family of versions at about 0.62 to 0.9 of each other
        own = list(words)
        for i in r.choice(304, r.integers(1, 6), replace=False):
            own[i] = f"v{r.integers(1 << 40)}"
        texts.append(" ".join(own))
    sets = [plain.runs(t) for t in texts]
    alike = [[len(a & b) / len(a | b) >= 0.8 for b in sets] for a in sets]
    parent = list(range(len(texts)))
    for _ in parent:
        parent = [min(parent[j] for j in range(len(texts)) if alike[i][j]) for i in range(len(texts))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id for x in neardup.representatives(frame).collect()} == set(parent)
    assert {x.doc_id for x in neardup.representatives(frame, trie_rows=12, rows=9).collect()} == set(parent)  # cut tries, several blocks a family


def test_shared_runs():
    from cratelog.llm import neardup

    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60 if k % 3 else 3000, r.integers(0, 50))) for k in range(80)]
    got = neardup.shared_runs(np.array(list(map(len, sets))), np.concatenate(sets), dense=6)
    for i in range(80):
        assert [got[i, j] for j in range(80) if j != i] == [len(set(sets[i]) & set(sets[j])) for j in range(80) if j != i]
