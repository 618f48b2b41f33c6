"""The queries over tables with nulls, empty and long texts, ties, repeated rows, clashing columns, and none at all."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from cratelog.llm import queries as llm

from . import plain

rng = random.Random(4)
VOCAB = [a + b for a in ("th", "er", "on", "Ça", "ß", "no") for b in ("ing", "ed", "x", "le", "Q", "7")]
prose = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
PASSAGE = prose(60)
ITEMS = [(1, prose(25)), (2, "Two WORDS"), (10, prose(12)), (None, "no id"), (3, None), (4, "  ...  "), (10, prose(11))]


def documents():
    base = prose(300)
    rows = [(k, prose(rng.randint(1, 120))) for k in range(40)]
    rows += [(100, base), (101, base), (102, base + " end"), (103, base.replace(" ", "\n\t")), (7, base)]
    rows += [(110, None), (111, ""), (112, " \n "), (None, "short one"), (None, None), (113, "one"), (114, "one two"), (115, "ONE two THREE")]
    rows += [(120, f"{prose(10)} {PASSAGE} {prose(10)}"), (121, f"{PASSAGE} {PASSAGE}"), (122, prose(9000)), (122, rows[0][1]), (5, rows[5][1]), (5, rows[5][1])]
    rows += [(130, f"{prose(5)}, {ITEMS[0][1].upper()}! {prose(5)}"), (131, f"see two, words {ITEMS[2][1]}"), (132, "x" * 5000), (133, "<|endoftext|> two words 日本語"), (134, "a <|endoftext|>b <|endof text|>"), (135, "<|endoftext|>" * 3)]
    return rows


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("edges")
    docs = documents()
    n = len(docs)
    ids, texts = [r[0] for r in docs], [r[1] for r in docs]
    extra = {"lang": [None if k % 5 == 0 else ("en", "de")[k % 2] for k in range(n)], "source": [None if k % 3 else "src0" for k in range(n)], "n_chars": [len(t or "") for t in texts]}
    clash = {c: [float(k) for k in range(n)] for c in ("score", "held_out", "chunk", "fp", "learn", "words", "root", "contaminated_spans", "__toxicity", "x")}
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), **extra, **clash}), d / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in ITEMS], pa.int64()), "text": pa.array([t for _, t in ITEMS], pa.string()), "window": ["w"] * len(ITEMS)}), d / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([*range(40), 3, None, 999], pa.int64()), "quality": pa.array([k % 2 for k in range(40)] + [None, 1, 0], pa.int32()), "toxic": pa.array([int(k % 3 == 0) for k in range(43)], pa.int32())}), d / "labels.parquet")
    r = np.random.default_rng(2)
    vectors = [r.normal(size=8).astype(np.float32).tolist() for _ in range(250)]
    vectors[20:60] = [vectors[0]] * 40
    vectors += [None, [0.0] * 8, [None, *[1.0] * 7], [float("nan"), *[1.0] * 7], [float("inf")] * 8, [1.0] * 8, [1.0] * 3]
    keys = [*range(250), 300, 400, 500, 600, 700, None, 800]
    pq.write_table(pa.table({"vec_id": pa.array(keys, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(keys), pa.int32()), "block": keys}), d / "embeddings.parquet")
    return str(d), docs, list(zip(keys, vectors, strict=True))


@pytest.fixture(scope="module")
def empty(tmp_path_factory, folder):
    d = tmp_path_factory.mktemp("empty")
    for name in ("documents", "benchmark", "labels", "embeddings"):
        pq.write_table(pq.read_table(f"{folder[0]}/{name}.parquet").slice(0, 0), d / f"{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name", list(llm.queries()))
def test_empty_tables(spark, empty, name):
    assert llm.queries()[name](spark, empty).count() == 0


def run(spark, folder, name):
    return llm.queries()[name](spark, folder).collect()


def test_decontamination(spark, folder):
    d, docs, _ = folder
    import hashlib

    want = Counter()
    for key, text in docs:
        n, hit, ids = plain.contaminated(text, ITEMS)
        want[(key, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0)] += 1
    assert Counter(map(tuple, run(spark, d, "op3_decontaminate"))) == want
    assert sum(k[5] for k in want) >= 2


def test_decontamination_in_parts(spark, folder):
    from cratelog.llm import decontam

    docs, items = (spark.read.parquet(f"{folder[0]}/{n}.parquet").select(*c) for n, c in (("documents", ("doc_id", "text")), ("benchmark", ("item_id", "text"))))
    pick = lambda df: Counter((r.doc_id, tuple(map(tuple, r.contaminated_spans)), tuple(r.contaminated_items)) for r in df.collect())
    assert pick(decontam.scan(docs, items)) == pick(decontam.scan(docs, items, part_bytes=500))


def test_simhash(spark, folder):
    d, docs, _ = folder
    prints = [plain.fingerprint(t) for _, t in docs]
    roots = plain.components(prints)
    least = {}
    for (key, _), r in zip(docs, roots, strict=True):
        if key is not None:
            least[r] = min(least.get(r, key), key)
    want = Counter((key, f"{p:016x}", least.get(r)) for (key, _), p, r in zip(docs, prints, roots, strict=True))
    assert Counter(map(tuple, run(spark, d, "op7_simhash"))) == want


def test_split_tries_link_alike(spark):
    from cratelog.llm import simhash

    r = np.random.default_rng(0)
    centre = int(r.integers(1 << 62))
    prints = {centre ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), replace=False)) for _ in range(400)}
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    ordered = sorted(prints)
    roots = plain.components(ordered)
    for rows in (50_000, 20):
        found = simhash.components(simhash.links(frame, 2, trie_rows=rows)).collect()
        label = {x.node % (1 << 64): x.root for x in found}
        groups = Counter(label.get(p, p) for p in ordered)
        assert sorted(groups.values()) == sorted(Counter(roots).values())


def test_substring_dedup(spark, folder):
    d, docs, _ = folder
    want = Counter((key, *r) for (key, _), r in zip(docs, plain.without_repeats([t for _, t in docs]), strict=True))
    assert Counter(map(tuple, run(spark, d, "op9_substring_dedup"))) == want


def test_lm_base(spark, folder):
    d, docs, _ = folder
    rows = plain.unigram([(t, plain.fold_of(k, 7) != 2) for k, t in docs])
    want = sorted(((str(k), plain.fold_of(k, 7) == 2, *r[:3], round(r[3], 6)) for (k, _), r in zip(docs, rows, strict=True)), key=str)
    got = run(spark, d, "op6_lm_score")
    assert sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    scores = plain.ppm([t for k, t in docs if plain.fold_of(k, 7) != 2], [t for _, t in docs])
    assert np.allclose(sorted(r.score for r in got), sorted(scores), rtol=1e-5)
    from cratelog.llm import ppm

    rows_in = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").withColumn("learn", ~llm.in_fold("doc_id", 7, 2))
    small = ppm.train(rows_in, "learn", ppm.PpmParams(head_grams=300, head_words=7))
    assert 0 < len(small.grams[0]) <= 300 and len(small.words[0]) <= 7
    again = ppm.score(rows_in, small).collect()  # nearly all answers come by the join
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.base_score, 6))
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert np.allclose(sorted(r.score for r in again), sorted(scores), rtol=1e-5)


def test_nearest(spark, folder):
    d, _, vectors = folder
    want = plain.nearest([v for v in vectors if v[1] is None or len(v[1]) == 8])
    got = sorted(map(tuple, run(spark, d, "op10_nearest")))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == [w[3] for w in want]
    from cratelog.llm import rabitq

    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    again = rabitq.search(rows, llm.F.col("vec_id") % 100 == 0, rabitq.CodeParams(queries=1, first=12, bits=2))  # several broadcasts, coarse bounds
    assert sorted(map(tuple, again.collect())) == got


def test_packing_round_trip(spark, folder):
    import zlib

    import public_tokenizers

    d, docs, _ = folder
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    left = Counter()
    for key, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        left[(key, ids.tobytes())] += 1
    got = run(spark, d, "op4_pack")
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 2048
    assert sum(r.length for r in got) == sum(len(k[1]) // 4 * n for k, n in left.items())
    known = Counter()
    for (key, raw), n in left.items():
        for r in got:
            if r.doc_id == key and r.doc_tokens == len(raw) // 4 and zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32:
                known[(key, r.doc_tokens, r.start, r.length)] += 1
        del n
    assert all((r.doc_id, r.doc_tokens, r.start, r.length) in known for r in got)


@pytest.mark.parametrize(("name", "folds", "fold"), [("op1_quality", 4, 2), ("op8_toxicity", 3, 1), ("op5_langid", 3, 1)])
def test_classifiers_give_every_row(spark, folder, name, folds, fold):
    d, docs, _ = folder
    got = run(spark, d, name)
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((k, plain.fold_of(k, folds) == fold) for k, _ in docs)
    assert all(0 <= r.score <= 1 for r in got)
    if name == "op5_langid":
        assert {r.lang_pred for r in got if r.doc_id in (110, 111, 112)} == {"und"}
        assert {r.lang_pred for r in got} <= {"und", "en", "de"}
    else:
        assert all(r.predicted == (r.score >= 0.7) for r in got)


KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
BLOCK = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123\n\n" + "aB3/+x9Z" * 5000 + "\n-----END RSA PRIVATE KEY-----"


def plain_features(c, left, right, path):
    """The features of a candidate by Python's own means."""
    import re

    n, near, after, low = len(c), left[-40:], right[:24], c.lower()
    share = lambda p, of=c: len(re.findall(p, of)) / n
    on = lambda p, of: float(bool(re.search(p, of)))
    from cratelog.llm import secrets as m

    kinds = re.sub("[0-9]+", "#", re.sub("[a-z]+", '"', re.sub("[A-Z]+", "!", c)))
    return [
        n, share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[^A-Za-z0-9]"), on("^([0-9a-f]+|[0-9A-F]+)$", c), len(kinds) / n, share(f"(?={m._PAIRS})", low), len(set(c)) / min(n, 64),
        1 - len(re.sub(m._WORDS, "", low)) / n, share(r"(.)\1\1"), share("/"), share(r"\."), max(on(r"(://|[/\\.@])\S{0,20}$", near), on(r"^(/|\\|@|\.[a-z]{2,4}\b)", after)), on(r"[=:]\s{0,2}[\"']?$", near),
        min(on("[\"'`]$", near), on("^[\"'`]", after)), on(m._ANNOUNCE, near), max(on(m._OTHER, near), on("example|sample|dummy|placeholder|your|xxxx", low)), on("(?i)(test|example|fixture|sample|mock|doc)", path or ""),
        on(r"^(AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abp]-|eyJ|AIza|glpat-|SG\.)", c), float(c.startswith("-----BEGIN")),
    ]


def test_secrets(spark):
    import re

    from cratelog.llm import secrets

    texts = [None, "", "plain words", f'token = "{KEY}" x', f'token = "{KEY}" x', f"commit {KEY} done", BLOCK, f"a {BLOCK} b {KEY}", "x" * 300_000, f"see /usr/lib/{KEY[:20]}/file.txt, password: {KEY[:24]}", "A" * 16, KEY]
    docs = spark.createDataFrame([(i % 7, t, "src/test.py" if i % 2 else None) for i, t in enumerate(texts)], "doc_id int, text string, source string")
    for name in ("found", "rest", "findings", "x", "score", "candidate", "FOUND_"):
        docs = docs.withColumn(name, llm.F.lit(name)) if name.lower() not in [c.lower() for c in docs.columns] else docs
    forest = secrets.train(secrets.labelled_findings(spark, 3000))
    for head, kind in (("x-h: 1\n" * 33, "RSA PRIVATE KEY"), ("x-h: 1\n" * 5000 + "\n", "PGP PRIVATE KEY BLOCK")):
        block = f"-----BEGIN {kind}-----\n{head}{'aB3/+x9Z' * 8}\n-----END {kind}-----"
        assert re.fullmatch(secrets.PATTERN, block)
        long = spark.createDataFrame([(1, f"a {block} b", "s")], "doc_id int, text string, source string")
        assert [f.candidate for f in secrets.findings(long, forest, "source", "out").first().out] == [block]
    rows = secrets.findings(docs, forest, "source", "out").collect()
    pattern, seen = re.compile(secrets.PATTERN), 0
    for r in rows:
        text, at = r.text or "", 0
        want = list(pattern.finditer(text))
        assert [m[0] for m in want] == [f.candidate for f in r.out]
        assert r.found == "found" and r.rest == "rest"
        for k, (m, f) in enumerate(zip(want, r.out, strict=True)):
            right = text[m.end() : want[k + 1].start() if k + 1 < len(want) else len(text)]
            x = np.array([plain_features(m[0], text[at : m.start()], right, r.source)])
            assert abs(forest.predict(x)[0] - f.score) < 1e-9
            at, seen = m.end(), seen + 1
    assert seen == 11
    out = secrets.redact(docs, forest, "source")
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text, r.findings) for r in out.collect())
    assert got[(3, 'token = "[SECRET]" x', "findings")] == 1 and got[(6, "[SECRET]", "findings")] == 1 and got[(5, f"commit {KEY} done", "findings")] == 1
    assert secrets.findings(docs.limit(0), forest).count() == 0


def test_secrets_of_documents(spark):
    """Findings of the documents, told by a rule of their own: what is assigned to a token is a secret, in any case of letters; training has seen none of them."""
    from cratelog.llm import secrets

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    f = secrets.findings(docs.select("doc_id", "text", "source"), secrets.train(secrets.labelled_findings(spark)), "source").select(llm.F.explode("findings").alias("f")).select("f.*")
    told = llm.F.lower("left").rlike(r"token\s*=\s*[\"']?$")
    right = f.select(told.alias("told"), (llm.F.col("score") >= 0.5).alias("said")).groupBy("told", "said").count().collect()
    n = {(r.told, r.said): r["count"] for r in right}
    assert n[(True, True)] / (n[(True, True)] + n.get((True, False), 0)) > 0.97  # recall
    assert n[(True, True)] / (n[(True, True)] + n.get((False, True), 0)) > 0.95  # precision


def test_pipeline_on_edges(spark, folder, empty):
    """All stages, and run, keep the columns of documents, whatever they are called, and every clean row."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for name in ("text_key", "text_check", "nth", "toxicity", "findings", "contaminated_items", "n_words"):
        docs = docs.withColumn(name, llm.F.lit(name))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder[0])
        if name != "packing":
            assert out.columns == docs.columns
            assert out.where("text_key <> 'text_key' OR n_words <> 'n_words' OR findings <> 'findings' OR contaminated_items <> 'contaminated_items'").count() == 0
        assert out.count() > 0
        assert stage(spark, docs.limit(0), empty).count() == 0
    assert corpus_pipeline.run(spark, folder[0]).count() > 0 and corpus_pipeline.run(spark, empty).count() == 0
