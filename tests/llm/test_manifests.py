"""Alignment of tokenizers, Merkle manifests and licence scans against plain versions."""

import hashlib
import os
import time
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cratelog.llm import alignment, licenses, merkle
from cratelog.llm import queries as llm

from . import plain
from .test_edges import folder  # noqa: F401

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def tokens():
    """Token (id, bytes) lists of both tokenizers, by the libraries' own means."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain_bytes = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in plain_bytes} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain_bytes)}

    def both(text):
        one = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        return one, two

    return both


def plain_groups(text, tokens):
    """[(A ids, B ids)] or none, found by walking both lists of ends."""
    if not text:
        return []
    a, b = tokens(text)
    want = b" " + text.encode()
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return []
    groups, k, m, i, j = [], 0, 0, 0, 0
    at_a = at_b = 0
    while i < len(a):
        at_a += len(a[i][1])
        i += 1
        while at_b < at_a:
            at_b += len(b[j][1])
            j += 1
        if at_a == at_b:
            groups.append(([x for x, _ in a[k:i]], [x for x, _ in b[m:j]]))
            k, m = i, j
    return groups


def plain_alignment(docs, tokens):
    each = [(key, plain_groups(text, tokens)) for key, text in docs]
    n = Counter((g[0][-1], g[1][-1]) for _, groups in each for g in groups)
    top = {}
    for (_, b), k in n.items():
        top[b] = max(top.get(b, 0), k)
    out = Counter()
    for key, groups in each:
        linked = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(n[x] == top[x[1]] for x in linked)
        out[(key, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(linked), best, sum(n[x] for x in linked), sha(text) if text else "")] += 1
    return out


TEXTS = ["a▁b", "▁", "<s> </s> <unk> <0x41>", "<|endoftext|>", "日本語 ☃ é é ﬁ", "  two  spaces ", "\x00\x01", "tab\tand\r\nline\n", " ", "x" * 3000, "naïve — “quoted”", "1234567890 3.14", "\U0001f600\U0001f468‍\U0001f469"]


def test_alignment(spark, folder, tokens):  # noqa: F811
    assert Counter(map(tuple, llm.queries()["op11_alignment"](spark, folder[0]).collect())) == plain_alignment(folder[1], tokens)


@pytest.mark.parametrize("head", [0, 5, 1 << 18])
def test_alignment_of_odd_texts(spark, tokens, head):
    """Whatever part of the counts is broadcast, the result is the same; a column of a name used inside goes along."""
    rows = [(k, t) for k, t in enumerate([*TEXTS, None, "", TEXTS[2], TEXTS[2]])]
    docs = spark.createDataFrame([(k, t, "r") for k, t in rows], "doc_id int, text string, row string")
    got = alignment.score(docs, ("doc_id", "row"), alignment.AlignParams(head_pairs=head))
    assert got.columns[:2] == ["doc_id", "row"] and {r.row for r in got.collect()} == {"r"}
    assert Counter(map(tuple, got.drop("row").collect())) == plain_alignment(rows, tokens)
    groups = {r.doc_id: r.groups for r in alignment.align(docs).collect()}
    assert groups[0] == groups[1] == "" and all(groups[k] for k in range(2, len(TEXTS)))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab <>0x|▁é日\n\t'.", max_size=40))
def test_alignment_of_any_text(tokens, text):
    import numpy as np

    a, b = alignment.byte_level("byte_bpe_50k.json"), alignment.pieces_of("piece_bpe_32k.model")
    want = plain_groups(text, tokens)
    if not want:
        return
    x, y = np.array(a.encode(text)), np.array(b.encode(text))
    n_a, n_b = alignment.token_groups(np.cumsum(a.size[x]), np.cumsum(b.size[y]))
    assert [(len(p), len(q)) for p, q in want] == list(zip(n_a.tolist(), n_b.tolist(), strict=True))
    assert alignment.group_text(a, b, x, y, n_a, n_b).decode() == ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in want)


def test_labels():
    import numpy as np

    assert alignment.labels(np.array([2, 3, 6]), np.array([1, 3, 4, 6]), 6) == b"baxb.x"


def test_groups_cost_less_than_tokens():
    """Telling groups and writing their text takes less than half the time of tokenizing."""
    import numpy as np
    import pyarrow.parquet as pq

    a, b = alignment.byte_level("byte_bpe_50k.json"), alignment.pieces_of("piece_bpe_32k.model")
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if t and "▁" not in t]
    at = time.process_time()
    ids = [(np.array(a.encode(t)), np.array(b.encode(t))) for t in texts]
    tokenized = time.process_time() - at
    ids = [(x, y) for x, y in ids if a.size[x].sum() == b.size[y].sum()]
    at = time.process_time()
    for x, y in ids:
        alignment.group_text(a, b, x, y, *alignment.token_groups(np.cumsum(a.size[x]), np.cumsum(b.size[y])))
    assert len(ids) > 0.9 * len(texts) and time.process_time() - at < tokenized / 2


def plain_tree(nodes):
    """(the node that remains, for each node its steps: place and the others)."""
    steps = [[] for _ in nodes]
    under = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [list(range(k, min(k + 3, len(nodes)))) for k in range(0, len(nodes), 3)]
        for run in runs:
            for k in run:
                for x in under[k]:
                    steps[x].append((k - run[0], [nodes[m] for m in run if m != k]))
        nodes, under = [sha("".join(nodes[k] for k in run)) for run in runs], [[x for k in run for x in under[k]] for run in runs]
    return nodes[0], steps


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: plain_tree([leaf(r) for r in groups[s]]) for s in order}
    root, upper = plain_tree([trees[s][0] for s in order])
    out = Counter()
    for s, above in zip(order, upper, strict=True):
        for r, own in zip(groups[s], trees[s][1], strict=True):
            steps = own + above
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf((*r[:4], r[4].replace("\n", "") if hit and r[4] is not None else r[4]))
            for place, others in steps:
                h = sha("".join([*others[:place], h, *others[place:]]))
            out[(r[0], leaf(r), trees[s][0], root, sha("".join(x for _, o in steps for x in o)), h, h == root)] += 1
    return out


def test_merkle(spark, folder, same_as_duckdb):  # noqa: F811
    rows = [tuple(r) for r in spark.read.parquet(f"{folder[0]}/documents.parquet").select(*merkle.FIELDS).collect()]
    got = llm.queries()["op12_merkle"](spark, folder[0])
    want = plain_manifest(rows)
    assert Counter(map(tuple, got.collect())) == want
    assert {k[-1] for k in want} == {True, False}
    same_as_duckdb(got, llm.oracle_sql()["op12_merkle"], folder[0])


@pytest.mark.parametrize("sizes", [[1], [1, 1, 1, 1], [3, 9, 10, 27, 28], [82, 1, 2]])
@pytest.mark.parametrize("levels", [1, 2, 7])
def test_trees_of_any_size(spark, sizes, levels):
    """Blocks and passes of any size give the proofs of a plain tree, and the store goes with remove."""
    rows = [(k, f"s{g}" if g else None, None, k, f"text {k}") for g, n in enumerate(sizes) for k in range(n)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, source string, lang string, n_chars int, text string, tree int").repartition(3)
    made = merkle.build(spark, docs, p=merkle.MerkleParams(levels=levels), extra={"level": F.col("tree")})
    got = made.proofs().withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps"))).withColumn("proof", F.sha2(merkle.siblings(F.col("steps")).cast("binary"), 256)).collect()
    want = Counter((r[0], r[1], r[2], r[3], r[4]) for r in plain_manifest(rows).elements())
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got) == want
    assert all(r.folded == r.root and r.level == 1 for r in got)
    assert made.root == got[0].root and os.path.exists(made.folder)
    made.remove()
    assert not os.path.exists(made.folder)


def test_manifest_of_nothing(spark):
    made = merkle.build(spark, spark.createDataFrame([], "doc_id int, source string, lang string, n_chars int, text string"))
    assert made.root is None and made.proofs().count() == 0


LICENSED = [
    "Released under the MIT License.", "the MIT\n\nLICENSE mit license", "MIT-License: mit", "Apache  License, Version 2.0", "GNU General Public License, version 3.", "license mit", None, "", "mit", "x GNU Affero General Public License y",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "permission is hereby granted free of charge to anyone who deals in the software", "Licensed under CC BY-NC 4.0.", "deal under CC BY 4.0", "mit license " * 3000, "mit " * 5000 + "license", "public license general public license public license", "by nc 4 0", "CC0 1.0",
]


def plain_licenses(text):
    w, places = plain.WORDS.findall(plain.fold(text)), []
    for t in licenses.templates():
        for d in range(-t.must[0], len(w) - t.must[0]):
            there = [0 <= d + i < len(w) and w[d + i] == x for i, x in enumerate(t.words)]
            if all(there[i] for i in t.must):
                places.append((d + t.must[0], t.label, t.base, sum(there) / len(there)))
    base = [p for p in places if p[2]]
    names = lambda x: ",".join(sorted({p[1] for p in x}))
    return len(w), len(base), min(base)[0] if base else None, max(base)[0] if base else None, names(base), names(places), max((p[3] for p in places), default=0.0)


def test_licenses(spark):
    docs = spark.createDataFrame([(k % 7, t, "w", k) for k, t in enumerate(LICENSED)], "doc_id int, text string, words string, hits int")
    docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/licensed/documents.parquet")
    got = llm.queries()["op13_licenses"](spark, os.path.dirname(path)).collect()
    want = Counter((k % 7, *plain_licenses(t)) for k, t in enumerate(LICENSED))
    assert Counter(map(tuple, got)) == want
    assert {x for k in want for x in k[-2].split(",")} >= {"mit", "apache-2.0", "gpl", "gpl-3.0", "agpl", "cc-by-nc", "cc-by", "cc0"}
    rows = licenses.scan(docs, licenses.index(docs))
    assert rows.columns == ["doc_id", "text", "words", "hits", "n_words", "places"] and {r.words for r in rows.collect()} == {"w"}


def test_licenses_of_edges(spark, folder):  # noqa: F811
    got = llm.queries()["op13_licenses"](spark, folder[0]).collect()
    assert Counter(map(tuple, got)) == Counter((k, *plain_licenses(t)) for k, t in folder[1])


def test_any_index_finds_the_same(spark):
    """Which words are rare changes no place."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(LICENSED)], "doc_id int, text string")
    first = licenses.scan(docs, licenses.index(docs)).collect()
    common = spark.createDataFrame([(0, "permission free granted software mit gpl by nc general affero redistribution")] * 3, "doc_id int, text string")
    assert licenses.index(common).postings != licenses.index(docs).postings
    assert licenses.scan(docs, licenses.index(common)).collect() == first


def test_no_python_in_the_licence_scan(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id int, text string")
    plan = licenses.scan(docs, licenses.index(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_faulty_templates():
    with pytest.raises(ValueError, match="not in the notice"):
        licenses.templates([("x", "a b c", ["c d"])])
    with pytest.raises(ValueError, match="fewer than"):
        licenses.templates([("x", "a b c", ["c"])])


