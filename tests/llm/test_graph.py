"""Compaction of the graph of repeated pieces."""

from cratelog.llm import debruijn


def plain_paths(arcs):
    """The first arc of the path of each arc that is on no circle."""
    into, out = {}, {}
    for i, u, v, *_ in arcs:
        out.setdefault(u, []).append(i)
        into.setdefault(v, []).append(i)
    prev = {out[n][0]: into[n][0] for n in out if len(out[n]) == 1 and len(into.get(n, [])) == 1 and out[n] != into[n]}
    found = {}
    for i, *_ in arcs:
        at, seen = i, {i}
        while at in prev and prev[at] not in seen:
            at = prev[at]
            seen.add(at)
        if at not in prev:
            found[i] = at
    return found


def test_paths(spark):
    arcs = [(i, i, i + 1, 1, 0, 10 * i) for i in range(20)]  # a path that lies in one source
    arcs += [(100 + i, 100 + i, 101 + i, 50 + i, 0, 0) for i in range(37)]  # a path of arcs from as many sources
    arcs += [(200 + i, 200 + i, 201 + i, 7, 0, i) for i in range(4)] + [(210, 202, 290, 8, 0, 0), (211, 291, 203, 8, 0, 5)]  # arcs that branch off and join
    arcs += [(300 + i, 300 + i, 300 + (i + 1) % 3, 90 + i, 0, 0) for i in range(3)] + [(310, 310, 310, 99, 0, 0)]  # circles
    arcs += [(400 + i, 400 + i, 400 + (i + 1) % 4, 95, 0, i) for i in range(4)]  # a circle within one source
    frame = spark.createDataFrame(arcs, "id long, u long, v long, k long, c int, pos int")
    got = {r.id: r.path for r in debruijn.compacted(frame).collect()}
    want = plain_paths(arcs)
    assert set(got) == {a[0] for a in arcs} and len(want) == 64
    assert {k: got[k] for k in want} == want
    assert {got[i] for i in range(300, 303)} == {300} and got[310] == 310 and {got[i] for i in range(400, 404)} == {400}  # one number a circle


def test_a_path_is_one_span(spark):
    """A passage that two texts share is one path and one span in each; without compaction it would be a span for each piece. The tables it came from are gone."""
    import os
    import random

    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    passage = words(400)
    docs = spark.createDataFrame([(1, f"{words(50)} {passage} {words(60)}"), (2, f"{passage} {words(10)}"), (3, words(300))], "doc_id int, text string")
    folder = spark.conf.get("spark.checkpoint.dir")
    got = {r.doc_id: r for r in debruijn.mark(docs, with_text=True).collect()}
    assert not [n for n in os.listdir(folder) if n.startswith("substrings-")]
    inner = [[s for s in got[k].repeated_spans if s.path is not None] for k in (1, 2)]
    assert [len(x) for x in inner] == [1, 1] and inner[0][0].path == inner[1][0].path
    assert inner[0][0].last - inner[0][0].first > 330 and got[1].n_removed == got[2].n_removed == 400 and got[3].n_removed == 0
    assert passage not in got[1].kept_text and len(got[2].kept_text.split()) == 10


def test_digests_that_meet_change_nothing(spark):
    """Pieces told by two bits at first: spans are compared with their source, so the result is that of whole digests."""
    import random

    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    shared = [words(90) for _ in range(6)]
    rows = [(i, " ".join([words(rng.randint(0, 40)), *rng.sample(shared, rng.randint(0, 3)), words(20)])) for i in range(30)]
    docs = spark.createDataFrame([*rows, (30, rows[0][1]), (31, None), (32, "")], "doc_id int, text string")
    plain = {r.doc_id: (r.n_removed, r.kept_sha256) for r in debruijn.mark(docs).collect()}
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in debruijn.mark(docs, digest_bits=2).collect()} == plain
    assert sum(n > 0 for n, _ in plain.values()) > 10


def test_claims_follow_a_stretch(spark):
    """Arcs that follow each other in a text and at their source are one claim; a gap, a jump or another stretch begins a new one."""
    rows = [(1, 0, p, 10, 5, 8, 0, 20, p) for p in (0, 10, 20)]  # along the stretch
    rows += [(1, 0, 50, 10, 5, 8, 0, 20, 0), (1, 0, 60, 10, 5, 8, 0, 20, 20)]  # leaves one out
    rows += [(2, 0, 7, 10, 5, 8, 0, 20, 10), (2, 0, 17, 10, 5, 9, 0, 0, 0), (2, 0, 17, 10, 5, 9, 0, 0, 0)]  # goes over to another source; a row twice
    placed = spark.createDataFrame(rows, "k long, c int, pos int, m int, path long, sk long, sc int, spos int, off int")
    import tempfile

    got = debruijn.claims(placed, 35, tempfile.mkdtemp(prefix="spark-") + "/claims")
    assert {(r.k, r.first, r.last, r.sk, r.off) for r in got.collect()} == {(1, 0, 64, 8, 0), (1, 50, 94, 8, 0), (1, 60, 104, 8, 20), (2, 7, 51, 8, 10), (2, 17, 61, 9, 0)}
