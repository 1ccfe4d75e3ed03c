import itertools
import random

import numpy as np
import xxhash

from shardloom.llm import simhash
from shardloom.llm.common import settled_so_far
from shardloom.llm.components import connected_components


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(fps):
    """fp -> set of all reachable."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    return {f: find(f) for f in root}


def test_components(documents, rows, nothing):
    got = simhash.op5(documents).collect()
    assert len(got) == len(rows)
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1, f"{f:016x}") for i, f in prints)
    root = components({f for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert all(r.component_id == least.get(root[int(r.fingerprint, 16)]) for r in got)
    assert simhash.op5(nothing).count() == 0


def test_anchors_lose_no_pair():
    rng = np.random.default_rng(3)
    halves = rng.integers(0, 2**32, 500).astype(np.uint64)
    for flip in range(32):
        near = halves ^ np.uint64(1 << flip)
        a = {(int(r), int(c)) for r, c in zip(*simhash.anchors(halves))}
        b = {(int(r), int(c)) for r, c in zip(*simhash.anchors(near))}
        assert {r for r, _ in a & b} == set(range(500))
    assert max(np.bincount(simhash.anchors(halves)[0])) <= 16


def test_links_in_a_crowd(spark):
    """A crowd of fingerprints about one centre: more at an anchor than are compared at once."""
    r = random.Random(1)
    fps = {0}
    while len(fps) < 3000:
        f = r.choice(list(itertools.islice(fps, 50)))
        for _ in range(r.randrange(1, 4)):
            f ^= 1 << r.randrange(64)
        fps.add(f)
    fps |= {r.getrandbits(64) for _ in range(300)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    root = components(fps)
    groups = {}
    for f in fps:
        groups.setdefault(root[f], set()).add(f)
    for hot in (simhash.HOT, 40):  # whole anchors, and large ones dealt out by pieces
        found = {x.node % (1 << 64): x.root for x in connected_components(simhash.near_links(df, hot)).collect()}
        for g in groups.values():
            assert len({found[f] for f in g}) == 1 if len(g) > 1 else next(iter(g)) not in found


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(path + star + [(7, 7), (8, 9), (9, 8)], "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(500))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(documents, rows, nothing):
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    got = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    root = components({plain_fingerprint(t) for _, t in rows})
    groups = {}
    for i, t in rows:
        groups.setdefault(root[plain_fingerprint(t)], []).append(i)
    want = sorted(min((i for i in g if i is not None), default=-1) for g in groups.values())
    assert sorted(-1 if i is None else i for i, _ in got) == want
    assert simhash.keep_one(nothing).count() == 0


def test_components_of_odd_links(spark):
    from shardloom.llm.components import connected_components

    links = [(1, 2), (2, 1), (2, 3), (5, 5), (None, 7), (9, None), (8, 7), (8, 7), (None, None)]
    got = sorted(tuple(r) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    named = connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")).collect()
    assert sorted(tuple(r) for r in named) == [("a", "a"), ("b", "a"), ("c", "a")]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_are_solved_in_one_task(spark):
    """The same components as by rounds, and no stage after the links are written but the count and the one task."""
    r = random.Random(12)
    nodes = [r.randrange(-(1 << 63), 1 << 63) for _ in range(600)]
    links = [(nodes[k], nodes[k + 1]) for k in range(200)] + [(r.choice(nodes[250:]), r.choice(nodes[250:])) for _ in range(150)] + [(nodes[3], nodes[3]), (None, nodes[0])]
    df = spark.createDataFrame(links, "a long, b long")
    plain = sorted(tuple(x) for x in connected_components(df).collect())
    since = settled_so_far()
    one = connected_components(df, few=1000)
    assert settled_so_far() - since == 2
    assert sorted(tuple(x) for x in one.collect()) == plain
    assert sorted(tuple(x) for x in connected_components(df, few=10).collect()) == plain
    assert connected_components(df.where("a IS NULL"), few=10).count() == 0
