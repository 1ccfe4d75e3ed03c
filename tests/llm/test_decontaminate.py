import random

import numpy as np
import pytest

from shardloom.llm import decontaminate as d


@pytest.fixture(scope="module")
def bench():
    r = random.Random(11)
    words = ["".join(r.choices("klmnopqrst", k=r.randrange(3, 8))) for _ in range(3000)]
    return [(i, " ".join(r.choices(words, k=r.randrange(12, 50))) + ".") for i in range(60)], words


def edited(r, words, edits):
    out = list(words)
    for _ in range(edits):
        k, what = r.randrange(len(out)), r.choice("sid")
        if what == "s":
            out[k] = "other"
        elif what == "i":
            out.insert(k, "more")
        elif len(out) > 1:
            del out[k]
    return out


def plain_distance(a, text):
    """Smallest edit distance of a to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_search_is_exact():
    r = random.Random(2)
    for _ in range(300):
        a = np.array([r.randrange(4) for _ in range(r.randrange(1, 80))])
        b = np.array([r.randrange(5) for _ in range(r.randrange(0, 60))], dtype=int)
        assert d.edit_search(a, b)[0] == plain_distance(a.tolist(), b.tolist())


def test_recall_and_precision(spark, bench):
    items, words = bench
    r = random.Random(5)
    filler = lambda n: r.choices([f"f{i}" for i in range(2000)] + words[:300], k=n)
    docs, want = [], {}
    for i, text in items:
        own = text.split()
        for edits in (0, 1, int(0.1 * len(own)), int(0.2 * len(own))):
            got = edited(r, own, edits)
            docs.append((len(docs), " ".join(filler(r.randrange(0, 200)) + got + filler(r.randrange(0, 200))).upper().replace(" OTHER ", ", other; ")))
            want[len(docs) - 1] = i
    clean = [(1000 + i, " ".join(filler(150))) for i in range(100)]
    half = [(2000 + i, " ".join(filler(50) + t.split()[: len(t.split()) // 2] + filler(50))) for i, t in items]
    got = {x.doc_id: x for x in d.op6(spark.createDataFrame(docs + clean + half, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    found = sum(want[k] in got[k].item_ids for k in want)
    assert found / len(want) >= 0.97
    assert not any(got[i].contaminated for i, _ in clean + half)
    for k in want:  # what is reported is within the allowed distance
        for item, distance in zip(got[k].item_ids, got[k].distances):
            n = len(d.words_of(items[item][1].encode()))
            assert distance <= d.allowed(n)


@pytest.mark.parametrize("kind", ["s", "i", "d", "sid"])
def test_recall_of_long_items(kind):
    """Items of hundreds of words at the allowed edits, of each kind: walks over whole items lose half of them."""
    r = random.Random(21)
    words = ["".join(r.choices("klmnopqrst", k=r.randrange(3, 8))) for _ in range(3000)]
    filler = [f"f{i}" for i in range(2000)] + words[:300]
    items = [r.choices(words, k=n) for n in (61, 150, 300, 400, 700) for _ in range(6)]
    block = d.Items.of([(i, " ".join(w).encode()) for i, w in enumerate(items)])
    found = 0
    for i, own in enumerate(items):
        out = [[w] for w in own]
        for k in r.sample(range(len(own)), d.allowed(len(own))):
            what = r.choice(kind)
            out[k] = ["other"] if what == "s" else ["more", own[k]] if what == "i" else []
        text = " ".join([*r.choices(filler, k=80), *(w for part in out for w in part), *r.choices(filler, k=80)])
        got = block.search(text.encode())
        assert all(distance <= d.allowed(len(items[item])) for item, distance, *_ in got)
        found += i in [item for item, *_ in got]
    assert found / len(items) >= 0.97
    half = " ".join([*r.choices(filler, k=50), *items[20][:150], *r.choices(filler, k=50)])
    assert not block.search(half.encode())


def test_blocks_of_items_answer_alike(spark, bench):
    items, _ = bench
    docs = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    bench_df = spark.createDataFrame(items, "item_id long, text string")
    one = sorted((r.doc_id, str(r.hits)) for r in d.find_items(docs, bench_df).collect())
    many = sorted((r.doc_id, str(r.hits)) for r in d.find_items(docs, bench_df, block_bytes=2000).collect())
    assert one == many and d.drop_contaminated(docs, bench_df, block_bytes=2000).count() == 0


def test_odd_rows(spark, documents, nothing, bench):
    items = [*bench[0], (None, bench[0][0][1]), (70, None), (71, ""), (72, "..."), (73, "x y"), (73, "x y"), (74, "lone")]
    bench_df = spark.createDataFrame(items, "item_id long, text string")
    out = d.op6(documents, bench_df)
    assert out.count() == documents.count() and out.where("contaminated").count() == 0
    kept = d.drop_contaminated(documents, bench_df)
    assert kept.columns == documents.columns and kept.count() == documents.count()
    assert d.op6(nothing, bench_df).count() == 0
    assert d.op6(documents, bench_df.where("item_id = -1")).where("contaminated").count() == 0
    short = spark.createDataFrame([(1, "so x, y!"), (2, "y x"), (3, "a lone z")], "doc_id long, text string")
    assert {r.doc_id: r.item_ids for r in d.op6(short, bench_df).collect()} == {1: [73, 73], 2: [], 3: [74]}


def test_whole_result_by_brute_force(spark, bench):
    """Every pair of item and document against plain edit distance: nothing false, and hardly anything missed."""
    items, words = bench
    r = random.Random(31)
    items = items[:12]
    docs = []
    for i in range(60):
        own = items[i % 12][1].split()
        part = own[: r.randrange(len(own) // 2, len(own) + 1)]
        docs.append((i, " ".join(r.choices(words, k=r.randrange(30)) + edited(r, part, r.randrange(0, len(own) // 3)) + r.choices(words, k=r.randrange(30)))))
    got = {x.doc_id: dict(zip(x.item_ids, x.distances)) for x in d.op6(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, item): k for i, t in docs for item, text in items if (k := plain_distance(d.words_of(text.encode()), d.words_of(t.encode()))) <= d.allowed(len(d.words_of(text.encode())))}
    found = {(i, item): k for i, hits in got.items() for item, k in hits.items()}
    assert set(found) <= set(want) and all(found[x] >= want[x] for x in found)
    assert len(found) >= 0.97 * len(want) and len(want) > 15


def test_memory_of_a_very_long_item():
    """Keys and windows hold the sampled words alone, however long an item is."""
    import tracemalloc

    r = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(r.choices(words, k=100)).encode()) for i in range(500)] + [(500, " ".join(long := r.choices(words, k=20_000)).encode())]
    tracemalloc.start()
    block = d.Items.of(rows)
    hits = block.search(" ".join(long[:5000] + ["x"] + long[5000:]).encode())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [h[0] for h in hits] == [500] and peak < 150_000_000


def test_item_ids_of_any_type(spark, bench):
    items = [(f"q{i}", t) for i, t in bench[0][:5]] + [(None, "one two three four")]
    docs = spark.createDataFrame([("a", items[3][1]), (None, "zero one two three four five"), ("b", None)], "doc_id string, text string")
    got = {r.doc_id: r.item_ids for r in d.op6(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert got == {"a": ["q3"], None: [None], "b": []}
