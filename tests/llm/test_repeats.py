import hashlib
import random
from collections import Counter

import numpy as np

from shardloom.llm import repeats


def plain(rows):
    texts = [(i, t.encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + 35]) for _, w in texts for k in range(len(w) - 34))
    out = Counter()
    for i, w in texts:
        gone = np.zeros(len(w) + 1, int)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k] += 1
                gone[k + 35] -= 1
        covered = np.cumsum(gone)[:-1] > 0
        out[i, len(w), int(covered.sum()), hashlib.sha256(b" ".join(x for x, c in zip(w, covered) if not c)).hexdigest()] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in repeats.op7(df).collect())


def test_odd_rows(documents, rows, nothing):
    assert found(documents) == plain(rows)
    assert repeats.op7(nothing).count() == 0


def test_edges(spark):
    w = [f"w{i}" for i in range(300)]
    join = lambda *x: " ".join(sum(x, []))
    rows = [(1, join(w[:60])), (1, join(w[:60])), (2, join(["x"] * 80)), (3, join(w[99:133])), (4, join(w[99:134])), (5, join(w[98:200])), (6, join(w[210:250], w[210:250])), (7, join(w[250:284], ["q"], w[250:284]))]
    rows += [(100 + i, join([f"u{i}_{k}" for k in range(30)], w[120:180], [f"v{i}_{k}" for k in range(30)])) for i in range(120)]
    rows += [(-(1 << 63), join(w[98:140]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == plain(rows)
    for crowd in (0, 1, 50):  # anchors of more occurrences are split, every window by itself
        got = repeats.remove_repeats(df, crowd).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got) == plain(rows)


def test_automaton_counts(spark):
    r = random.Random(5)
    for _ in range(200):
        texts = Counter(tuple(r.choices([b"a", b"b", b"c"], k=r.randrange(1, 12))) for _ in range(r.randrange(1, 5)))
        least = r.randrange(1, 4)
        a, seen = repeats.Automaton(), Counter()
        for t, weight in texts.items():
            a.add(list(t), weight)
            for k in range(len(t) - least + 1):
                seen[t[k : k + least]] += weight
        a.finish()
        for t in texts:
            assert a.repeated(list(t), least) == [k for k in range(len(t) - least + 1) if seen[t[k : k + least]] > 1]


def test_every_window_has_one_anchor():
    r = random.Random(6)
    words = [r.choice([b"a", b"bb", b"ccc", b"dd"]) for _ in range(70_000)]
    fp, place, first, n = repeats.anchors(repeats._Sums(words))
    assert first[0] == 0 and (first[1:] == first[:-1] + n[:-1]).all() and first[-1] + n[-1] == len(words) - 34
    assert (place >= first + n - 1).all() and (place <= first + 27).all()


def test_one_passage_in_every_document_and_text_ids(spark):
    """Most rows quote one passage, a third of them are one text, and ids are no numbers."""
    r = random.Random(8)
    own = lambda n: [f"{r.random():.12f}" for _ in range(n)]
    passage = own(90)
    rows = [(f"d{i}", " ".join(own(r.randrange(40)) + passage[r.randrange(5) :] + own(r.randrange(40)))) for i in range(300)]
    rows += [("copy", " ".join(own(20) * 1 + passage))] * 1 + [(f"c{i}", "same " + " ".join(passage)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(6)
    assert found(df) == plain(rows)
    got = repeats.remove_repeats(df, 20).collect()
    assert Counter((x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.kept).hexdigest()) for x in got) == plain(rows)
