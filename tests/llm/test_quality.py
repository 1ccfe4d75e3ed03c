import random
import zlib

import numpy as np
import zstandard

from shardloom.llm import quality
from shardloom.llm.quality import THRESHOLD, fit_compression_model, keep_good, op1, score_quality


def labelled(spark, n=400):
    r = random.Random(3)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randrange(2, 9))) for _ in range(500)]
    good = lambda: " ".join(r.choices(words, k=80)) + "."
    bad = lambda: " ".join(w.upper() + r.choice(["!!", "###", "$$$"]) for w in r.choices(words, k=80))
    docs = [(i, bad() if i % 4 == 0 else good()) for i in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in op1(docs, labels).collect()}
    assert len(got) == 400
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= THRESHOLD) for i, r in got.items())
    held = [(r.predicted, int(i % 4 != 0)) for i, r in got.items() if r.held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_held_out_labels_are_not_read(spark):
    docs, labels = labelled(spark, 200)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert fit_compression_model(docs, labels) == fit_compression_model(docs, flipped)


def test_odd_rows(spark, documents, nothing):
    _, labels = labelled(spark, 120)
    odd = labels.unionByName(spark.createDataFrame([(None, 1, None), (5, None, None), (999_999, 0, 1), (3, 1, 0), (3, 1, 0)], labels.schema))
    out = op1(documents, odd)
    assert out.count() == documents.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    model = fit_compression_model(documents, odd)
    kept = keep_good(documents, model)
    assert kept.columns == documents.columns
    assert kept.count() == score_quality(documents, model).where("predicted = 1").count()
    assert op1(nothing, odd).count() == 0 and keep_good(nothing, model).count() == 0


def test_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in op1(documents, none).collect()} == {1.0}
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert {r.score for r in op1(documents, one).collect()} == {1.0}


def test_scores_by_plain_compression(spark):
    """Scores again from the dictionaries and weights, with compressors made afresh."""
    docs, labels = labelled(spark, 200)
    model = fit_compression_model(docs, labels)
    texts = {r.doc_id: r.text.encode() for r in docs.collect()} | {1000: b"", 1001: b"x" * 5000}
    more = docs.unionByName(spark.createDataFrame([(1000, None), (1001, "x" * 5000)], docs.schema))

    def size(text, dictionary):
        c = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(text[i : i + model.block])) for i in range(0, len(text), model.block))

    for r in score_quality(more, model).collect():
        text, x = texts[r.doc_id], [1.0]
        for g, b in ((size(text, good), size(text, bad)) for good, bad in zip(model.good, model.bad)):
            relative, share = (b - g) / max(g, b, 1), (b - g) / max(len(text), 1)
            x += [relative, min(relative, 0), share, min(share, 0), min(share, 0.01)]
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(np.dot(x, model.weights), -30, 30)))) < 1e-9


def test_a_huge_labelled_text_is_passed_over(spark):
    docs, labels = labelled(spark, 200)
    huge = docs.unionByName(spark.createDataFrame([(i, "noise " * 3000) for i in range(5000, 5040)], docs.schema))
    marked = labels.unionByName(spark.createDataFrame([(i, i % 2, 0) for i in range(5000, 5040)], labels.schema))
    plain = fit_compression_model(docs, labels)
    for limits in ({"max_text_bytes": 10_000}, {"max_text_bytes": 10_000, "max_label_bytes": 60_000}, {"max_label_bytes": 60_000}):
        model = fit_compression_model(huge, marked, **limits)
        assert model.weights and model.good and model.bad
    assert fit_compression_model(huge, marked, max_text_bytes=10_000).good == plain.good


def test_no_text_reaches_the_driver(spark, monkeypatch):
    """Dictionaries and calibration are made by an executor's task."""
    docs, labels = labelled(spark, 200)
    plain = fit_compression_model(docs, labels)
    assert plain.weights and len(plain.good) == 2

    def here(*_):
        raise AssertionError("the fit ran on the driver")

    for name in ("_dictionary", "_sizes"):
        monkeypatch.setattr(quality, name, here)
    assert fit_compression_model(docs, labels) == plain
