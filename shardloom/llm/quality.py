"""Quality classifier by compression.

zstandard dictionaries of several sizes are built from good and from bad labelled text.  A text is
cut into short blocks (all of it, long texts too), so that a dictionary's help outweighs what a block
tells about itself, and compressed with each.  The differences between the sizes with the bad and
with the good dictionary, normalised by the larger of the two and by the text's bytes, go through a
logistic curve fitted on labelled texts that the dictionaries did not see.

Defined results: a null or empty text has no bytes to compare and takes the calibration's score at
difference 0; a null id counts as the empty string in the fold rule; repeated rows are
scored each; with no labels, or labels of one kind only, every score is the share of label 1 (1.0
when nothing is labelled); label rows whose document is missing are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, settle, slices, text_or_empty, utf8

THRESHOLD = 0.3


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries and calibration; a few hundred KB whatever the corpus size."""

    good: tuple[bytes, ...]
    bad: tuple[bytes, ...]
    weights: tuple[float, ...]
    prior: float
    block: int
    level: int

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        x = _design(_sizes(texts, self.good, self.bad, self.block, self.level))
        return 1.0 / (1.0 + np.exp(-np.clip(x @ np.asarray(self.weights), -30, 30)))


@lru_cache(maxsize=16)
def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    ready = zstandard.ZstdCompressionDict(dictionary)
    ready.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=ready, write_content_size=False, write_checksum=False, write_dict_id=False)


def _blocks(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def _sizes(texts: list[bytes], good: tuple[bytes, ...], bad: tuple[bytes, ...], block: int, level: int) -> np.ndarray:
    """Rows of bytes, then compressed bytes with each good and its bad dictionary."""
    pairs = [[_compressor(d, level).compress for d in pair] for pair in zip(good, bad)]
    out = np.zeros((len(texts), 1 + 2 * len(pairs)))
    for i, text in enumerate(texts):
        parts = _blocks(text, block)
        out[i] = [len(text), *(sum([len(c(p)) for p in parts]) for pair in pairs for c in pair)]
    return out


def _design(sizes: np.ndarray) -> np.ndarray:
    """The normalised differences, bent at a few places so that the curve needn't be straight."""
    n = np.maximum(sizes[:, 0], 1)
    columns = [np.ones(len(sizes))]
    for k in range(1, sizes.shape[1], 2):
        g, b = sizes[:, k], sizes[:, k + 1]
        relative, share = (b - g) / np.maximum(np.maximum(g, b), 1), (b - g) / n
        columns += [relative, np.minimum(relative, 0), share, np.minimum(share, 0), np.minimum(share, 0.01)]
    return np.column_stack(columns)


def _dictionary(texts: list[bytes], size: int, block: int) -> bytes:
    samples = [p for t in texts for p in _blocks(t, block)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the raw text itself serves as content
        return b"".join(samples)[-size:] or b" "


def fit_compression_model(
    documents: DataFrame,
    labels: DataFrame,
    *,
    label: str = "quality",
    fold_modulus: int = 5,
    held_out: int = 0,
    max_per_label: int = 3000,
    max_calibration: int = 4000,
    max_label_bytes: int = 32_000_000,
    max_text_bytes: int = 500_000,
    dictionary_bytes: tuple[int, ...] = (8_192, 65_536),
    block: int = 512,
    level: int = 3,
) -> CompressionModel:
    """Fit on a bounded sample of labelled rows outside the held-out fold.

    ``max_per_label`` texts a label, first by the hash of their id, make the dictionaries;
    the next ``max_calibration`` rows of either label, in the same order, calibrate.  Only whole
    texts are taken: one of over ``max_text_bytes`` is passed over (it is scored like any other), and
    so is one that would bring its label's over ``max_label_bytes``.  The labels alone are sorted; the
    texts are met by a broadcast of the chosen ids, whose number these parameters bound.  Lengths decide
    on the driver, the fit is one task of an executor: the driver gets the model, never a text.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", fold_modulus) != held_out))
    usable = usable.groupBy("doc_id").agg(F.max(label).alias("_label"))
    prior_rows = usable.groupBy("_label").count().collect()
    counts = {r["_label"]: r["count"] for r in prior_rows}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 1.0
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = None
    for kind in (0, 1):
        part = usable.where(F.col("_label") == kind).orderBy(*order).limit(max_per_label + max_calibration)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = (
        documents.select("doc_id", text_or_empty().alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "_label")  # repeated rows count once
        .agg(F.min("text").alias("text"))
        .withColumn("_h", order[0])
        .withColumn("_n", F.octet_length("text"))
    )
    sample = settle(rows.where(F.col("_n") <= max_text_bytes).withColumn("_id", F.col("doc_id").cast("string")), "labelled")
    taken, held = [], {0: 0, 1: 0}
    for r in sorted(sample.select("_label", "_h", "_id", "_n").collect(), key=lambda r: (r["_h"], r["_id"])):
        if held[r["_label"]] + r["_n"] <= max_label_bytes:
            held[r["_label"]] += r["_n"]
            taken.append((r["_label"], r["_id"]))
    place = {x: i for i, x in enumerate(taken)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in slices(batches):
            for key, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), utf8(batch.column(2))):
                if key in place:  # all but the few that didn't fit
                    found.append((place[key], key[0], text))
        sets: dict[int, list[bytes]] = {0: [], 1: []}
        for _, kind, text in sorted(found):
            sets[kind].append(text)
        model = CompressionModel((), (), (), prior, block, level)
        if sets[0] and sets[1]:
            model = _fitted(sets, counts, prior, max_per_label, max_calibration, dictionary_bytes, block, level)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    (fitted,) = sample.select("_label", "_id", "text").coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(fitted["model"])


def _fitted(
    sets: dict[int, list[bytes]], counts: dict[int, int], prior: float, max_per_label: int, max_calibration: int, dictionary_bytes: tuple[int, ...], block: int, level: int
) -> CompressionModel:
    """The model of the texts of either label, in their order."""
    # A third of the rarer label at least goes to calibration.
    cut = {k: max(1, min(max_per_label, 2 * len(v) // 3)) for k, v in sets.items()}
    good, bad = (tuple(_dictionary(sets[kind][: cut[kind]], size, block) for size in dictionary_bytes) for kind in (1, 0))
    x, y, w = [], [], []
    for kind in (0, 1):
        rest = sets[kind][cut[kind] :][:max_calibration] or sets[kind]
        x.append(_sizes(rest, good, bad, block, level))
        y.append(np.full(len(rest), float(kind)))
        w.append(np.full(len(rest), counts[kind] / len(rest)))
    weights = _logistic(_design(np.concatenate(x)), np.concatenate(y), np.concatenate(w))
    return CompressionModel(good, bad, tuple(weights), prior, block, level)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Rows count by ``weight``, so that scores are calibrated to the labels' real shares."""
    root = weight / weight.mean()
    w = np.zeros(x.shape[1])
    penalty = 1e-2 * np.eye(x.shape[1])
    penalty[0, 0] = 1e-9
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (root * (p * (1 - p) + 1e-9))[:, None]) + penalty
        step = np.linalg.solve(hessian, x.T @ (root * (y - p)) - penalty @ w)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_quality(documents: DataFrame, model: CompressionModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row, read from the whole text alone."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = shared.value.scores(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype("int32"))], ["doc_id", "score", "predicted"])

    source = documents.select("doc_id", text_or_empty().alias("text"))
    return source.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_good(documents: DataFrame, model: CompressionModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier accepts, all columns kept as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores([(t or "").encode() for t in texts]) >= threshold)

    return documents.where(accepted(text_or_empty()))


def op1(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit_compression_model(documents, labels)
    out = score_quality(documents, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
