"""SimHash fingerprints and near-duplicate components by anchor points of a covering code.

Two fingerprints within two bits have a half of 32 bits in which they differ by one bit at most.
The codewords of the Hamming code of length 31 are the anchors of a half (its top bit is set
aside): the code's covering radius is 1, so every half has a *home* anchor within 1, and any half
within the threshold of 1 from it lies within 2 of that home.  Every fingerprint is replicated to
all anchors within covering radius plus threshold (at most 16 a half); fingerprints that meet at
an anchor are compared on all 64 bits.  No pair within the threshold is missed.

Copies are collapsed before any of this: only distinct fingerprints are replicated.  An anchor's
rows are compared in order of the anchor, a batch at a time, and give a few links (each
fingerprint to the smallest it meets in its linked set), not all pairs.  An anchor with very many
fingerprints is split by exact pieces of the word, of which one must be equal: within a task, or,
for the largest anchors, before the shuffle, so that they spread over tasks.

Defined results: null and empty texts have fingerprint zero and link to each other like any other
fingerprint; repeated rows are copies; a null doc_id takes part in links but is never the smallest
id, and a component of null ids only has a null component_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, slices, text_or_empty, utf8
from .components import connected_components

SEED = 42
THRESHOLD = 2
#: Beyond this many rows an anchor's fingerprints are compared by exact pieces.
SPLIT = 512
#: Within two bits one of these three pieces (shift, width) of two fingerprints is equal.
PIECES = ((0, 22), (22, 21), (43, 21))
#: An anchor of more rows is dealt out by pieces, to as many tasks; at most HOT_ANCHORS, the largest.
HOT, HOT_ANCHORS = 50_000, 10_000


def fingerprint(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """64 bits, each set in over half of the shingles' hashes; repeats count."""
    words = text.lower().split()  # lower() of bytes changes A-Z only
    if not words:
        return 0
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(flat, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
        stops = (ends - 1).tolist()
        hashes = [digest(flat[a:b], seed) for a, b in zip(starts, stops[shingle - 1 :])]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


# --- anchors -------------------------------------------------------------------------------------

_HALF = np.uint64(0xFFFFFFFF)
_LOW31 = np.uint64(0x7FFFFFFF)


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Syndrome of the low 31 bits: the exclusive or of the numbers (from 1) of the set bits."""
    out = np.zeros(len(half), np.uint64)
    for bit in range(31):
        out ^= ((half >> np.uint64(bit)) & np.uint64(1)) * np.uint64(bit + 1)
    return out


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every codeword within 2 of each half's low 31 bits.

    A codeword has no other within 2; any other word has its home at 1 and, for each pair of bits
    whose numbers' exclusive or is the syndrome, one at 2: the fifteen pairs besides the home's bit.
    """
    word, s = half & _LOW31, _syndrome(half)
    rows, found = [np.flatnonzero(s == 0)], [word[s == 0]]
    off = np.flatnonzero(s != 0)
    w, t = word[off], s[off]
    rows.append(off)
    found.append(w ^ (np.uint64(1) << (t - np.uint64(1))))
    for a in range(1, 32):
        b = t ^ np.uint64(a)
        ok = (b > np.uint64(a)) & (b <= np.uint64(31))
        rows.append(off[ok])
        found.append(w[ok] ^ np.uint64(1 << (a - 1)) ^ (np.uint64(1) << (b[ok] - np.uint64(1))))
    return np.concatenate(rows), np.concatenate(found)


def _piece_keys(anchor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that split an anchor by exact pieces of the fingerprint: three a row, one of which near ones share."""
    keys = []
    for shift, width in PIECES:
        piece = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        h = (anchor.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (piece + np.uint64(shift + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys.append((h ^ (h >> np.uint64(31))) | np.uint64(1 << 63))  # apart from whole anchors
    return np.concatenate(keys).view(np.int64), np.tile(fp, len(PIECES))


def _replicate(hot: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20_000):
            fp = batch.column(0).to_numpy().view(np.uint64)
            for side in (0, 1):
                half = (fp >> np.uint64(32 * side)) & _HALF
                rows, anchor = anchors(half)
                code, value = (anchor | np.uint64(side << 31)).astype(np.int64), fp[rows]
                if len(hot):
                    split = np.isin(code, hot)
                    keys, values = _piece_keys(code[split], value[split])
                    code, value = np.concatenate([code[~split], keys]), np.concatenate([value[~split], values])
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(value.view(np.int64))], ["anchor", "fp"])

    return run


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= THRESHOLD


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same linked sets from fewer links: each fingerprint to its set's smallest."""
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label, new[np.arange(len(ids))])
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(ids)))
    return ids[rest], ids[label[rest]]


def _pairs_in_runs(key: np.ndarray, fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Near pairs among rows of equal key (sorted), shift by shift: no run's pairs are held at once."""
    left, right, shift = [], [], 1
    alive = np.arange(len(key) - 1)
    while len(alive):
        alive = alive[alive + shift < len(key)]
        alive = alive[key[alive] == key[alive + shift]]
        ok = alive[_near(fp[alive], fp[alive + shift])]
        if len(ok):
            left.append(fp[ok])
            right.append(fp[ok + shift])
        shift += 1
        if len(left) > 64:
            a, b = _stars(np.concatenate(left), np.concatenate(right))
            left, right = [a], [b]
    return left, right


def _compare(anchor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of each anchor."""
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.empty(0, int)
    size = np.diff(np.append(starts, len(anchor)))
    big = np.repeat(size > SPLIT, size)
    left, right = _pairs_in_runs(anchor[~big], fp[~big])
    if big.any():
        # Within two bits one of three pieces of the word is equal: exact groups, much smaller.
        for shift, width in PIECES:
            piece = (fp[big] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            order = np.lexsort((fp[big], piece, anchor[big]))
            # A run's number stands for (anchor, piece).
            a, p, f = anchor[big][order], piece[order], fp[big][order]
            run = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (p[1:] != p[:-1])]))
            more = _pairs_in_runs(run, f)
            left, right = left + more[0], right + more[1]
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return _stars(np.concatenate(left), np.concatenate(right))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by anchor; an anchor that a batch ends in is carried to the next."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = _compare(anchor, fp)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        anchor, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(anchor):
            continue
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if cut or not held or held[-1][0][-1] != anchor[-1]:
            done = [*held, (anchor[:cut], fp[:cut])]
            yield flush(np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done]))
            held = []
        held.append((anchor[cut:], fp[cut:]))
    if held:
        yield flush(np.concatenate([d[0] for d in held]), np.concatenate([d[1] for d in held]))


def near_links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links that connect exactly the distinct ``fp`` within two bits."""
    codes = "anchor long, fp long"
    fps = distinct.select("fp")
    # Counted before the shuffle; the few largest anchors alone reach the driver.
    sizes = fps.mapInArrow(_replicate(np.empty(0, np.int64)), codes).groupBy("anchor").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > hot).orderBy(F.col("n").desc(), "anchor").limit(HOT_ANCHORS).collect()
    replicas = fps.mapInArrow(_replicate(np.array(sorted(r["anchor"] for r in large), np.int64)), codes)
    return replicas.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_links, "a long, b long").distinct()


def simhash_components(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    prints = settle(fingerprints(documents, shingle), "fingerprints")
    return prints.join(component_of_fingerprints(prints), "fp").select("doc_id", "fp", "component_id")


def component_of_fingerprints(prints: DataFrame) -> DataFrame:
    """(fp, component_id): the smallest doc_id reachable from each distinct fingerprint."""
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("_least")), "classes")
    roots = connected_components(settle(near_links(classes), "links"))  # (node, root), of linked ones only
    full = settle(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"), F.col("root").isNotNull().alias("_linked")), "rooted")
    least = full.where("_linked").groupBy("_root").agg(F.min("_least").alias("component_id"))
    linked = full.where("_linked").join(least, "_root").select("fp", "component_id")
    return linked.unionByName(full.where("NOT _linked").select("fp", F.col("_least").alias("component_id")))


def keep_one(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows kept of each near-duplicate group: one, of the smallest id (null ids last).

    Rows are told by a 128-bit hash of id and text, the same in every scan; of rows that are equal in
    both any one may stay.
    """
    key = [F.xxhash64("doc_id", text_or_empty()).alias("_k1"), F.xxhash64(text_or_empty(), F.lit(1)).alias("_k2")]
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in utf8(batch.column(0))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], ["doc_id", "_k1", "_k2", "fp"])

    found = documents.select(text_or_empty().alias("text"), "doc_id", *key).mapInArrow(run, f"doc_id {kind}, _k1 long, _k2 long, fp long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k1", "_k2"))
    best = settle(found.groupBy("fp").agg(first.alias("_first")), "fingerprints")
    roots = connected_components(settle(near_links(best.select("fp")), "links"))
    rooted = best.join(roots, best["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("_root"), "_first")
    keep = settle(rooted.groupBy("_root").agg(F.min("_first").alias("_first")).select(F.col("_first._k1").alias("_j1"), F.col("_first._k2").alias("_j2")), "kept")
    marked = documents.select(F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("_doc"), *key)
    # The kept rows grow with the documents: a shuffled join at every size, never a broadcast.
    kept = marked.join(keep.hint("merge"), (F.col("_k1") == F.col("_j1")) & (F.col("_k2") == F.col("_j2")), "left_semi")
    return kept.groupBy("_k1", "_k2").agg(F.first("_doc").alias("_doc")).select("_doc.*")


def op5(documents: DataFrame) -> DataFrame:
    found = simhash_components(documents)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
