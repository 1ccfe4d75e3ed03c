"""Removal of word sequences that repeat anywhere in the corpus, by suffix automata.

One automaton of all text, sent to everyone, would grow with the corpus, and passing every
document by every shard of it would grow with its square.  So documents and reference meet by
*anchors*.  Every window of ``WINDOW`` words has one: its run of ``RUN`` words of smallest hash
(the first of equals).  Windows of equal words have equal anchors, so a window can only recur
where its anchor does.  Anchors that occur once are dropped by a count over the whole corpus.
The words under the windows of a repeated anchor form a *stretch*; every window is in exactly one.
The stretches of an anchor are a reference shard: distinct stretches go into a suffix automaton
with their numbers of occurrences, each distinct stretch is streamed through it, and where the
longest suffix seen twice or more has ``WINDOW`` words, a window repeats.  The automaton compares
words, not hashes, so the spans are exact.  A stretch's spans are joined back to the places where it
occurs.

A shard is one task's, so an anchor of more than ``CROWD`` occurrences is split by longer anchors:
its distinct stretches are counted first, then every window is an anchor of its own, and each such
shard's automaton holds the one sequence of words that the window is.  A passage that very many
documents quote thereby spreads over as many shards as it has windows, and over the partial counts
before them.

Defined results: null and empty texts have no words and nothing removed; repeated rows repeat each
other's windows; a null doc_id is a document like others; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, slices, text_or_empty, utf8

WINDOW, RUN = 35, 8
#: Anchors of more occurrences are split by longer anchors: a shard has at most so many stretches.
CROWD = 2_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Sums:
    """Hashes of any run of words: prefix sums of a polynomial over the joined text, modulo 2^64."""

    _up = _down = np.empty(0, np.uint64)

    def __init__(self, words: list[bytes]) -> None:
        flat = np.frombuffer(b" ".join(words), np.uint8)
        if len(self._up) <= len(flat):
            _Sums._up, _Sums._down = _powers(_BASE, 2 * len(flat) + 2), _powers(_INVERSE, 2 * len(flat) + 2)
        size = np.fromiter(map(len, words), np.int64, len(words))
        self.stop = np.cumsum(size + 1) - 1
        self.start = self.stop - size
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * self._up[: len(flat)], dtype=np.uint64)])

    def runs(self, width: int) -> np.ndarray:
        """The mixed hash of every run of ``width`` words."""
        n = len(self.start) - width + 1
        a, b = self.start[:n], self.stop[width - 1 :]
        h = (self.sums[b] - self.sums[a]) * self._down[a]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h * np.uint64(0x94D049BB133111EB)


def anchors(sums: _Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, windows) of each anchor of a text, in order."""
    n = len(sums.start) - WINDOW + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 4
    h = sums.runs(RUN)
    width = WINDOW - RUN + 1
    parts = []
    for at in range(0, n, 65_536):  # windows of a long text in blocks
        view = np.lib.stride_tricks.sliding_window_view(h[at : min(at + 65_536, n) + width - 1], width)
        parts.append(view.argmin(axis=1) + np.arange(at, at + len(view)))
    place = np.concatenate(parts)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return h[place[first]].view(np.int64), place[first], first, np.diff(np.append(first, n))


class Automaton:
    """Suffix automaton of several word sequences, each counted with a weight."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, words: list[bytes], weight: int) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in words:
            at = nxt[last].get(c)
            if at is not None and length[at] == length[last] + 1:
                last = at
            else:
                if at is not None:  # the state is split: this prefix was a suffix inside another
                    new = self._split(last, c, at)
                    last = new
                else:
                    new = len(nxt)
                    nxt.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    count.append(0)
                    p = last
                    while p >= 0 and c not in nxt[p]:
                        nxt[p][c] = new
                        p = link[p]
                    if p >= 0:
                        q = nxt[p][c]
                        link[new] = q if length[p] + 1 == length[q] else self._split(p, c, q)
                    last = new
            count[last] += weight

    def _split(self, p: int, c: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def finish(self) -> None:
        """Counts of all states from those of the prefixes."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[v] >= 0:
                self.count[self.link[v]] += self.count[v]

    def repeated(self, words: list[bytes], least: int) -> list[int]:
        """Starts of the runs of ``least`` words that occur twice or more in what was added."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        out, v, n = [], 0, 0
        for i, c in enumerate(words):
            at = nxt[v].get(c)
            while v and (at is None or count[at] < 2):
                v = link[v]
                n = length[v]
                at = nxt[v].get(c)
            if at is not None and count[at] >= 2:
                v, n = at, n + 1
            if n >= least:
                out.append(i - least + 1)
        return out


def _repeated_windows(bodies: dict[bytes, int]) -> dict[bytes, list[int]]:
    """For each distinct stretch of a shard the starts of its repeated windows."""
    cut = {b: b.split(b" ") for b in bodies}
    automaton = Automaton()
    for b, weight in bodies.items():
        automaton.add(cut[b], weight)
    automaton.finish()
    return {b: automaton.repeated(w, WINDOW) for b, w in cut.items()}


def _runs(starts: list[int]) -> list[dict[str, int]]:
    """Ascending starts of windows as (first, last) of consecutive ones."""
    out: list[dict[str, int]] = []
    for x in starts:
        if out and out[-1]["last"] == x - 1:
            out[-1]["last"] = x
        else:
            out.append({"first": x, "last": x})
    return out


_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, body, n) sorted by anchor to (key, spans): repeated windows of each distinct stretch that has any."""
    last, weights, out = None, Counter(), []

    def done() -> None:
        for body, starts in _repeated_windows(weights).items():
            if starts:
                out.append((_digest(body), _runs(starts)))

    def table() -> pa.RecordBatch:
        keys, spans = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(spans, _RUNS)], ["key", "spans"])

    for batch in batches:
        for anchor, body, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if anchor != last:
                if weights:
                    done()
                last, weights = anchor, Counter()
            weights[body] += n
        if len(out) > 5_000:
            yield table()
            out = []
    if weights:
        done()
    yield table()


def _digest(body: bytes) -> bytes:
    return xxhash.xxh3_128_digest(body)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        dk, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fps, places, counts = [], [], []
        for text in utf8(batch.column(2)):
            words = text.split()
            fp, place, _, _ = anchors(_Sums(words)) if len(words) >= WINDOW else (np.empty(0, np.int64),) * 4
            fps.append(fp)
            places.append(place)
            counts.append(len(fp))
        arrays = [np.concatenate(fps) if fps else np.empty(0, np.int64), np.repeat(dk, counts), np.repeat(h, counts), np.concatenate(places) if places else np.empty(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in arrays], ["fp", "dk", "h", "place"])


def _stretches(with_words: bool):  # noqa: ANN202
    """Texts with their repeated anchors' places to stretches: with their words and numbers, or with where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            places, words_of = [], Counter()
            for dk, h, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist()):
                words, hot = text.split(), {m["place"]: m["hot"] for m in marks}
                for fp, place, first, n in zip(*(a.tolist() for a in anchors(_Sums(words)))):
                    if place in hot:
                        body = b" ".join(words[first : first + n - 1 + WINDOW])
                        if with_words:
                            words_of[fp, hot[place], body] += 1
                        else:
                            places.append((_digest(body), dk, h, first))
            if with_words:
                fps, hots, bodies = zip(*words_of) if words_of else ((), (), ())
                columns = [(fps, pa.int64()), (hots, pa.bool_()), (bodies, pa.binary()), (list(words_of.values()), pa.int64())]
                names = ["anchor", "hot", "body", "n"]
            else:
                columns = list(zip(list(zip(*places)) or [()] * 4, (pa.binary(), pa.int64(), pa.int64(), pa.int64())))
                names = ["at", "dk", "h", "place"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names)

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct stretches (body, n) to their windows: (stretch's digest, start, window's digest, window, n)."""
    for batch in slices(batches):
        out = []
        for body, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words, key = body.split(b" "), _digest(body)
            windows = [b" ".join(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
            out += [(key, i, _digest(w), w, n) for i, w in enumerate(windows)]
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["of", "start", "window", "body", "n"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        spans = [_runs(sorted(x)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _RUNS)], ["key", "spans"])


def _split_anchors(stretches: DataFrame) -> DataFrame:
    """(key, spans) of distinct stretches (body, n) of crowded anchors, every window by itself."""
    schema = "of binary, start long, window binary, body binary, n long"
    counted = stretches.mapInArrow(_windows, schema).groupBy("body").agg(F.sum("n").alias("n"))
    # A window's own hash is its anchor: its shard's automaton has the one sequence.
    again = counted.select(F.xxhash64("body").alias("anchor"), "body", "n").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards, _SPANS)
    each = stretches.mapInArrow(_windows, schema).select("of", "start", "window")
    starts = each.join(again.select("key"), F.col("window") == F.col("key")).groupBy("of").agg(F.collect_list("start").alias("starts"))
    return starts.mapInArrow(_gather, _SPANS)


_SPANS = "key binary, spans array<struct<first:long,last:long>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        total, removed, kept = [], [], []
        for text, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
            words = text.split()
            gone = np.zeros(len(words) + 1, np.int64)
            for s in spans or ():
                gone[s["first"]] += 1
                gone[s["last"] + WINDOW] -= 1
            covered = np.cumsum(gone)[:-1] > 0
            total.append(len(words))
            removed.append(int(covered.sum()))
            kept.append(b" ".join([w for w, c in zip(words, covered.tolist()) if not c] if removed[-1] else words))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"]
        )


def remove_repeats(documents: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): for every row its words that no repeated window covers, joined by spaces."""
    text = text_or_empty()
    kind = documents.schema["doc_id"].dataType.simpleString()
    # A row's key is a 128-bit hash of id and text; equal rows share it and everything else.  The same
    # columns go into every join below, so that the texts are shuffled once and read thrice.
    texts = documents.select(F.xxhash64("doc_id", text).alias("dk"), F.xxhash64(text, F.lit(1)).alias("h"), text.alias("text"), "doc_id")
    seen = settle(texts.drop("doc_id").mapInArrow(_occurrences, "fp long, dk long, h long, place long"), "anchors")
    again = settle(seen.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp", (F.col("n") > crowd).alias("hot")), "again")
    wanted = seen.join(again, "fp").groupBy("dk", "h").agg(F.collect_set(F.struct("place", "hot")).alias("marks"))
    marked = texts.join(wanted, ["dk", "h"]).select("dk", "h", "text", "marks", "doc_id")
    stretches = marked.mapInArrow(_stretches(True), "anchor long, hot boolean, body binary, n long")
    spans = stretches.where("NOT hot").select("anchor", "body", "n").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards, _SPANS)
    if not again.where("hot").isEmpty():
        spans = spans.unionByName(_split_anchors(stretches.where("hot").groupBy("body").agg(F.sum("n").alias("n"))))
    places = marked.mapInArrow(_stretches(False), "at binary, dk long, h long, place long")
    met = places.join(spans, F.col("at") == F.col("key")).select("dk", "h", "place", F.explode("spans").alias("s"))
    found = met.groupBy("dk", "h").agg(F.collect_set(F.struct((F.col("place") + F.col("s.first")).alias("first"), (F.col("place") + F.col("s.last")).alias("last"))).alias("spans"))
    whole = texts.join(found, ["dk", "h"], "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(_cut, f"doc_id {kind}, n_words long, n_removed long, kept binary")


def op7(documents: DataFrame) -> DataFrame:
    return remove_repeats(documents).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
