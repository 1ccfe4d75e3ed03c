"""Benchmark decontamination by CGK embedding, bit sampling and exact edit distance.

Texts and items are lower-cased words without punctuation.  An item is found where a stretch of a
document is within a fifth of the item's words in edit distance.  Item-sized windows start where
a document shares short runs of words with an item, as many as must remain of a stretch within
that distance (the pigeonhole principle and the q-gram count lemma), so no start is lost.  Each window is embedded
by the CGK random walk (a step writes the current word, and a hash bit of that word decides
whether the walk moves on), which maps edit distance to Hamming distance.  Each of several
independent walks is sampled at a few places; a window that agrees with its item in all samples
of any walk is a candidate, and a bit-parallel edit distance decides.

With ``SAMPLES`` places a walk, ``WALKS`` walks and a Hamming distance of a share h of the walk, a
window is missed with probability (1 - (1 - h)^SAMPLES)^WALKS: under 2 % at h = 0.65.  Walks drift
apart with their length, so an item of more than ``SEGMENT`` words is embedded in equal segments of
at most as many: one of them has no more than its share of the edits.  A shared run's own offset
places its segment in the document; a segment that agrees makes the whole item a candidate there.

The items are broadcast in blocks whose bytes are bounded, one block at a time: what a block finds
is written before the next is sent.

Defined results: null and empty texts and items match nothing; repeated rows and items are judged
each; a null item id is reported as null; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, settle, settled_so_far, slices, text_or_empty, utf8

SHARE = 0.2
WALKS, SAMPLES = 32, 2
SEED_WORDS = 3
#: Words that walks are compared over; longer items are embedded in parts.
SEGMENT = 60
#: Bytes of item text a broadcast may hold.
BLOCK_BYTES = 8_000_000

_CLEAN = bytes.maketrans(bytes(c for c in range(33, 127) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(33, 127)))
#: More than any item has words: (item, word) as one number.
_FAR = 1 << 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_CLEAN).split()


def allowed(n: int) -> int:
    """Edits that an item of n words may differ by."""
    return int(SHARE * n)


def seed_length(n: int) -> int:
    """Words of a run that survives the allowed edits, at most SEED_WORDS."""
    k = allowed(n)
    return max(1, min(SEED_WORDS, -(-(n - k) // (k + 1))))


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    h = (x.astype(np.uint64) + np.uint64(salt)) * _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _run_codes(ids: np.ndarray, q: int) -> np.ndarray:
    code = np.zeros(max(0, len(ids) - q + 1), np.uint64)
    for k in range(q):
        code = _hash(code ^ ids[k : k + len(code)].astype(np.uint64), k + 1)
    return code


@dataclass
class Items:
    """A block of benchmark items, prepared for search."""

    ids: list[int | None]
    words: list[np.ndarray]  # word numbers from 1; 0 is any word that no item has
    number: dict[bytes, int]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    keys: np.ndarray | None = None
    places: np.ndarray | None = None
    first: np.ndarray | None = None  # by item: its first segment, and at the end their number
    parts: np.ndarray | None = None  # by segment: its first word in the item, and its words
    _sizes: np.ndarray | None = None

    @classmethod
    def of(cls, rows: list[tuple[int | None, bytes]]) -> Items:
        number: dict[bytes, int] = {}
        ids, words = [], []
        for item, text in rows:
            found = words_of(text)
            if found:
                ids.append(item)
                words.append(np.array([number.setdefault(w, len(number) + 1) for w in found], np.int64))
        out = cls(ids, words, number)
        for q in sorted({seed_length(len(w)) for w in words}):
            codes, which, where = [], [], []
            for i, w in enumerate(words):
                if seed_length(len(w)) == q:
                    c = _run_codes(w, q)
                    codes.append(c)
                    which.append(np.full(len(c), i))
                    where.append(np.arange(len(c)))
            code, item, at = (np.concatenate(x) for x in (codes, which, where))
            order = np.argsort(code, kind="stable")
            unique, first, count = np.unique(code[order], return_index=True, return_counts=True)
            out.seeds[q] = unique, np.column_stack([first, count]), item[order], at[order]
        if words:
            rng = np.random.default_rng(20_240_501)
            share = rng.random((WALKS, SAMPLES))
            cuts = [np.linspace(0, len(w), -(-len(w) // SEGMENT) + 1).astype(np.int64) for w in words]
            out.first = np.cumsum([0, *(len(c) - 1 for c in cuts)])
            out.parts = np.concatenate([np.column_stack([c[:-1], np.diff(c)]) for c in cuts])
            n = out.parts[:, 1]
            # A walk of 3/2 n steps ends near the segment's last word.
            out.places = np.floor(share[None] * (3 * n // 2)[:, None, None]).astype(np.int64)
            flat = np.concatenate(words)  # segments follow each other as the words do
            starts = np.cumsum(n) - n
            out.keys = np.concatenate([out.embed(flat, starts[i : i + 4096], (starts + n)[i : i + 4096], np.arange(len(n))[i : i + 4096]) for i in range(0, len(n), 4096)])
        return out

    def embed(self, flat: np.ndarray, start: np.ndarray, stop: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The sampled words of every walk: (window, walk, sample).  Nothing else of a walk is kept."""
        places = self.places[segment].ravel()
        order = np.argsort(places, kind="stable")
        steps = int(places.max(initial=-1)) + 1
        upto = np.searchsorted(places[order], np.arange(steps + 1))
        out = np.empty(len(places), np.int64)
        padded = np.append(flat, 0)
        at = np.repeat(start[:, None], WALKS, axis=1)
        end = stop[:, None]
        salt = (np.arange(WALKS, dtype=np.uint64) << np.uint64(40))[None]
        for t in range(steps):
            symbol = np.where(at < end, padded[np.minimum(at, len(flat))], -1)
            taken = order[upto[t] : upto[t + 1]]
            out[taken] = symbol.ravel()[taken // SAMPLES]
            at += (_hash(symbol.astype(np.uint64) ^ salt, 1 + t) & np.uint64(1)).astype(np.int64)
        return out.reshape(len(start), WALKS, SAMPLES)

    def sizes(self) -> np.ndarray:
        """By item: words, allowed edits, and the runs that those leave."""
        if self._sizes is None:
            n = [len(w) for w in self.words]
            self._sizes = np.array([(x, allowed(x), max(1, x - seed_length(x) + 1 - seed_length(x) * allowed(x))) for x in n], np.int64).reshape(-1, 3)
        return self._sizes

    def search(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item's place, distance, first word, end) of the best stretch for each item found."""
        get = self.number.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
        pairs = []
        for q, (unique, span, item, at) in self.seeds.items():
            if len(ids) < q:
                continue
            known = ids > 0
            whole = np.ones(len(ids) - q + 1, bool)
            for k in range(q):
                whole &= known[k : k + len(whole)]
            p = np.flatnonzero(whole)
            if not len(p):
                continue
            code = _run_codes_at(ids, p, q)
            slot = np.minimum(np.searchsorted(unique, code), len(unique) - 1)
            hit = unique[slot] == code
            p, slot = p[hit], slot[hit]
            count = span[slot, 1]
            row = np.repeat(span[slot, 0], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            pairs.append(np.column_stack([item[row], np.repeat(p, count) - at[row], at[row]]))
        if not pairs or not sum(map(len, pairs)):
            return []
        hits = np.concatenate(pairs)
        hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
        sizes = self.sizes()
        # The count lemma: k edits spoil at most q k of an item's runs of q words, and the starts that
        # the rest point to differ by 2 k at most.  Fewer hits about a start can't be a match.
        n, k, least = sizes[hits[:, 0]].T
        wide = len(ids) + 2 * int(sizes[:, 0].max()) + 1
        line = hits[:, 0] * (4 * wide) + hits[:, 1] + wide
        about = np.searchsorted(line, line + 2 * k, "right") - np.searchsorted(line, line - 2 * k)
        hits = hits[about >= least]
        # The segment that a run starts in: the last one that begins at or before it.
        edge = self.parts[:, 0] + np.repeat(np.arange(len(self.words)), np.diff(self.first)) * _FAR
        hits[:, 2] = np.searchsorted(edge, hits[:, 0] * _FAR + hits[:, 2], "right") - 1
        windows = np.unique(hits, axis=0)
        which, segment = windows[:, 0], windows[:, 2]
        begin, n = self.parts[segment].T
        start = np.maximum(windows[:, 1] + begin, 0)
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for at in range(0, len(windows), 512):
            part = slice(at, at + 512)
            sampled = self.embed(ids, start[part], np.minimum(start[part] + n[part] + (SHARE * n[part]).astype(np.int64), len(ids)), segment[part])
            agree = (sampled == self.keys[segment[part]]).all(axis=2).any(axis=1)
            for i in np.flatnonzero(agree) + at:
                item, s = int(which[i]), max(int(windows[i, 1]), 0)
                if (item, s) in tried:  # by another segment
                    continue
                tried.add((item, s))
                size, k = int(sizes[item, 0]), int(sizes[item, 1])
                low, high = max(0, s - k), min(len(ids), s + size + k)
                distance, end = edit_search(self.words[item], ids[low:high])
                if distance <= k and (item not in best or distance < best[item][0]):
                    best[item] = distance, max(low, low + end - size), low + end
        return [(i, *found) for i, found in sorted(best.items())]


def _run_codes_at(ids: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    code = np.zeros(len(at), np.uint64)
    for k in range(q):
        code = _hash(code ^ ids[at + k].astype(np.uint64), k + 1)
    return code


def edit_search(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to any stretch of ``text``, and that stretch's end.

    Columns of the dynamic programme are kept as bits of their differences, in whole integers.
    """
    m = len(pattern)
    at: dict[int, int] = {}
    for i, c in enumerate(pattern.tolist()):
        at[c] = at.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = mask, 0, m  # differences of +1 and -1 down the column
    best, end = m, 0
    for j, c in enumerate(text.tolist(), 1):
        eq = at.get(c, 0)
        zero = ((((eq & up) + up) ^ up) | eq | down) & mask
        right, left = down | (mask & ~(zero | up)), up & zero
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1) & mask, (left << 1) & mask  # a stretch may start anywhere
        up, down = left | (mask & ~(zero | right)), right & zero
        if score < best:
            best, end = score, j
    return best, end


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark's items in blocks of bounded size, each read from the cluster by itself."""
    items = benchmark.select("item_id", text_or_empty().alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        rows = items.where(part == b).collect() if blocks > 1 else items.collect()
        yield Items.of(sorted(((r["item_id"], r["text"].encode()) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def _by_blocks(documents: DataFrame, benchmark: DataFrame, block_bytes: int, step) -> DataFrame:  # noqa: ANN001
    """``step(frame, broadcast block)`` for one block after the other; a block's result is written before the next."""
    out, shared, since = documents, None, settled_so_far()
    for items in item_blocks(benchmark, block_bytes):
        if shared is not None:
            out = settle(out, "decontaminated")
            shared.unpersist()
            discard(documents.sparkSession, since, keep=1)
        shared = documents.sparkSession.sparkContext.broadcast(items)
        out = step(out, shared)
    return out


def find_items(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, hits): for every row the items found, as (item_id, distance, start, end) in words."""
    kind, item = documents.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    hit = f"array<struct<item_id:{item.simpleString()},distance:int,start:long,end:long>>"
    arrow = pa.list_(pa.struct([("item_id", to_arrow_type(item)), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def step(frame: DataFrame, shared) -> DataFrame:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in slices(batches):
                hits = batch.column(2).to_pylist()
                for i, text in enumerate(utf8(batch.column(1))):
                    hits[i] = hits[i] + [dict(zip(("item_id", "distance", "start", "end"), (items.ids[k], d, a, b))) for k, d, a, b in items.search(text)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, arrow)], ["doc_id", "text", "hits"])

        return frame.mapInArrow(run, f"doc_id {kind}, text string, hits {hit}")

    begun = documents.select("doc_id", text_or_empty().alias("text"), F.array().cast(hit).alias("hits"))
    return _by_blocks(begun, benchmark, block_bytes, step).select("doc_id", F.array_sort("hits").alias("hits"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows in which no item is found, all columns kept as they are."""
    return _by_blocks(documents, benchmark, block_bytes, lambda frame, shared: frame.where(_clean_test(shared)(text_or_empty())))


def _clean_test(shared):  # noqa: ANN001, ANN202
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.search((t or "").encode()) for t in texts], dtype=bool)

    return clean


def op6(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_items(documents, benchmark)
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        F.transform("hits", lambda h: h["item_id"]).alias("item_ids"),
        F.transform("hits", lambda h: h["distance"]).alias("distances"),
    )
