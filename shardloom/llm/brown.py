"""Language-model scores by Brown classes.

Exchange clustering gives every word of the training texts a class, in two steps.  The driver
clusters *items*: the most frequent words, each by itself, and buckets of all others by their
endings.  It moves items between classes while the class bigrams' likelihood grows.  Then one
exchange sweep over all other words with ``LEAST`` occurrences or more runs on the executors: a
word's counts before and after each class are brought together, and it leaves its item's class for
the one in which the class bigrams' likelihood gains most.  Such words are rare against the classes,
so the gain is taken to first order: the likelihood of the word's contexts in the class, for all words
of a batch at once.  Rarer words, too few to tell, keep the class of their ending.
The number of classes grows with the number of training tokens (their fourth root), so the table of
class bigrams grows with its square root.  A text's probability is the product of class-transition
and word-emission probabilities,

    P(w | v) = (T[v', w'] + a P[w']) / (T[v'] + a)  *  (n[w] + d) / (N[w'] + d (V[w'] + 1)),

where ``v'`` and ``w'`` are classes and a text starts after an end.  Word counts, class sizes and
transitions cover all training texts.  Words and their classes stay a distributed table: the workers
are sent only the head of it, whose number of words is bounded.  Texts are cut into words once
more after the count, into a table of places in the head, where every row has an id; a row meets
the counts and classes of its other words by that id and their numbers in it.

Defined results: a null or empty text has the one end token; repeated rows are scored each; with
no training text every probability is 1, base and score alike; a null id counts as the empty
string in the fold rule.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, settle, slices, text_or_empty, utf8

#: At most so many of the most frequent words go to the workers as a dictionary.
HEAD = 150_000
#: Items: words of their own, and buckets of endings for all other words.
OWN_ITEMS, ENDINGS = 1200, 300
#: Words of fewer occurrences have the class of their ending.
LEAST = 4
#: Training tokens for a bucket of words, or for a part of the texts.
PART = 500_000
_FLUSH = 250_000
_STEPS = 64  # steps of the count scale a power of two, to find the head's smallest count


def _ending(word: bytes) -> int:
    return OWN_ITEMS + zlib.crc32(word[-3:]) % ENDINGS


END_ITEM = OWN_ITEMS + ENDINGS
ITEMS = END_ITEM + 1


def word_counts(documents: DataFrame) -> DataFrame:
    """(token binary, n): counts of all lower-cased words; ends are not among them."""

    def table(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in utf8(batch.column(0)):
                seen.update(text.lower().split())
            if len(seen) > _FLUSH:
                yield table(seen)
                seen.clear()
        if seen:
            yield table(seen)

    parts = documents.select(text_or_empty().alias("text")).mapInArrow(run, "token binary, n long")
    return parts.groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """The frequent words: at most ``HEAD`` of them, in descending order of count."""

    words: list[bytes]
    counts: np.ndarray

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def items(self) -> np.ndarray:
        return np.array([i if i < OWN_ITEMS else _ending(w) for i, w in enumerate(self.words)], np.int64)


def head_of(counts: DataFrame, most: int = HEAD) -> tuple[Head, Column]:
    """The head and the condition that a row of ``counts`` belongs to it.

    The smallest count is read off a histogram of counts on a logarithmic scale, so that only
    the head itself is brought together, never a top-k of every partition.
    """
    scale = F.floor(F.log2("n") * _STEPS).cast("int")
    histogram = sorted(((r["s"], r["k"]) for r in counts.groupBy(scale.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, None
    for s, k in histogram:
        if total + k > most:
            break
        total, least = total + k, s
    inside = scale >= least if least is not None else F.lit(False)
    found = sorted(((r["n"], bytes(r["token"])) for r in counts.where(inside).collect()), key=lambda x: (-x[0], x[1]))
    return Head([w for _, w in found], np.array([n for n, _ in found], np.int64)), inside


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column, one after the other, and the edges of the rows among them."""
    column = column.cast(pa.large_binary())
    if not len(column) or not column.buffers()[2] or not column.buffers()[2].size:
        return np.empty(0, kind), np.zeros(len(column) + 1, np.int64)
    edges = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]].view(kind), (edges - edges[0]) // np.dtype(kind).itemsize


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column with the numbers between two edges in each row."""
    data = [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64) * values.itemsize), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, data).cast(pa.binary())


def _tokens(lens: np.ndarray, raw: np.ndarray) -> pa.Array:
    """Words from their sizes and their bytes, one after the other."""
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(_edges(lens)), pa.py_buffer(np.ascontiguousarray(raw))])


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _steps(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each row's first number, then the differences, which pack well."""
    out = np.diff(values, prepend=values[:1])
    some = edges[:-1][np.diff(edges) > 0]
    out[some] = values[some]
    return out


def _summed(steps: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """What ``_steps`` was given."""
    total = np.cumsum(steps)
    sizes = np.diff(edges)
    some = edges[:-1][sizes > 0]
    return total - np.repeat(total[some] - steps[some], sizes[sizes > 0])


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``first``."""
    return np.repeat(first - _edges(sizes)[:-1], sizes) + np.arange(int(sizes.sum()))


def _changes(values: np.ndarray) -> np.ndarray:
    """Edges of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, np.int64)


def _neighbours(of: np.ndarray, edges: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stands before and after each word of texts, and first in each text; the end is around texts."""
    some = np.flatnonzero(np.diff(edges))
    before, after, first = (np.full(n, end, np.int64) for n in (len(of), len(of), len(edges) - 1))
    before[1:], after[:-1], first[some] = of[:-1], of[1:], of[edges[some]]
    before[edges[some]] = after[edges[some + 1] - 1] = end
    return before, after, first


#: A text's words as places in the head (int32; beyond it -1, -2, ... for its distinct words in their order), lower and
#: upper halves apart as the upper are mostly 0; of those words the bytes, their lengths (int32) and the endings' items (uint16).
_PLACES = "low binary, high binary, words binary, lens binary, ends binary"


def place_words(documents: DataFrame, head: Head) -> DataFrame:
    """The columns of ``documents`` after the first, a text, and the places of all its words."""
    shared = documents.sparkSession.sparkContext.broadcast(head)
    kept = documents.columns[1:]
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.index().get
        for batch in slices(batches):
            ats, new, sizes = [], [], []
            for text in utf8(batch.column(0)):
                words = text.lower().split()
                at = np.fromiter(map(place, words, repeat(-1)), np.int32, len(words))
                mine: dict[bytes, int] = {}
                beyond = np.flatnonzero(at < 0)
                if len(beyond):
                    at[beyond] = [mine.setdefault(words[i], -1 - len(mine)) for i in beyond.tolist()]
                ats.append(at)
                new += mine
                sizes.append(len(mine))
            lens, edges = np.fromiter(map(len, new), np.int32, len(new)), _edges(np.array(sizes))
            at, texts = np.concatenate(ats), _edges(np.array([len(x) for x in ats]))
            packed = [
                _packed((at & 0xFFFF).astype(np.uint16), texts),
                _packed((at >> 16).astype(np.int16), texts),
                _packed(np.frombuffer(b"".join(new), np.uint8), _edges(lens)[edges]),
                _packed(lens, edges),
                _packed(np.fromiter(map(_ending, new), np.uint16, len(new)), edges),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), *packed], [*kept, "low", "high", "words", "lens", "ends"])

    return documents.mapInArrow(run, "".join(f"{n} {kinds[n]}, " for n in kept) + _PLACES)


@dataclass
class Placed:
    """Some texts' words: places, edges of the texts, the text of each word; of words beyond the head their rows among all new words."""

    at: np.ndarray
    edges: np.ndarray
    text: np.ndarray
    beyond: np.ndarray
    row: np.ndarray
    ends: np.ndarray
    new: np.ndarray  # edges of the texts among the new words

    @classmethod
    def of(cls, low: pa.Array, high: pa.Array, ends: pa.Array) -> Placed:
        (at, edges), (ends, new) = _flat(low, "<u2"), _flat(ends, "<u2")
        at = _flat(high, "<i2")[0].astype(np.int32) << 16 | at
        text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        beyond = np.flatnonzero(at < 0)
        return cls(at, edges, text, beyond, new[text[beyond]] - 1 - at[beyond], ends, new)

    def values(self, of_head: np.ndarray, of_new: np.ndarray) -> np.ndarray:
        """A value for each word, from those of the head's words and of the new words."""
        out = of_head[np.maximum(self.at, 0)] if len(of_head) else np.zeros(len(self.at), of_head.dtype)
        out[self.beyond] = of_new[self.row]
        return out


def item_bigrams(placed: DataFrame, head: Head) -> np.ndarray:
    """Counts of consecutive items in all texts, the end before each text's first; items² numbers."""
    shared = placed.sparkSession.sparkContext.broadcast(head.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = shared.value
        seen = np.zeros(ITEMS * ITEMS, np.int64)
        for batch in slices(batches, 4096):
            words = Placed.of(*batch.columns)
            items = words.values(item, words.ends)
            _, after, first = _neighbours(items, words.edges, END_ITEM)
            seen += np.bincount(np.concatenate([items * ITEMS + after, END_ITEM * ITEMS + first]), minlength=ITEMS * ITEMS)
        codes = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(seen[codes])], ["code", "n"])

    rows = placed.select("low", "high", "ends").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ITEMS * ITEMS, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out.reshape(ITEMS, ITEMS)


def classes_for(tokens: int) -> int:
    """Classes for so many training tokens, the end's own included."""
    return max(8, math.ceil(max(tokens, 1) ** 0.25))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


class ClassBigrams:
    """Counts of class bigrams, from which a word is taken out of one class and put into the best.

    The last class is the end's; no word joins it.
    """

    def __init__(self, g: np.ndarray) -> None:
        self.g = g.astype(np.float64)
        self.f = _xlogx(self.g)
        self.out, self.into = self.g.sum(axis=1), self.g.sum(axis=0)

    def _shift(self, c: int, r: np.ndarray, l: np.ndarray, s: float, sign: int) -> None:
        g, f = self.g, self.f
        g[c, :] += sign * r
        g[:, c] += sign * l
        g[c, c] += sign * s
        np.maximum(g[c, :], 0, out=g[c, :])  # a task's copy lags behind the others' moves
        np.maximum(g[:, c], 0, out=g[:, c])
        f[c, :], f[:, c] = _xlogx(g[c, :]), _xlogx(g[:, c])
        self.out, self.into = g.sum(axis=1), g.sum(axis=0)

    def move(self, c: int, r: np.ndarray, l: np.ndarray, s: float = 0.0) -> int:
        """The new class of a word of class ``c`` with counts ``r`` before and ``l`` after each class, ``s`` beside itself."""
        self._shift(c, r, l, s, -1)
        g, f = self.g, self.f
        after, before = np.flatnonzero(r), np.flatnonzero(l)
        row = _xlogx(g[:, after] + r[after]) - f[:, after]
        column = _xlogx(g[before, :] + l[before, None]) - f[before, :]
        gain = row.sum(axis=1) + column.sum(axis=0)
        gain[after] -= row[after, np.arange(len(after))]
        gain[before] -= column[np.arange(len(before)), before]
        diagonal = np.diag(g)
        gain += _xlogx(diagonal + r + l + s) - np.diag(f)
        gain -= _xlogx(self.out + r.sum() + s) - _xlogx(self.out) + _xlogx(self.into + l.sum() + s) - _xlogx(self.into)
        b = int(np.argmax(gain[:-1]))
        if gain[b] <= gain[c] + 1e-9:
            b = c
        self._shift(b, r, l, s, 1)
        return b


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """Class of each item.  The last item (the end) keeps the last class to itself.

    Each item in turn leaves its class and joins the one in which the likelihood of the class
    bigrams is greatest; sweeps end when none moves.
    """
    n = len(bigrams)
    m = bigrams.astype(np.float64)
    weight = m.sum(axis=0) + m.sum(axis=1)
    order = np.argsort(-weight[:-1], kind="stable")
    of = np.zeros(n, np.int64)
    of[order] = np.arange(n - 1) % (classes - 1)
    of[-1] = classes - 1
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    right, left = m @ member, m.T @ member  # by item: counts to and from each class
    state = ClassBigrams(member.T @ right)
    own = np.diag(m)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            a, r, l = of[w], right[w].copy(), left[w].copy()
            r[a] -= own[w]
            l[a] -= own[w]
            b = state.move(int(a), r, l, own[w])
            if b != a:
                of[w] = b
                moved += 1
                right[:, a] -= m[:, w]
                right[:, b] += m[:, w]
                left[:, a] -= m[w, :]
                left[:, b] += m[w, :]
        if not moved:
            break
    return of


# --- all words ---------------------------------------------------------------------------------------


@dataclass
class Classes:
    """What the workers are sent: the head's words with counts and classes, and the endings' classes."""

    head: Head
    of_head: np.ndarray
    of_ending: np.ndarray
    number: int


def likeliest(g: np.ndarray):  # noqa: ANN201
    """A function from counts (word; before each class, then after each) to the class that gains most."""
    k = len(g)
    joint = np.log(g + 0.5)
    before = joint - np.log(g.sum(axis=1, keepdims=True) + 0.5 * k)  # the word's class, then its neighbour's
    after = joint - np.log(g.sum(axis=0, keepdims=True) + 0.5 * k)
    weight = np.concatenate([before.T, after])[:, : k - 1]  # the last class is the end's
    return lambda counts: np.argmax(counts @ weight, axis=1)


#: Words by buckets, a row for each bucket and kind that some texts have: 0 words of the head (their places in ``ids``),
#: 1 words beyond it of training texts, 2 of held-out ones (with the texts' ids and the words' numbers there; ids as steps).  Bytes and
#: lengths of the words, how many classes each has beside it, and these classes (after a word, then before it).
_CONTEXTS = "bucket long, kind int, words binary, lens binary, ids binary, numbers binary, sizes binary, slots binary"
#: By parts of the texts: texts' ids as steps, words' numbers there, count << 16 | class + 1 (0: the ending's).  Part -1: places
#: in the head and their new classes; part -2: a number of distinct words beyond the head, by class.
_FOUND = "part long, ids binary, numbers binary, found binary, n long, class int"


def word_classes(placed: DataFrame, classes: Classes, g: np.ndarray, parts: int) -> DataFrame:
    """The sweep over all words but own items, by their contexts in all training texts.

    Both ways words travel in few rows: what a task has for one bucket of words (by their hash), or for one of the
    ``parts`` of the texts, is one row of packed numbers.  A bucket's words are decided together; of held-out texts,
    which only look up what training has, 16 MB at a time are held.
    """
    shared = placed.sparkSession.sparkContext.broadcast((classes, g))
    k = classes.number
    often = int((classes.head.counts >= LEAST).sum())
    width = 2 * k
    own = len(classes.head.words) // parts + 1  # at most so many places of the head are in a bucket

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, _ = shared.value
        names = ["bucket", "kind", "words", "lens", "ids", "numbers", "sizes", "slots"]
        codes: list[np.ndarray] = []
        held_back: list[list[np.ndarray]] = []
        size = weight = 0

        def rows(group: np.ndarray, lens: np.ndarray, raw: np.ndarray, ids: np.ndarray, numbers: np.ndarray, sizes: np.ndarray, slots: np.ndarray) -> pa.RecordBatch:
            """Rows sorted by ``group``, bucket and kind."""
            edges = _changes(group)
            first = group[edges[:-1]]
            at, inside = _edges(sizes), _edges(lens)
            packed = [_packed(raw, inside[edges] if len(lens) else np.zeros(len(edges))), _packed(lens, edges if len(lens) else np.zeros(len(edges)))]
            packed += [_packed(_steps(ids, edges), edges), _packed(numbers, edges if len(numbers) else np.zeros(len(edges))), _packed(sizes, edges), _packed(slots, at[edges])]
            return pa.RecordBatch.from_arrays([pa.array(first // 3), pa.array((first % 3).astype(np.int32)), *packed], names)

        def head_rows() -> pa.RecordBatch:
            code = np.sort(np.concatenate(codes))
            word = code // width
            edges = _changes(word)
            word = word[edges[:-1]]
            none = np.empty(0, np.int32)
            return rows(word // own * 3, none, none, word % own * parts + word // own, none, np.diff(edges).astype(np.int32), (code % width).astype(np.uint16))

        def tail_rows() -> pa.RecordBatch:
            group, lens, raw, ids, numbers, sizes, slots = (np.concatenate(x) for x in zip(*held_back))
            order = np.argsort(group, kind="stable")
            raw = raw[_ranges(_edges(lens)[order], lens[order])]
            slots = slots[_ranges(_edges(sizes)[order], sizes[order])]
            return rows(group[order], lens[order], raw, ids[order], numbers[order], sizes[order], slots)

        for batch in slices(batches, 2048):
            ids, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            words = Placed.of(batch.column(2), batch.column(3), batch.column(6))
            raw, lens = _flat(batch.column(4), "u1")[0], _flat(batch.column(5), "<i4")[0]
            of = words.values(classes.of_head, classes.of_ending[words.ends - OWN_ITEMS])
            before, after, _ = _neighbours(of, words.edges, k - 1)
            known = np.flatnonzero((words.at >= OWN_ITEMS) & (words.at < often) & ~held[words.text])
            place = words.at[known].astype(np.int64)
            place = (place % parts * own + place // parts) * width
            codes += [place + after[known], place + k + before[known]]
            size += 2 * len(known)
            if len(lens):
                learnt = ~held[words.text[words.beyond]]
                at, row = words.beyond[learnt], words.row[learnt]
                row = np.concatenate([row, row])
                slots = np.concatenate([after[at], before[at] + k])[np.argsort(row, kind="stable")].astype(np.uint16)
                new = np.diff(words.new)
                bucket = np.fromiter(map(zlib.crc32, _tokens(lens, raw).to_pylist()), np.int64, len(lens)) % parts
                numbers = (np.arange(len(lens)) - np.repeat(words.new[:-1], new)).astype(np.int32)
                held_back.append([bucket * 3 + 1 + np.repeat(held, new), lens, raw, np.repeat(ids, new), numbers, np.bincount(row, minlength=len(lens)).astype(np.int32), slots])
                weight += 16 * len(lens) + 2 * len(slots) + len(raw)
            if size > 8_000_000:
                yield head_rows()
                codes, size = [], 0
            if weight > 32_000_000:
                yield tail_rows()
                held_back, weight = [], 0
        if size:
            yield head_rows()
        if held_back:
            yield tail_rows()

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket and kind."""
        classes, g = shared.value
        best, kinds = likeliest(g), np.zeros(k, np.int64)
        names = ["part", "ids", "numbers", "found", "n", "class"]
        ready: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            ids, numbers, found = (np.concatenate(x) for x in zip(*ready))
            order = np.lexsort((ids, ids % parts))
            ids, numbers, found = ids[order], numbers[order], found[order]
            edges = _changes(ids % parts)
            m = len(edges) - 1
            return pa.RecordBatch.from_arrays([pa.array(ids[edges[:-1]] % parts), _packed(_steps(ids, edges), edges), _packed(numbers, edges), _packed(found, edges), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())], names)

        def likely(word: np.ndarray, sizes: np.ndarray, slots: np.ndarray, m: int, some: np.ndarray) -> np.ndarray:
            """The best classes of ``some`` of ``m`` words, from rows of words and their classes beside them."""
            rank = np.full(m, -1, np.int64)
            rank[some] = np.arange(len(some))
            word = rank[np.repeat(word, sizes)]
            slots = slots[word >= 0]
            word = word[word >= 0]
            order = np.argsort(word, kind="stable")
            word, slots = word[order], slots[order]
            out = np.empty(len(some), np.int64)
            for at in range(0, len(some), 4096):
                n = min(4096, len(some) - at)
                a, b = np.searchsorted(word, [at, at + n])
                out[at : at + n] = best(np.bincount((word[a:b] - at) * width + slots[a:b], minlength=n * width).reshape(n, width).astype(np.float64))
            return out

        def column(pieces: list[pa.RecordBatch], i: int, kind: str) -> np.ndarray:
            return np.concatenate([_flat(x.column(i), kind)[0] for x in pieces])

        def ids_of(pieces: list[pa.RecordBatch]) -> np.ndarray:
            return np.concatenate([_summed(*_flat(x.column(4), "<i8")) for x in pieces])

        def heads(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
            place, word = np.unique(ids_of(pieces), return_inverse=True)
            of = likely(word, column(pieces, 6, "<i4"), column(pieces, 7, "<u2"), len(place), np.arange(len(place)))
            all_of = np.array([0, len(place)])
            return pa.RecordBatch.from_arrays([pa.array([-1]), _packed(place, all_of), pa.nulls(1, pa.binary()), _packed(of, all_of), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32())], names)

        def learnt(pieces: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
            """Training's words of a bucket with what is found of them."""
            listed = _tokens(column(pieces, 3, "<i4"), column(pieces, 2, "u1")).dictionary_encode()
            word, m = listed.indices.to_numpy(), len(listed.dictionary)
            sizes = column(pieces, 6, "<i4")
            n = np.bincount(word, sizes, m).astype(np.int64) // 2
            of = np.full(m, -1, np.int64)
            big = np.flatnonzero(n >= LEAST)
            of[big] = likely(word, sizes, column(pieces, 7, "<u2"), m, big)
            endings = np.fromiter(map(_ending, listed.dictionary.to_pylist()), np.int64, m) - OWN_ITEMS
            np.add.at(kinds, np.where(of >= 0, of, classes.of_ending[endings]), 1)
            found = n << 16 | of + 1
            ready.append((ids_of(pieces), column(pieces, 5, "<i4"), found[word]))
            return listed.dictionary, found

        bucket, last, pieces = -1, -1, []
        words: pa.Array | None = None
        found = np.empty(0, np.int64)

        def ended() -> Iterator[pa.RecordBatch]:
            """What is done when all rows of a kind in a bucket are there."""
            nonlocal words, found, size
            if pieces and last == 0:
                yield heads(pieces)
            elif pieces:
                words, found = learnt(pieces)
                size += len(ready[-1][0])

        for batch in batches:
            place, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = _changes(place * 3 + kind)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if (place[a], kind[a]) != (bucket, last):
                    yield from ended()
                    pieces = []
                    if place[a] != bucket:
                        words = None
                    bucket, last = int(place[a]), int(kind[a])
                if last < 2:
                    pieces.append(batch.slice(a, b - a))
                    continue
                # What training doesn't have is left out; the words' index is made once for rows of 16 MB.
                for rows in slices(iter([batch.slice(a, b - a)]), 1 << 20) if words is not None else ():
                    piece = [rows]
                    at = pc.index_in(_tokens(column(piece, 3, "<i4"), column(piece, 2, "u1")), value_set=words)
                    some = at.is_valid().to_numpy(zero_copy_only=False)
                    ready.append((ids_of(piece)[some], column(piece, 5, "<i4")[some], found[at.drop_null().to_numpy()]))
                    size += len(ready[-1][0])
                if size > 1_000_000:
                    yield flushed()
                    ready, size = [], 0
        yield from ended()
        if size:
            yield flushed()
        some = np.flatnonzero(kinds)
        none = [pa.nulls(len(some), pa.binary())] * 3
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), -2)), *none, pa.array(kinds[some]), pa.array(some.astype(np.int32))], names)

    words = placed.select("_id", "_held", "low", "high", "words", "lens", "ends").mapInArrow(contexts, _CONTEXTS)
    return words.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(decided, _FOUND)


@dataclass
class BrownModel:
    """A fitted model; ``tail`` has the words beyond the head.

    Its rows (key, token, n, class): for every text, known by ``key``, its distinct words beyond the head that training
    has, with their counts and classes there (class -1 is the ending's).
    """

    classes: Classes
    tail: DataFrame
    transition: np.ndarray  # log10 P(class | class before)
    below: np.ndarray  # log10 of the emission's denominator, by class
    tokens: int
    words: int
    texts: int
    delta: float


def _total(table: DataFrame, column: str, size: int) -> np.ndarray:
    """Column ``n`` summed by a small whole-number column."""
    out = np.zeros(size, np.int64)
    for r in table.groupBy(column).agg(F.sum("n").alias("n")).collect():
        out[r[column]] = r["n"]
    return out


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Placed, np.ndarray]]:
    """Some texts at a time with their words, and what is found of their new words (0: nothing).

    Rows come sorted by part and kind, what is found (kind 0) before the texts.  Columns: part, kind, ids, numbers,
    found; the text's id, places (two halves) and endings.
    """
    part, held = -1, []
    known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    none = np.empty(0, np.int64)
    for batch in batches:
        place, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = _changes(place * 2 + kind)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if place[a] != part:
                part, held, known = int(place[a]), [], None
            run = batch.slice(a, b - a)
            if kind[a] == 0:
                held.append((_summed(*_flat(run.column(2), "<i8")), _flat(run.column(3), "<i4")[0], _flat(run.column(4), "<i8")[0]))
                continue
            if known is None:
                ids, numbers, found = (np.concatenate(x) for x in zip(*held)) if held else (none, none, none)
                order = np.argsort(ids, kind="stable")
                known, held = (ids[order], numbers[order], found[order]), []
            ids, numbers, found = known
            for texts in slices(iter([run]), 2048):
                words = Placed.of(texts.column(6), texts.column(7), texts.column(8))
                mine = texts.column(5).to_numpy()
                first = np.searchsorted(ids, mine)
                sizes = np.searchsorted(ids, mine, "right") - first
                at = _ranges(first, sizes)
                of_new = np.zeros(len(words.ends), np.int64)
                of_new[np.repeat(words.new[:-1], sizes) + numbers[at]] = found[at]
                yield texts, words, of_new


def fit_and_score(
    documents: DataFrame, held_out: Column, keep: list[Column], *, most_head: int = HEAD, sweeps: int = 8, alpha: float = 5.0, delta: float = 0.5
) -> tuple[DataFrame, BrownModel]:
    """``keep`` columns of every row with n_tokens, n_known, train_tokens, base_score, score and perplexity; and the model.

    The model learns from the rows where ``held_out`` is false.
    """
    spark = documents.sparkSession
    counts = settle(word_counts(documents.where(~held_out)), "word-counts")
    head, _ = head_of(counts, most_head)
    names = [f"_k{i}" for i in range(len(keep))]
    held = F.coalesce(held_out, F.lit(True))
    source = documents.select(text_or_empty().alias("_text"), F.monotonically_increasing_id().alias("_id"), held.alias("_held"), *[c.alias(n) for c, n in zip(keep, names)])
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    placed = settle(place_words(source, head), "lm-places")  # from here on a row has one id, whoever reads it
    bigrams = item_bigrams(placed.where("NOT _held"), head)
    texts, tokens = int(bigrams[:, END_ITEM].sum()), int(bigrams.sum())
    words = counts.count() + (texts > 0)
    k = classes_for(tokens)
    of = exchange(bigrams, k, sweeps)
    member = np.zeros((ITEMS, k))
    member[np.arange(ITEMS), of] = 1
    g = member.T @ bigrams @ member
    first = Classes(head, of[head.items()].astype(np.int64), of[OWN_ITEMS:END_ITEM], k)
    parts = tokens // PART + 1
    found = settle(word_classes(placed, first, g, parts), "lm-words")
    moved = found.where("part = -1").select("ids", "found").toArrow().combine_chunks()  # at most the head
    of_head = first.of_head.copy()
    for batch in moved.to_batches():
        of_head[_flat(batch.column(0), "<i8")[0]] = _flat(batch.column(1), "<i8")[0]
    classes = Classes(head, of_head, first.of_ending, k)

    # Every text's classes, and what of its score doesn't depend on transitions.
    shared = spark.sparkContext.broadcast(classes)
    base_below = math.log10(tokens + words + 1)

    def met(columns: list[str]) -> DataFrame:
        """Each part's rows of what is found, then its texts, as ``_met`` reads them; more columns of texts follow."""
        nothing = [F.lit(None).cast("binary").alias(x) for x in ("ids", "numbers", "found")]
        of_texts = ["_id", "low", "high", "ends", *columns]
        left = found.where("part >= 0").select("part", F.lit(0).alias("kind"), "ids", "numbers", "found", *[F.lit(None).cast(placed.schema[x].dataType).alias(x) for x in of_texts])
        right = placed.select((F.col("_id") % parts).alias("part"), F.lit(1).alias("kind"), *nothing, *of_texts)
        return left.union(right).repartition("part").sortWithinPartitions("part", "kind")

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        counts = classes.head.counts
        logs = [np.log10(counts + x) for x in (1.0, delta)]
        for batch, words, value in _met(batches):
            n, c = value >> 16, (value & 0xFFFF) - 1
            of = words.values(classes.of_head, np.where(c >= 0, c, classes.of_ending[words.ends - OWN_ITEMS]))
            m = batch.num_rows
            n_tokens = np.diff(words.edges) + 1
            total = lambda head, new: np.bincount(words.text, words.values(head, new), m)  # noqa: B023, E731
            if tokens:
                n_known = total((counts > 0).astype(np.float64), n > 0).astype(np.int64) + (texts > 0)
                base = total(logs[0], np.log10(n + 1.0)) + math.log10(texts + 1) - n_tokens * base_below
                own = total(logs[1], np.log10(n + delta))
            else:
                n_known, base, own = np.zeros(m, np.int64), np.zeros(m), np.zeros(m)
            columns = [*(batch.column(i) for i in range(9, batch.num_columns)), _packed(of.astype("<u2"), words.edges), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(own)]
            yield pa.RecordBatch.from_arrays(columns, ["_held", *names, "_of", "n_tokens", "n_known", "base_score", "_own"])

    def words_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, value in _met(batches):
            all_words = _tokens(_flat(batch.column(10), "<i4")[0], _flat(batch.column(9), "u1")[0]).cast(pa.binary())
            some = np.flatnonzero(value)
            keys = np.repeat(batch.column(5).to_numpy(), np.diff(words.new))[some]
            yield pa.RecordBatch.from_arrays([pa.array(keys), all_words.take(pa.array(some)), pa.array(value[some] >> 16), pa.array(((value[some] & 0xFFFF) - 1).astype(np.int32))], ["key", "token", "n", "class"])

    tail = met(["words", "lens"]).mapInArrow(words_found, "key long, token binary, n long, class int")
    schema = "_held boolean, " + "".join(f"{n} {kinds[n]}, " for n in names) + "_of binary, n_tokens long, n_known long, base_score double, _own double"
    scored_parts = settle(met(["_held", *names]).mapInArrow(resolved, schema), "lm-classes")

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(k * k, np.int64)
        for batch in slices(batches, 4096):
            of, edges = _flat(batch.column(0), "<u2")
            _, after, first = _neighbours(of, edges, k - 1)
            seen += np.bincount(np.concatenate([of * np.int64(k) + after, (k - 1) * k + first]), minlength=k * k)
        code = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(seen[code])], ["code", "n"])

    t = _total(scored_parts.where("NOT _held").select("_of").mapInArrow(transitions, "code long, n long"), "code", k * k).reshape(k, k)
    distinct = np.bincount(classes.of_head, minlength=k)
    distinct = distinct + _total(found.where("part = -2"), "class", k)
    size = t.sum(axis=0)
    share = (size + 1) / (size.sum() + k)
    transition = np.log10((t + alpha * share) / (t.sum(axis=1, keepdims=True) + alpha))
    below = np.log10(np.maximum(size + delta * (distinct + 1), 1e-300))
    # The end is alone in its class: its emission is certain.
    shares = spark.sparkContext.broadcast((transition, below))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, below = shares.value
        for batch in slices(batches, 4096):
            of, edges = _flat(batch.column(0), "<u2")
            _, after, first = _neighbours(of, edges, k - 1)
            text = np.repeat(np.arange(batch.num_rows), np.diff(edges))
            out = transition[k - 1, first] + np.bincount(text, transition[of, after] - below[of], batch.num_rows) + batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2, batch.num_columns)), pa.array(out if tokens else np.zeros(batch.num_rows))], [*names, "n_tokens", "n_known", "base_score", "score"])

    schema = "".join(f"{n} {kinds[n]}, " for n in names) + "n_tokens long, n_known long, base_score double, score double"
    done = scored_parts.select("_of", "_own", *names, "n_tokens", "n_known", "base_score").mapInArrow(scored, schema)
    scores = done.select(*names, "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score").withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    return scores, BrownModel(classes, tail, transition, below, tokens, words, texts, delta)


def op8(documents: DataFrame) -> DataFrame:
    held = fold("doc_id", 7) == 2
    scores, _ = fit_and_score(documents, held, [F.col("doc_id"), held])
    return scores.withColumnsRenamed({"_k0": "doc_id", "_k1": "held_out"})
