"""Near-duplicate groups by five-word shingles: wide SimHash prints find pairs, exact similarity decides.

Two texts are near when the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
A print has ``BITS`` bits, each set in over half of the set's hashes; two texts of similarity J
differ in a share acos(2 J / (1 + J)) / pi of them at most, 0.151 at 0.8: 39 of 256 bits, with a
deviation of 6, so ``RADIUS`` is met by all but one pair in thousands.  No code on the whole print
reaches that radius with few anchors: the Hamming code on pieces of 31 bits, as operator 5 has it, would
need about 400 replicas of each print for the same recall.  Each print is therefore replicated to
``TABLES`` anchors, each made of ``SAMPLED`` of its bits: a pair at 0.8 shares one with probability
1 - (1 - 0.849^18)^64 = 0.97, at 0.85 with over 0.99.  With more prints anchors have more bits, so that few
meet there by chance, and there are more of them, for the same recall.

Prints of different groups that meet at an anchor within the radius are candidates, and every link is checked on the
shingles exactly.  Groups are the components of the links, so a pair need not be checked once its texts
are in one group.  First, prints that stand together in two sorted orders, one after the other, are linked to
the first of their block, and those to the first of a larger one, which joins large groups of copies without
comparing all of them, and into stars rather than chains.  Then candidates are gathered, not listed: an anchor
gives each print the smallest one that its candidates lead to, and the components of these pairs are *families*.  A
family's shingle sets meet in one task, which compares every pair within the radius that isn't in one group
yet and gives one link for two groups that it joins.  So rows grow with the prints, never with their pairs.

A family of over ``SPLIT`` rows or ``HASHES`` hashes is cut into blocks.  Each block is compared with itself, then
``NEAREST`` rows of each group with each other, and where groups stay apart, all blocks with all: those of the
largest group only with the other groups'.  Likewise an anchor where one group has over ``SPLIT`` rows is dealt
out: that group's rows over parts, the others to every part.

Not lossless: a pair may share no anchor.

Defined results: texts of equal shingle sets are copies, null and empty texts too; a text of five
words or fewer is one shingle; case and white space don't count; repeated rows are copies; an empty
table gives no rows.  Of rows that are equal in id and text any one may stand for them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, slices, text_or_empty, utf8
from .components import FEW, connected_components, joined

SHINGLE, LEAST = 5, 0.8
SEED = 42
WORDS = 4
BITS = 64 * WORDS
RADIUS = 60
#: Radius in which prints that stand together are linked: few pairs so near fail the exact check.
CLOSE = 40
TABLES, SAMPLED = 64, 18
NEAREST, SPLIT = 4, 8192
#: Hashes of a block's sets, all together.
HASHES = 2_000_000
#: Rows of a block in a sorted order; a larger block has as many blocks.
BESIDE = 64
_PRINT = [f"p{k}" for k in range(WORDS)]


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' 64-bit hashes in order."""
    words = text.lower().split()  # lower() of bytes changes A-Z only
    if not words:
        return np.empty(0, np.uint64)
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(flat, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(size + 1) - 1
    return np.unique(np.array([digest(flat[a:b], SEED) for a, b in zip((stops - size).tolist(), stops[shingle - 1 :].tolist())], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def wide_print(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 16_384):
        part = hashes[at : at + 16_384]
        mixed = np.empty((len(part), WORDS), np.uint64)
        for k in range(WORDS):
            h = (part + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed[:, k] = h ^ (h >> np.uint64(31))
        total += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keys, sizes, prints = [], [], np.empty((batch.num_rows, WORDS), np.uint64)
        for i, text in enumerate(utf8(batch.column(0))):
            hashes = shingle_set(text)
            keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            sizes.append(len(hashes))
            prints[i] = wide_print(hashes)
        names = [*batch.schema.names[1:], "key", "size", *_PRINT]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *(pa.array(prints[:, k].view(np.int64)) for k in range(WORDS))], names)


def samples(prints: int) -> np.ndarray:
    """The bits of each anchor, for so many prints: an anchor expects 2,048 by chance at most."""
    bits = max(SAMPLED, math.ceil(math.log2(max(prints, 1) / 2048)))
    share = 1 - math.acos(2 * LEAST / (1 + LEAST)) / math.pi  # equal bits of a pair at LEAST
    missed = (1 - share**SAMPLED) ** TABLES
    tables = math.ceil(math.log(missed) / math.log(1 - share**bits) - 1e-9)
    return np.stack([np.random.default_rng(20_261_126 + t).permutation(BITS)[:bits] for t in range(tables)])


def _matrix(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.column_stack([batch.column(at + k).to_numpy() for k in range(WORDS)]).view(np.uint64)


def _replicate(places: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 20_000):
            prints = _matrix(batch, 2)
            for t, bits in enumerate(places):
                code = np.full(len(prints), t, np.uint64)
                for place in bits.tolist():
                    code = (code << np.uint64(1)) | ((prints[:, place // 64] >> np.uint64(place % 64)) & np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), *batch.columns], ["anchor", "node", "root", *_PRINT])

    return run


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, root, print) sorted by print: close pairs of different groups, each row with its block's first,
    those with their larger block's, and these in a row."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        node, root, prints, row = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch, 2), np.arange(batch.num_rows)
        small, large = row - row % BESIDE, row - row % BESIDE**2
        heads, firsts = np.flatnonzero(small == row), np.flatnonzero(large == row)
        i = np.concatenate([row, heads, firsts[1:]])
        j = np.concatenate([small, large[heads], firsts[:-1]])
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        ok = _far(prints, i, j) <= CLOSE
        a, b = node[i[ok]], node[j[ok]]
        if last is not None and last[1] != root[0] and np.bitwise_count(last[2] ^ prints[0]).sum() <= CLOSE:
            a, b = np.append(a, node[0]), np.append(b, last[0])
        last = node[0], root[0], prints[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _far(prints: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1, dtype=np.int64)


def _together(run: np.ndarray, node: np.ndarray, root: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within each run (anchor): each row with the smallest node that close pairs of different groups lead to."""
    size = np.bincount(run)
    pairs = [np.empty((0, 2), np.int64)]
    # Small runs shift by shift, all at once.
    alive, shift = np.flatnonzero(size[run] <= 512), 1
    while len(alive):
        alive = alive[alive + shift < len(run)]
        alive = alive[run[alive] == run[alive + shift]]
        at = alive[root[alive] != root[alive + shift]]
        at = at[_far(prints, at, at + shift) <= RADIUS]
        if len(at):
            pairs.append(np.column_stack([at, at + shift]))
        shift += 1
    # Large ones row by row: rows of the largest group come last and are never compared with each other.
    for r in np.flatnonzero(size > 512).tolist():
        rows = np.flatnonzero(run == r)
        _, group, count = np.unique(root[rows], return_inverse=True, return_counts=True)
        if len(count) < 2:
            continue
        rank = np.lexsort((group, count[group]))
        rows, group = rows[rank], group[rank]
        label = np.arange(len(rows))
        for i in range(len(rows) - int(count[group[-1]])):
            # Rows that are in one family already need no pair.
            other = i + 1 + np.flatnonzero((group[i + 1 :] != group[i]) & (label[i + 1 :] != label[i]))
            near = other[_far(prints, rows[i], rows[other]) <= RADIUS]
            if len(near):
                pairs.append(np.column_stack([np.full(len(near), rows[i]), rows[near]]))
                label[np.isin(label, label[near])] = label[i]
    i, j = np.concatenate(pairs).T
    label = joined(len(run), i, j)
    least = node.copy()
    np.minimum.at(least, label, node)
    least = least[label]
    apart = least != node
    return node[apart], least[apart]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by anchor and part; one that a batch ends in is carried to the next."""
    held: list[pa.RecordBatch] = []

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        anchor, part, node, root = (table.column(i).to_numpy() for i in range(4))
        run = np.concatenate([[0], np.cumsum((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _together(run, node, root, _matrix(table, 4))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        last = (anchor == anchor[-1]) & (part == part[-1])
        cut = int(np.argmax(last))
        same = bool(held) and held[-1].column(0)[0].as_py() == anchor[0] and held[-1].column(1)[0].as_py() == part[0]
        if held and not same:
            yield flush(held)
            held = []
        if cut:
            yield flush([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield flush(held)


def _links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """Of rows (side, node, root, print, set): one near pair for each two groups that it joins.  Rows of side 0 are
    compared with each other, those of sides 1 and 2 with the other side."""
    side, node, root = (np.array([r[k] for r in rows]) for k in range(3))
    prints, size = np.stack([r[3] for r in rows]), np.array([len(r[4]) for r in rows])
    code = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True)[1]
    codes = np.split(code, np.cumsum(size)[:-1])
    own = np.zeros(len(code) + 1, bool)
    for i in range(len(rows) - 1):
        j = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 0)))
        j = j[_far(prints, i, j) <= RADIUS]
        j = j[np.minimum(size[j], size[i]) / np.maximum(np.maximum(size[j], size[i]), 1) >= LEAST]  # no set of these is empty
        if not len(j):
            continue
        own[codes[i]] = True
        both = np.add.reduceat(own[np.concatenate([codes[k] for k in j])], np.cumsum(size[j]) - size[j], dtype=np.int64)
        own[codes[i]] = False
        j = j[both / (size[i] + size[j] - both) >= LEAST]
        found, first = np.unique(root[j], return_index=True)
        for k in j[first].tolist():
            yield int(node[i]), int(node[k])
        root[np.isin(root, found)] = root[i]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family, part, side, node, root, print, text) arrive sorted by family and part: the links within each."""
    last, rows = None, []
    for batch in slices(batches):
        found: list[tuple[int, int]] = []
        plain = [batch.column(k).to_pylist() for k in range(5)]
        prints, texts = _matrix(batch, 5), utf8(batch.column(5 + WORDS))
        for i, key in enumerate(zip(*plain[:2])):
            if key != last:
                found += _links(rows) if len(rows) > 1 else []
                last, rows = key, []
            rows.append((*(x[i] for x in plain[2:]), prints[i], shingle_set(texts[i])))
        yield _pairs(found)
    if len(rows) > 1:
        yield _pairs(_links(rows))


def _pairs(found) -> pa.RecordBatch:  # noqa: ANN001
    table = np.array(list(found), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table.min(axis=1)), pa.array(table.max(axis=1))], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t).tobytes() for t in utf8(batch.column(1))], pa.binary())], ["node", "hashes"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [[np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3)]
        near = pa.array([similarity(x, y) >= LEAST for x, y in zip(*sets)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(near)


_LONGS = ", ".join(f"{p} long" for p in _PRINT)


def sorted_pairs(prints: DataFrame, first: int) -> DataFrame:
    """(a, b): close prints of different groups that stand together when sorted by their words from the ``first`` on."""
    order = [f"p{(first + j) % WORDS}" for j in range(WORDS)]
    rows = prints.select("node", "root", *_PRINT).repartitionByRange(*order, "node").sortWithinPartitions(*order, "node")
    return rows.mapInArrow(_beside, "a long, b long").distinct()


def families(prints: DataFrame, total: int, split: int = SPLIT) -> DataFrame:
    """(node, root): the prints that are candidates of another group's (``root``), and the smallest node of their family."""
    replicas = prints.select("node", "root", *_PRINT).mapInArrow(_replicate(samples(total)), f"anchor long, node long, root long, {_LONGS}")
    # A group is as large at an anchor as it is at most: only rows of large groups need counting.
    large = prints.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > split).select(F.col("root").alias("_large"))
    if large.isEmpty():
        dealt = replicas.withColumn("part", F.lit(0))
    else:
        counted = prints.join(large, F.col("root") == F.col("_large"), "left_semi").select("node", "root", *_PRINT).mapInArrow(_replicate(samples(total)), f"anchor long, node long, root long, {_LONGS}")
        sizes = counted.groupBy("anchor", "root").agg(F.count("*").alias("n")).where(F.col("n") > split)
        hot = sizes.groupBy("anchor").agg(F.max(F.struct("n", "root")).alias("_h")).select(F.col("anchor").alias("_anchor"), F.col("_h.root").alias("_hot"), F.ceil(F.col("_h.n") / split).cast("int").alias("_parts"))
        met = replicas.join(hot, F.col("anchor") == F.col("_anchor"), "left")
        own = F.array(F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"))
        parts = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).when(F.col("root") == F.col("_hot"), own).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
        dealt = met.withColumn("part", F.explode(parts))
    dealt = dealt.select("anchor", "part", "node", "root", *_PRINT)
    return connected_components(dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_meet, "a long, b long"), few=FEW)


def _blocks(split: int) -> Column:
    """Blocks of so many rows (``_n``) and hashes (``_size``): 1 at least."""
    return F.greatest(F.ceil(F.col("_n") / split), F.ceil(F.col("_size") / HASHES), F.lit(1)).cast("int")


def _dealt(rows: DataFrame, split: int) -> DataFrame:
    """``rows`` with the part of their family that they are compared in: their block."""
    sizes = rows.groupBy("family").agg(F.count("*").alias("_n"), F.sum("size").alias("_size")).select(F.col("family").alias("_family"), _blocks(split).alias("_blocks"))
    met = rows.join(sizes, F.col("family") == F.col("_family"))
    return met.withColumn("part", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")).withColumn("side", F.lit(0)).drop("_family")


def _all_dealt(rows: DataFrame, split: int) -> DataFrame:
    """``rows`` with all parts in which their block meets another: blocks of the largest group those of the other
    groups, and these each other."""
    groups = rows.groupBy("family", "root").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    hot = F.max(F.struct("_n", "_size", "root"))
    sums = groups.groupBy("family").agg(hot.alias("_hot"), F.sum("_n").alias("_all"), F.sum("_size").alias("_all_size"))
    kinds = sums.select(F.col("family").alias("_family"), F.col("_hot.root").alias("_largest"), F.struct("_hot._n", "_hot._size").alias("_h"), F.struct((F.col("_all") - F.col("_hot._n")).alias("_n"), (F.col("_all_size") - F.col("_hot._size")).alias("_size")).alias("_o"))
    for k in "ho":
        kinds = kinds.select("*", f"_{k}.*").withColumn(f"_{k}", _blocks(split)).drop("_n", "_size")
    met = rows.join(kinds, F.col("family") == F.col("_family"))
    met = met.withColumn("_b", F.pmod(F.xxhash64("node"), F.when(F.col("root") == F.col("_largest"), F.col("_h")).otherwise(F.col("_o"))).cast("int"))
    own = F.expr("transform(sequence(0, _o - 1), j -> struct(_b * _o + j AS part, 1 AS side))")
    others = F.expr(
        "concat(transform(sequence(0, _h - 1), i -> struct(i * _o + _b AS part, 2 AS side)), "
        "transform(sequence(0, _o - 1), k -> struct(_h * _o + least(_b, k) * _o + greatest(_b, k) AS part, CASE WHEN k = _b THEN 0 WHEN _b < k THEN 1 ELSE 2 END AS side)))"
    )
    return met.withColumn("_p", F.explode(F.when(F.col("root") == F.col("_largest"), own).otherwise(others))).select("*", "_p.*").drop("_p", "_family")


def _compared(rows: DataFrame) -> DataFrame:
    placed = rows.select("family", "part", "side", "node", "root", *_PRINT, "text").repartition("family", "part").sortWithinPartitions("family", "part")
    return settle(placed.mapInArrow(_compare, "a long, b long"), "links")


def join_families(grouped: DataFrame, total: int, documents: DataFrame, nearest: int = NEAREST, split: int = SPLIT) -> DataFrame:
    """``grouped`` with the groups joined that have near texts in one family."""
    found = families(grouped, total, split).select(F.col("node").alias("_node"), F.col("root").alias("family"))
    ids = grouped.join(found, F.col("node") == F.col("_node")).select("node", "root", "family", "size", *_PRINT, F.col("_first._k1").alias("_j1"), F.col("_first._k2").alias("_j2"))
    rows = settle(_with_text(ids, documents).drop("_j1", "_j2"), "families")
    dealt = _dealt(rows, split)
    grouped = _regrouped(grouped, _compared(dealt))
    cut = dealt.where("_blocks > 1")
    if cut.isEmpty():
        return grouped
    cut = cut.drop("_blocks", "part", "side")
    few = Window.partitionBy("family", "root").orderBy("node")
    heads = _apart(cut, grouped).withColumn("_k", F.row_number().over(few)).where(F.col("_k") <= nearest)
    grouped = _regrouped(grouped, _compared(_dealt(heads, split)))
    return _regrouped(grouped, _compared(_all_dealt(_apart(cut, grouped), split)))


def _apart(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """``rows`` with their groups as they are now, of the families that have more than one."""
    now = grouped.select(F.col("node").alias("_now"), F.col("root").alias("_root"))
    met = rows.drop("root").join(now, F.col("node") == F.col("_now")).withColumnRenamed("_root", "root").drop("_now")
    many = met.groupBy("family").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select(F.col("family").alias("_family"))
    return met.join(many, F.col("family") == F.col("_family"), "left_semi")


def _with_text(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows with ``_j1`` and ``_j2`` and the text that these tell, once for a node, however often its row is repeated."""
    texts = documents.select(text_or_empty().alias("text"), *_key())
    return texts.join(ids, (F.col("_k1") == F.col("_j1")) & (F.col("_k2") == F.col("_j2"))).drop("_k1", "_k2").dropDuplicates(["node"])


def links_of(pairs: DataFrame, best: DataFrame, documents: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose texts are near by their shingles."""
    needed = pairs.select(F.col("a").alias("_need")).unionByName(pairs.select(F.col("b").alias("_need"))).distinct()
    ids = best.join(needed, best["node"] == needed["_need"], "left_semi").select("node", F.col("_first._k1").alias("_j1"), F.col("_first._k2").alias("_j2"))
    met = _with_text(ids, documents).select("node", "text")
    sets = settle(met.mapInArrow(_sets, "node long, hashes binary"), "shingles")
    left, right = (sets.select(F.col("node").alias(f"_{k}"), F.col("hashes").alias(f"h{k}")) for k in "ab")
    both = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).select("a", "b", "ha", "hb")
    return settle(both.mapInArrow(_exact, "a long, b long"), "links")


def _key() -> list:
    return [F.xxhash64("doc_id", text_or_empty()).alias("_k1"), F.xxhash64(text_or_empty(), F.lit(1)).alias("_k2")]


def keep_one(documents: DataFrame, nearest: int = NEAREST, split: int = SPLIT) -> DataFrame:
    """The rows kept of each near-duplicate group: one, of the smallest id (null ids last)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(text_or_empty().alias("text"), "doc_id", *_key())
    found = rows.mapInArrow(_prints, f"doc_id {kind}, _k1 long, _k2 long, key binary, size long, {_LONGS}")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k1", "_k2")).alias("_first")
    # Numbered as written: every later read sees the same numbers.
    best = settle(found.groupBy("key", "size", *_PRINT).agg(first).select(F.monotonically_increasing_id().alias("node"), "_first", "size", *_PRINT), "sets")
    total = best.count()
    grouped = best.withColumn("root", F.col("node"))
    for k in (0, WORDS // 2):
        grouped = _regrouped(grouped, links_of(settle(sorted_pairs(grouped, k), "pairs"), best, documents))
    grouped = join_families(grouped, total, documents, nearest, split)
    keep = settle(grouped.groupBy("root").agg(F.min("_first").alias("_first")).select(F.col("_first._k1").alias("_j1"), F.col("_first._k2").alias("_j2")), "kept")
    marked = documents.select(F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("_doc"), *_key())
    # The kept rows grow with the documents: a shuffled join at every size, never a broadcast.  Rows that are
    # equal in id and text meet in it, and one of them stays.
    kept = marked.join(keep.hint("merge"), (F.col("_k1") == F.col("_j1")) & (F.col("_k2") == F.col("_j2")), "left_semi")
    return kept.groupBy("_k1", "_k2").agg(F.first("_doc").alias("_doc")).select("_doc.*")


def _between(grouped: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): the different groups that pairs of nodes join, each pair of groups once."""
    end = lambda k: grouped.select(F.col("node").alias(f"_{k}"), F.col("root").alias(f"_r{k}"))
    met = pairs.select("a", "b").join(end("a"), F.col("a") == F.col("_a")).join(end("b"), F.col("b") == F.col("_b"))
    return met.where("_ra <> _rb").select(F.col("_ra").alias("a"), F.col("_rb").alias("b")).distinct()


def _regrouped(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """``grouped`` with the roots of the groups that links join: only links between groups are followed."""
    between = settle(_between(grouped, links), "between")
    if between.isEmpty():
        return grouped
    roots = connected_components(between, few=FEW)
    new = grouped.join(roots.select(F.col("node").alias("_old"), F.col("root").alias("_new")), F.col("root") == F.col("_old"), "left")
    return settle(new.withColumn("root", F.coalesce("_new", "root")).select("node", "root", "_first", "size", *_PRINT), "grouped")
