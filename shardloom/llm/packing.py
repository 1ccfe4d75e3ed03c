"""Best-fit packing of documents into sequences, in bulk-synchronous supersteps.

Documents are range-sorted by length, and gaps (the free ends of open sequences) by size.  A
superstep takes all documents of the longest length not yet placed and sweeps their successors:
the smallest gaps that hold them, then the next larger, until documents or gaps run out; what is
left opens new sequences.  Documents that want the same gap are granted gaps by their rank, the
gaps shrink, and the next superstep sees them.

Lengths are integers up to the capacity, so documents and gaps are held as *runs*: a length and
its number of documents, or a size and a range of sequences that all have that gap.  There are at
most ``capacity`` document runs, and a superstep adds at most a few gap runs, so the run tables
don't grow with the corpus.  A superstep decides for whole runs; every document then finds its
own place by a successor search of its rank in the table of granted ranges, on the executors.
The ranks come from the distributed range sort, which splits even a length (or an id) that a
third of the rows have.

Defined results: a null or empty text is one piece with the end id alone; repeated rows are
packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, slices, text_or_empty
from .tokens import encoder

CAPACITY = 2048
#: Bits of a rank in the search key; the length stands above them.
_RANK_BITS = 44


def token_pieces(documents: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document, end id included.

    Only longer documents are cut, into pieces of ``capacity``; the first may be shorter.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in slices(batches, 2048, 6_000_000):
            docs, rows, raws = [], [], []
            for doc, raw in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                raw += end
                n = len(raw) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k in range(len(cuts) - 1):
                    ids = raw[4 * cuts[k] : 4 * cuts[k + 1]]
                    docs.append(doc)
                    rows.append((k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(ids)))
                    if with_ids:
                        raws.append(ids)
            table = np.array(rows, np.int64).reshape(-1, 4)
            columns = [pa.array(docs, batch.column(0).type), pa.array(table[:, 0].astype("int32")), *(pa.array(table[:, i]) for i in (1, 2, 3))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(raws, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    source = documents.select("doc_id", text_or_empty().alias("text"))
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return source.mapInArrow(run, schema)


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Supersteps over runs.  Returns the granted ranges and the number of sequences.

    A range is (length, first rank, first sequence, offset): document ``first rank + i`` of that
    length goes to sequence ``first sequence + i`` at ``offset``, up to the next range's rank.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs of (first sequence, number)
    sizes = 0  # bit s: there are gaps of size s
    granted, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} doesn't fit a capacity of {capacity}")
        while left:
            found = sizes >> length
            if found:
                size = length + (found & -found).bit_length() - 1
            else:  # no gap holds it: as many new sequences as documents of this length need
                number = -(-left // (capacity // length))
                gaps[capacity], sizes, size = [(opened, number)], sizes | 1 << capacity, capacity
                opened += number
            run = gaps[size].pop()
            take = min(left, run[1])
            granted.append((length, rank, run[0], capacity - size))
            if size > length:
                gaps.setdefault(size - length, []).append((run[0], take))
                sizes |= 1 << (size - length)
            if take < run[1]:
                gaps[size].append((run[0] + take, run[1] - take))
            if not gaps[size]:
                sizes &= ~(1 << size)
            left, rank = left - take, rank + take
    table = np.array(granted, np.int64).reshape(-1, 4)
    return table[np.lexsort((table[:, 1], table[:, 0]))], opened


def pack_best_fit(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with doc_id, piece and length) plus sequence_id and offset."""
    spark = pieces.sparkSession
    settled = settle(pieces, "pieces").withColumn("_row", F.monotonically_increasing_id())
    names = [*pieces.columns, "_part", "_rank"]
    at = pieces.columns.index("length")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            lengths = batch.column(at).to_numpy()
            values, first, count = np.unique(-lengths, return_index=True, return_counts=True)  # sorted: runs
            rank = np.empty(len(lengths), np.int64)
            for v, f, c in zip(values, first, count):
                rank[f : f + c] = np.arange(seen.get(v, 0), seen.get(v, 0) + c)
                seen[v] = seen.get(v, 0) + int(c)
            columns = [batch.column(i) for i in range(len(names) - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(rank), part, np.int64)), pa.array(rank)], names)

    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("_row")]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    sorted_rows = settled.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    ranks = settle(sorted_rows.mapInArrow(ranked, f"{types}, _part long, _rank long"), "ranked")
    # Range-sorted: a partition has a narrow band of lengths, so there are at most capacity + partitions rows.
    runs = ranks.groupBy("length", "_part").agg(F.count("*").alias("n")).collect()
    counts: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for r in sorted(runs, key=lambda r: (r["length"], r["_part"])):
        base[r["length"], r["_part"]] = counts.get(r["length"], 0)
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    table, _ = best_fit_runs(counts, capacity)
    shared = spark.sparkContext.broadcast((base, table))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, table = shared.value
        keys = (table[:, 0] << _RANK_BITS) | table[:, 1]
        for batch in batches:
            lengths, parts, rank = (batch.column(i).to_numpy() for i in (at, len(names) - 2, len(names) - 1))
            code = lengths * (parts.max(initial=0) + 1) + parts
            values, where = np.unique(code, return_inverse=True)
            start = np.array([base[int(v // (parts.max(initial=0) + 1)), int(v % (parts.max(initial=0) + 1))] for v in values], np.int64)
            rank = rank + (start[where] if len(values) else 0)
            slot = np.searchsorted(keys, (lengths << _RANK_BITS) | rank, side="right") - 1
            sequence = table[slot, 2] + rank - table[slot, 1]
            columns = [batch.column(i) for i in range(len(names) - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(table[slot, 3])], [*names[:-2], "sequence_id", "offset"])

    return ranks.mapInArrow(placed, f"{types}, sequence_id long, offset long")


def assemble(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths): the packed sequences themselves, of pieces that carry their ids.

    A group has at most ``capacity`` ids, whatever the data.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    grouped = placed.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return grouped.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["length"]).alias("lengths"))


def op10(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    return pack_best_fit(token_pieces(documents, tokenizer_path))
