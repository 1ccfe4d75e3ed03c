"""Token ids in Simple-8b words: the codec, the block format and the files.

A 64-bit word holds a selector in its top four bits and 60 bits of payload: as many ids of one
width as the selector says.  Ids too wide for the widest slot are escaped: their slot holds the
escape code and the block keeps their values aside, in order.

A file is a sequence of blocks in ascending order of document id, each ended by one line feed.
A block is ``magic, documents, ids, words, escapes, groups`` as unsigned 32-bit integers, then the
documents' ids (int64), null marks (uint8), lengths (uint32), the words (uint64), the escaped ids
(uint32) and, for every group of 256 words, the number of ids before it (uint32): with these
offsets any group can be decoded alone.  All integers are little-endian.

Defined results: a null or empty text is a document of the end id alone; documents of equal id are
ordered by the hash of their text; null ids come first; an empty table gives an empty file set and
no rows.  The format's document ids are 64-bit integers: an id column of another type is cast, and
an id that no such integer stands for is null.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, settle, slices, text_or_empty
from .tokens import encoder

#: Fixed values of the format: (ids a word, bits an id) by selector.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20))
ESCAPE = (1 << 20) - 1
GROUP = 256
MAGIC = 0x4B423853
HEADER = struct.Struct("<6I")
#: A block is closed at the first document that brings it to so many ids.
BLOCK_IDS = 1 << 16
BLOCKS_PER_FILE = 64
#: Parts whose ids are summed together before blocks of parts are.
PARTS = 1024


#: Bits of every value that fits the widest slot.
_BITS = np.concatenate([[0], *(np.full(1 << k, k + 1) for k in range(20))]).astype(np.uint8)


def _choices(bits: np.ndarray) -> np.ndarray:
    """For each place the selector that packs the most ids from there; beyond the end there is room."""
    n = len(bits)
    spans = {1: np.concatenate([bits, np.zeros(64, np.uint8)])}  # widest of 1, 2, 4, ... ids from a place
    while 2 * max(spans) <= 60:
        k = max(spans)
        spans[2 * k] = np.maximum(spans[k][: len(spans[k]) - k], spans[k][k:])
    choice = np.full(n, len(SELECTORS) - 1, np.uint8)
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, width = SELECTORS[s]
        k = 1 << (count.bit_length() - 1)
        widest = np.maximum(spans[k][:n], spans[k][count - k : count - k + n])
        choice[widest <= width] = s
    return choice


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escaped ids of a sequence of unsigned 32-bit ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    if not len(ids):
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    escaped = ids[ids >= ESCAPE]
    values = np.minimum(ids, ESCAPE).astype(np.uint64)
    choice = _choices(_BITS[values.astype(np.int64)])
    steps = np.array([c for c, _ in SELECTORS])[choice].tolist()
    starts, at, n = [], 0, len(ids)
    while at < n:
        starts.append(at)
        at += steps[at]
    first = np.array(starts)
    selector = choice[first]
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    words = selector.astype(np.uint64) << np.uint64(60)
    for s, (count, width) in enumerate(SELECTORS):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            part = words[mine]
            for k in range(count):
                part |= padded[first[mine] + k] << np.uint64(k * width)
            words[mine] = part
    return words, escaped


def unpack(words: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of whole words, all words of a selector at once."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[selector] if len(words) else np.empty(0, np.int64)
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint32)
    for s, (count, width) in enumerate(SELECTORS):
        mine = np.flatnonzero(selector == s)
        mask = np.uint64((1 << width) - 1)
        for k in range(count if len(mine) else 0):
            out[first[mine] + k] = (words[mine] >> np.uint64(k * width)) & mask
    out = out[:n]
    if len(escaped):
        out[out == ESCAPE] = escaped
    return out


def block_bytes(doc_ids: list[int | None], parts: list[bytes]) -> bytes:
    """A block of documents, each given as little-endian unsigned 32-bit ids."""
    ids = np.frombuffer(b"".join(parts), "<u4")
    words, escaped = pack(ids)
    counts = np.array([c for c, _ in SELECTORS])[(words >> np.uint64(60)).astype(np.int64)]
    before = (np.cumsum(counts) - counts)[::GROUP].astype("<u4")
    return b"".join(
        [
            HEADER.pack(MAGIC, len(parts), len(ids), len(words), len(escaped), len(before)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            np.array([len(p) // 4 for p in parts], "<u4").tobytes(),
            words.astype("<u8").tobytes(),
            escaped.astype("<u4").tobytes(),
            before.tobytes(),
        ]
    )


def blocks_of(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(document ids, null marks, lengths, words, escaped ids, group offsets, number of ids) of each block of a file."""
    at = 0
    while at < len(content):
        magic, docs, n, words, escapes, groups = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEADER.size
        out = []
        for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u8", words), ("<u4", escapes), ("<u4", groups)):
            out.append(np.frombuffer(content, kind, count, at))
            at += out[-1].nbytes
        at += 1  # the line feed
        yield (*out, n)


def unpack_group(words: np.ndarray, escaped: np.ndarray, before: np.ndarray, n: int, group: int) -> np.ndarray:
    """The ids of one group of words; escaped ids are those counted after the groups before it."""
    part = words[group * GROUP : (group + 1) * GROUP]
    end = int(before[group + 1]) if group + 1 < len(before) else n
    ids = unpack(part, np.empty(0, np.uint32), end - int(before[group]))
    wide = ids == ESCAPE
    if wide.any():
        skipped = sum(int((unpack(words[g * GROUP : (g + 1) * GROUP], np.empty(0, np.uint32), GROUP * 60) == ESCAPE).sum()) for g in range(group))
        ids[wide] = escaped[skipped : skipped + int(wide.sum())]
    return ids


def write_token_files(documents: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Encode every whole text and write its ids, in ascending order of document id.

    The files are written by Spark's own writer (any store it reaches, committed once a task), a
    block a record; a range sort splits even a hot id's rows by the hash of their texts.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        ids, parts, size = [], [], 0
        for batch in slices(batches, 4096, 12_000_000):
            texts = batch.column(1).to_pylist()
            for doc, raw in zip(batch.column(0).to_pylist(), encode(texts)):
                ids.append(doc)
                parts.append(raw + end)
                size += len(raw) // 4 + 1
                if size >= BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([block_bytes(ids, parts)], pa.binary())], ["block"])
                    ids, parts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([block_bytes(ids, parts)], pa.binary())], ["block"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = source.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    blocks = ordered.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.option("lineSep", "\n").option("maxRecordsPerFile", BLOCKS_PER_FILE).option("compression", "none").text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, doc_id, ids binary) of every document in the files, ids as unsigned 32-bit little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, place, docs, nulls, ids, at in _documents(batches):
            parts = [ids[at[k] : at[k + 1]].tobytes() for k in range(len(docs))]
            yield _rows(file, place, docs, nulls, [pa.array(parts, pa.binary())], ["ids"])

    return _files(spark, path).mapInArrow(run, "file string, place long, doc_id long, ids binary")


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for file, content in zip(batch.column(0), batch.column(1)):
            place = 0
            for docs, nulls, lengths, words, escaped, _, n in blocks_of(content.as_py()):
                ids = unpack(words, escaped, n)
                yield file.as_py(), place, docs, nulls, ids, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                place += len(docs)


def _rows(file: str, place: int, docs: np.ndarray, nulls: np.ndarray, more: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    n = len(docs)
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * n), pa.array(np.arange(place, place + n)), pa.array(docs, mask=nulls.astype(bool)), *more], ["file", "place", "doc_id", *names]
    )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0
        for file, place, docs, nulls, ids, at in _documents(batches):
            done = done if file == last else 0
            sums = [zlib.crc32(ids[at[k] : at[k + 1]]) for k in range(len(docs))]
            more = [pa.array(at[:-1] + done), pa.array(np.diff(at)), pa.array(sums, pa.int64())]
            yield _rows(file, place, docs, nulls, more, ["_at", "n_tokens", "ids_crc32"])
            last, done = file, done + len(ids)

    schema = "file string, place long, doc_id long, _at long, n_tokens long, ids_crc32 long"
    found = settle(_files(spark, path).mapInArrow(run, schema), "token-digest")
    per_file = found.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    starts = _ids_before(per_file)
    return found.join(starts, "file").select("doc_id", (F.col("_before") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def _ids_before(per_file: DataFrame) -> DataFrame:
    """(file, _before) from (file, _n), in three levels: files of a part, parts of a block of ``PARTS``, blocks.

    Each window sees the rows of one part or block; the last, over blocks, has a row for ``PARTS`` parts.
    """
    part, piece = (F.regexp_extract("file", x, 1).cast("long") for x in (r"^part-(\d+)", r"-c(\d+)"))
    files = per_file.select("file", "_n", part.alias("_part"), piece.alias("_piece")).withColumn("_block", F.expr(f"_part div {PARTS}"))
    before = lambda *by: F.sum("_n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) - F.col("_n")
    parts = files.groupBy("_block", "_part").agg(F.sum("_n").alias("_n"))
    blocks = parts.groupBy("_block").agg(F.sum("_n").alias("_n"))
    of_block = blocks.select(F.col("_block").alias("_b"), before("_block").alias("_z"))
    of_part = parts.select("_block", F.col("_part").alias("_p"), before("_block", "_part").alias("_y")).join(of_block, F.col("_block") == F.col("_b")).select("_p", (F.col("_y") + F.col("_z")).alias("_y"))
    of_file = files.select("file", "_part", before("_part", "_piece").alias("_x"))
    return of_file.join(of_part, F.col("_part") == F.col("_p")).select("file", (F.col("_x") + F.col("_y")).alias("_before"))


def op3(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    path = fresh_path(documents.sparkSession, "token-files")
    write_token_files(documents, path, tokenizer_path)
    return token_digest(documents.sparkSession, path)
