"""What several text operators share: a shared folder, settled tables, batches of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of the contracts: runs of anything but ASCII white space.  ``bytes.split()`` splits
#: at exactly these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def workspace(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    A local session that names none (one machine, as in tests) gets a temporary folder, which is
    remembered in the session.  On a cluster executors wouldn't share such a folder: an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="shardloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders that this process made in the shared folder and that still exist, in order.
_made: list[str] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    _made.append(f"{workspace(spark)}/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage with files that outlive every executor, unlike a local checkpoint.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_so_far() -> int:
    return len(_made)


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the intermediate tables made after ``since``, but for the last ``keep`` of them.

    Only for tables that no frame still to be run reads.
    """
    upto = max(since, len(_made) - keep)
    for path in _made[since:upto]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    del _made[since:upto]


def id_bytes(column: str = "doc_id") -> Column:
    """The id as text, empty for null, as the fold rules hash it."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, modulus: int) -> Column:
    return F.pmod(F.crc32(id_bytes(column).cast("binary")), F.lit(modulus))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into short ones, so that Python objects of few texts live at a time.

    A slice has at most so many rows, and bytes too unless one row alone has more.
    """
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            while part.nbytes > most and part.num_rows > 1:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows


def utf8(array: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes (null: empty)."""
    return [x or b"" for x in array.cast(pa.large_binary()).to_pylist()]
