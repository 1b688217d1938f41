"""Shared pieces of the text operators: tokens, batches of bounded size, hashes, fixed folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20  # text handled at once inside a task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`: `bytes.split` breaks at exactly these six bytes."""
    return text.split()


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `limit` bytes of text each (one row at least), and their texts as bytes (null: empty)."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        first, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                part = batch.slice(first, row - first)
                yield part, [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]
                first, held = row, 0
            held += size + 1
        if held:
            part = batch.slice(first)
            yield part, [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows, for work whose results are much larger than a row."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def map_texts(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """`mapInArrow` where `fn(batch, texts)` gives the columns of one bounded slice as a list, in the order of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            made = fn(batch, texts)
            if made is not None and len(made[0]):
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=f.type) for x, f in zip(made, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo `folds` (a null key counts as the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shared_folder(session: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one is made here only for a local session that names none."""
    named = session.conf.get("spark.checkpoint.dir", None)
    if named is None:
        set_ = session.sparkContext._jsc.sc().getCheckpointDir()
        if set_.isDefined():
            return set_.get()
        if not session.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    return named


def pinned(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: compressed and read by column. It goes when the session ends."""
    session = df.sparkSession
    path = f"{shared_folder(session).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = session._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    return session.read.schema(df.schema).parquet(path)


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
