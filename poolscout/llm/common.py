"""Helpers that the corpus operators share: narrow inputs, scratch tables, Arrow batches of bounded size."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Bytes of text that one vectorised step looks at; temporaries are a small multiple of it.
SLICE_BYTES = 1_500_000


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, fp)`` of the documents, whatever else the table holds. A null text is empty, a row without an id is left
    out, and ``fp`` tells texts apart that share an id."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text")).where("doc_id IS NOT NULL").withColumn(
        "fp", F.xxhash64("text")
    )


def fold(id_col: str | Column = "doc_id", folds: int = 5) -> Column:
    """``crc32`` of the id as text, modulo the number of folds."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(column.cast("string").cast("binary")) % folds


def saved(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written below the shared folder and read back, and its path: a cut of the lineage that outlives executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables of this run that no later step reads."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more; the first round only lets go of the plans."""
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def slices(batch: pa.RecordBatch, text_index: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``size`` bytes of text; a longer text makes a piece of its own."""
    n = batch.num_rows
    if not n:
        return
    column = batch.column(text_index)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, int(offsets[start]) + size, side="right")) - 1
        stop = min(n, max(start + 1, stop))
        yield batch.slice(start, stop - start)
        start = stop


def map_slices(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text_col: str = "text", size: int = SLICE_BYTES) -> DataFrame:
    """Run ``step`` on Arrow pieces of ``df`` that hold about ``size`` bytes of text."""
    index = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, index, size):
                out = step(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def binary_array(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, type=pa.binary())


def pieces(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array over bytes that are already laid out one after another."""
    wide = offsets[-1] > 2**31 - 1 if len(offsets) else False
    kind, number = (pa.large_binary(), np.int64) if wide else (pa.binary(), np.int32)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(number).tobytes()), pa.py_buffer(raw.tobytes())])


def pack(values: np.ndarray) -> bytes:
    """Integers as their least value, a width, and the differences to it in that many bytes."""
    if not len(values):
        return b""
    low = int(values.min())
    span = int(values.max()) - low
    width = next(w for w in (1, 2, 4, 8) if span < 2 ** (8 * w))
    return low.to_bytes(8, "little", signed=True) + bytes([width]) + (values.astype(np.int64) - low).astype(f"<u{width}").tobytes()


def unpack(column: pa.Array) -> np.ndarray:
    """All integers of a column of packed ones."""
    out = []
    for value in column:
        data = value.as_buffer()
        if data is not None and data.size:
            head = memoryview(data)
            low, width = int.from_bytes(head[:8], "little", signed=True), head[8]
            out.append(np.frombuffer(data, dtype=f"<u{width}", offset=9).astype(np.int64) + low)
    return np.concatenate(out) if out else np.empty(0, np.int64)
