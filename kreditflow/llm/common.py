"""Helpers shared by the operators: shared tables, column selection, blocks of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kreditflow.session import scratch_path

#: The white space that separates words in the contracts: \x20 and \x09-\x0D.
SPACE = " \\t\\n\\x0B\\f\\r"

#: Text of one block (a dictionary of distinct words is kept per block).
BLOCK_BYTES = 32 << 20
#: Text of one packed row of a block.
BLOB_BYTES = 4 << 20


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only; a null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text, in order."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def computed_once(value: Column) -> Column:
    """The same value, which filters above it read instead of repeating its expression below it.

    The optimizer moves a filter below a projection by copying the columns' expressions into it, and so an
    array built once would be built again inside every lambda that reads it.  It never copies what is not deterministic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


# ---------------------------------------------------------------- blocks of texts
BLOB_SCHEMA = "block long, blob binary"


def iter_blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[tuple[int, list, list]]:
    """Runs of (block, ids, texts) of a task's rows in order; about BLOB_BYTES a run.

    A block is a run of about ``size`` bytes of text of one task.  Its number is
    made of the task's partition and a counter.
    """
    pid = TaskContext.get().partitionId() << 24
    seq = held = 0
    ids: list = []
    texts: list = []
    run = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            run += len(t) + 16
            if run >= BLOB_BYTES:
                yield pid + seq, ids, texts
                held += run
                ids, texts, run = [], [], 0
                if held >= size:
                    seq, held = seq + 1, 0
    if ids:
        yield pid + seq, ids, texts


def pack_blob(ids: list, texts: list) -> bytes:
    t = pa.table({"i": pa.array(ids, pa.int64()), "t": pa.array(texts, pa.large_string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return zstandard.ZstdCompressor(level=5).compress(sink.getvalue())


def unpack_blob(blob: bytes) -> tuple[list, list]:
    t = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
    return t.column("i").to_pylist(), t.column("t").to_pylist()


def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, ids, texts in iter_blocks(batches):
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "blob": pa.array([pack_blob(ids, texts)], pa.binary())})


def text_blocks(docs: DataFrame) -> DataFrame:
    """(block, blob): the texts, compressed, about BLOCK_BYTES to a block."""
    return docs.mapInArrow(pack_batches, BLOB_SCHEMA)
