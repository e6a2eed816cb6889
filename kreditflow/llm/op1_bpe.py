"""BPE encoding and decoding through a distinct-word table.

Texts are cut into blocks (runs of about 32 MB of one task).  Each block lists
its distinct words; the (block, word) rows are dealt out by word and sorted, so
every distinct word is encoded once in the whole corpus, and its ids go back to
each block that holds it.  There a text's words are replaced by their ids in
order of position.  Texts travel compressed.  Decoding looks ids up in the
vocabulary's pieces, which each task loads (as large as the vocabulary, never the
data).  That is not the join of ids with pieces that one would write: joining every
(text, position, id) with the broadcast pieces, put together in order without a
shuffle, took 1,309 CPU seconds a GB in place of 702, beyond the budget of 900.

Null and empty texts give no ids and an empty decoded text; repeated rows are
encoded each on their own; an empty table gives an empty result; extra columns
are ignored.  A text is never cut: the longest one is one row of one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kreditflow.llm.bpe import word_bpe
from kreditflow.llm.common import documents, id_text, iter_blocks, text_blocks, unpack_blob

TOKENIZER = "word_bpe_49k.json"
ENCODED = "doc_id long, ids array<int>"


def _block_words(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)

        def rows(block: int, words: set) -> pa.RecordBatch:
            w = pa.array(words, pa.string())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(w), block, np.int64)), w], ["block", "word"])

        at, seen = None, set()
        for block, _, texts in iter_blocks(batches):
            if block != at:
                if seen:
                    yield rows(at, seen)
                at, seen = block, set()
            for t in texts:
                seen.update(bpe.words(t))
        if seen:
            yield rows(at, seen)

    return run


def _encode_words(tokenizer: str):
    """Rows sorted by word: a word's ids are made at its first row and reused at the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        last, ids = None, b""
        for b in batches:
            out = []
            for w in b.column(1).to_pylist():
                if w != last:
                    last, ids = w, np.array(bpe.word_ids(w), "<i4").tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["block", "word", "ids"])

    return run


def _place(tokenizer: str):
    """Join back by position.  A word that a re-run of the scan put into another block is encoded here."""

    class Table(dict):
        def __missing__(self, word: str) -> bytes:
            self[word] = out = np.array(word_bpe(tokenizer).word_ids(word), "<i4").tobytes()
            return out

    def run(blobs: pa.Table, words: pa.Table) -> pa.Table:
        bpe = word_bpe(tokenizer)
        table = Table(zip(words.column("word").to_pylist(), words.column("ids").to_pylist(), strict=True))
        docs: list = []
        parts: list[bytes] = []
        for blob in blobs.column("blob"):
            ids, texts = unpack_blob(blob.as_py())
            docs += ids
            parts += [b"".join(map(table.__getitem__, bpe.words(t))) for t in texts]
        ends = np.cumsum([0] + [len(p) // 4 for p in parts]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32())
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends), values)})

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids): the tokenizer's ids of every whole text, without added special tokens."""
    src = id_text(docs, id_col, text_col)
    pairs = src.mapInArrow(_block_words(tokenizer), "block long, word string")
    table = pairs.repartition("word").sortWithinPartitions("word").mapInArrow(_encode_words(tokenizer), "block long, word string, ids binary")
    return text_blocks(src).groupBy("block").cogroup(table.groupBy("block")).applyInArrow(_place(tokenizer), ENCODED)


def _decode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_bpe(tokenizer).pieces
        pieces = pa.array([known.get(i, "") for i in range(max(known, default=0) + 1)], pa.string())
        for b in batches:
            for at in range(0, b.num_rows, 256):  # bounded memory: long texts come many to a batch
                part = b.slice(at, 256)
                ids = part.column(1)
                flat = pc.take(pieces, ids.flatten())
                ends = np.cumsum(np.concatenate([[0], pc.list_value_length(ids).to_numpy(zero_copy_only=False)])).astype(np.int32)
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), flat), " ")
                yield pa.RecordBatch.from_arrays([part.column(0), ids, text.cast(pa.string())], ["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Adds ``decoded``: each id's piece, joined by a space (this tokenizer has no decoder of its own)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(tokenizer), ENCODED + ", decoded string")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every text of ``documents``; digests of ids and decoded text."""
    out = decode(encode(documents(spark, sf_dir)))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
