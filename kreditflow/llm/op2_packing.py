"""Best-fit packing by minimum bin slack.

Tokens are counted per document; a document longer than a sequence is cut into
full pieces, the first taking the rest.  The piece lengths' histogram (at most
``capacity`` rows, whatever the data) goes to the driver.  There each bin is
anchored by the longest length left, and a bitset subset-sum over the available
lengths finds the fullest feasible combination, which is removed; the same
combination repeats while its lengths last, so the number of combinations
depends on the capacity and not on the data.  Every piece gets its rank among
the pieces of its length, from counts per bucket and ranks inside buckets, and
finds its sequence and place by its rank.  No task sees all pieces.

Null and empty texts are one piece with the end id alone; repeated rows are
packed each on their own; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kreditflow.llm.bpe import byte_bpe
from kreditflow.llm.common import documents, id_text, materialize

TOKENIZER, END_ID, CAPACITY = "byte_bpe_50k.json", 2, 1024
#: Pieces of a ranking bucket.
BUCKET_ROWS = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def _cut(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.array([*bpe.ids(text), end_id], "<u4")
                n = len(ids)
                first = n if n <= capacity else n % capacity or capacity
                at, k = 0, 0
                while at < n:
                    to = first if k == 0 else at + capacity
                    rows.append((doc, k, at, to - at, zlib.crc32(ids[at:to].tobytes())))
                    at, k = to, k + 1
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens."""
    return id_text(docs, id_col, text_col).mapInArrow(_cut(tokenizer, end_id, capacity), PIECES)


def _fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths that leaves least of ``room``: reachable sums as bits of an integer."""
    goal, mask = 1 << room, (2 << room) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left > 0 and not reach & goal:
            take = min(size, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, size = left - take, size * 2
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations (length -> times) and how many sequences each fills."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    plan = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = _fullest(counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        plan.append((used, times))
    return plan


def _segments(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """(length, first rank, first sequence, times in a sequence, place) sorted by length and rank."""
    rows, given, sequence = [], {}, 0
    for used, times in plan:
        place = 0
        for length in sorted(used, reverse=True):
            rows.append((length, given.get(length, 0), sequence, used[length], place))
            given[length] = given.get(length, 0) + used[length] * times
            place += length * used[length]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _assign(segments: np.ndarray):
    keys = (segments[:, 0] << 48) + segments[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            s = segments[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            k = rank - s[:, 1]
            out = [b.column(i) for i in range(5)]
            out += [pa.array(s[:, 2] + k // s[:, 3]), pa.array(s[:, 4] + k % s[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset.  ``pieces`` must be a stored table: it is read twice."""
    by_bucket = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    histogram = {r["length"]: r["count"] for r in by_bucket}
    buckets = max(1, math.ceil(sum(histogram.values()) / BUCKET_ROWS))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = rows.groupBy("length", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = rows.withColumn("inside", inside).join(starts, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside") - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(_assign(_segments(plan_bins(histogram, capacity))), PACKED)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(cut_pieces(docs, id_col, text_col, tokenizer, end_id, capacity), "pieces"), capacity)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """Pack all ``documents`` into sequences of 1,024 tokens."""
    return pack_documents(documents(spark, sf_dir))
