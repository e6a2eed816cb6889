"""MinHash near-duplicates on sketches filled by fast similarity sketching.

Sketch: in round i every shingle is hashed to one of t bins with a value in
[i, i+1); a bin keeps its least value, and after t rounds each further round
fills one bin with all shingles.  Rounds stop once every bin is filled, so all
coordinates are filled after at most 2t rounds, whatever the set's size, and
the share of equal coordinates concentrates around the similarity as for
independent hash functions.

Banding: the sketch is cut into bands; with r = 6 coordinates in each of 60
bands, two sets of similarity 0.8 share no band with probability
(1 - 0.8^6)^60 = 1.2e-8.  Equal word sequences are one class from the start.
In every shared band each member is compared with the band's most central one, on
the full sets, and links are joined to components.  Bands of which other members
still differ are settled by an exact prefix filter over these members' full
sets: pairs of different components that share one of the rarest shingles of
one of them.  So no link between candidates is lost, while a group of copies,
once connected, makes no more pairs.

A null text or one without words has no shingles and is linked with nothing;
rows without an id take part, component_id is null when no member has an id;
repeated rows share their component, and so do different texts under one id; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kreditflow.llm.common import documents, id_text, materialize, words_of
from kreditflow.llm.components import components

SHINGLE_WORDS, PERCENT = 2, 80
BAND_ROWS, BANDS = 6, 60
#: Words of one vectorised step of sketching.
STEP_WORDS = 400_000

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def split_words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""
    return text.encode().lower().split()


def shingle_set(words: list[bytes], k: int) -> set:
    if not words:
        return set()
    return set(zip(*[words[i:] for i in range(k)], strict=False)) if len(words) >= k else {tuple(words)}


def shingle_hashes(words: list[bytes], k: int, table: WordHashes) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(table.__getitem__, words), np.uint64, n)
    if n < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], np.uint64)
    x = w[: n - k + 1]
    for j in range(1, k):
        x = mix(x * _G + w[j : n - k + 1 + j])
    return np.unique(x)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t coordinates for each non-empty set."""
    n = len(sets)
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    x = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(n, dtype=np.int64), [len(s) for s in sets])
    low = np.uint64(0xFFFFFFFF)
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF))
        at = (((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(x), i - t, np.int64)
        np.minimum.at(out, doc * t + at, (h & low) | np.uint64(i << 32))
        if i < 8 or i % 16 == 15:
            open_rows = (out.reshape(n, t) == np.iinfo(np.uint64).max).any(axis=1)
            more = open_rows[doc]
            x, doc = x[more], doc[more]
    return out.reshape(n, t)


def band_hashes(sketches: np.ndarray, r: int, bands: int) -> np.ndarray:
    parts = sketches.reshape(len(sketches), bands, r)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _G, parts.shape[:2])
    for j in range(r):
        h = mix(h * _G + parts[:, :, j])
    return h.view(np.int64)


def class_key(words: list[bytes]) -> bytes | None:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def _sketches(k: int, r: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()

        def out(ids, keys, sets) -> pa.RecordBatch:
            full = [s for s in sets if len(s)]
            flat = band_hashes(sketch(full, r * bands), r, bands).reshape(-1) if full else np.empty(0, np.int64)
            ends = np.cumsum([0] + [bands if len(s) else 0 for s in sets]).astype(np.int32)
            cols = [*(pa.array(x, pa.int64()) for x in zip(*ids, strict=True)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "n_shingles", "key", "bands"])

        ids, keys, sets, held = [], [], [], 0
        for b in batches:
            for doc, text, h in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                words = split_words(text)
                ids.append((doc, h))
                keys.append(class_key(words))
                sets.append(shingle_hashes(words, k, table))
                held += len(words) + 100
                if held >= STEP_WORDS:
                    yield out(ids, keys, sets)
                    ids, keys, sets, held = [], [], [], 0
        if ids:
            yield out(ids, keys, sets)

    return run


def _keyed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            words = [split_words(t) for t in b.column(1).slice(at, 1000).to_pylist()]
            keys = [class_key(w) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([packer.compress(b" ".join(w)) for w in words], pa.binary())], ["key", "words"])


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        last: dict[int, set] = {}

        def of(node: int, blob: bytes) -> set:
            if node not in last:
                if len(last) >= 4:
                    last.clear()
                last[node] = shingle_set(unpacker.decompress(blob).split(), k)
            return last[node]

        for b in batches:
            a, c = [], []
            for x, y, p, q in zip(*[b.column(i) for i in range(4)], strict=True):
                x, y = x.as_py(), y.as_py()
                s, t = of(x, p.as_py()), of(y, q.as_py())
                common = len(s & t)
                if 100 * common >= percent * (len(s) + len(t) - common):
                    a.append(x)
                    c.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def _listed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, table = zstandard.ZstdDecompressor(), WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = [shingle_hashes(unpacker.decompress(w.as_py()).split(), k, table).view(np.int64) for w in part.column(1)]
                nodes = np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(sets))], ["node", "shingle"])

    return run


def _prefix_pairs(shingles: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, label, n, size) with different labels that can be linked; none is missed.

    If sets of na and nb shingles have t in common, any na - t + 1 shingles of the first meet the second.  The rarest
    are taken of the member of the smaller component; those that no other text has come first and meet nothing.
    """
    often = materialize(shingles.groupBy("shingle").agg(F.count("*").alias("c")).filter("c > 1"), "minhash-often")
    own = materialize(shingles.join(often, "shingle").join(nodes, "node"), "minhash-common")
    by = Window.partitionBy("node")
    place = F.row_number().over(by.orderBy("c", "shingle")) + F.col("n") - F.count("*").over(by)
    first = own.select("shingle", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("size").alias("sa"), place.alias("place"))
    first = first.filter(F.col("place") <= F.col("na") - F.ceil(F.col("na") * percent / 100) + 1)
    other = own.select("shingle", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("size").alias("sb"))
    least = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    sized = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    smaller = (F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("la") < F.col("lb")))
    pairs = first.join(other, "shingle").filter((F.col("la") != F.col("lb")) & smaller & sized & (F.col("place") <= F.col("na") - least + 1))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, band_rows: int = BAND_ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, h, n_shingles, label, first) of every row: h is the text's hash, label its component's number, first the
    smallest id in it (both null without words)."""
    src = id_text(docs, id_col, text_col)
    hashed = src.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = materialize(hashed.mapInArrow(_sketches(shingle_words, band_rows, bands), "doc_id long, h long, n_shingles long, key binary, bands array<long>"), "minhash-rows")
    # equal word sequences are one node, whatever their ids
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")

    # shared bands, each with a pivot: the member that shares most bands with others, the most central of near copies
    member = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    member = materialize(member.join(materialize(shared, "minhash-bands"), "band"), "minhash-shared")
    degree = materialize(member.groupBy("node").agg(F.sum("size").alias("degree")), "minhash-degree")
    pivots = member.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", "node")).alias("top"))
    pivots = materialize(pivots.select("band", F.col("top.node").alias("pivot")), "minhash-pivots")
    member = materialize(member.drop("size").join(pivots, "band"), "minhash-members")

    at_key = classes.select("key", "node", "n")
    wanted = degree.select("node").join(at_key, "node").select("key", "node", "n")
    texts = src.mapInArrow(_keyed_texts, "key binary, words binary").join(wanted, "key").dropDuplicates(["node"]).select("node", "n", "words")
    texts = materialize(texts, "minhash-texts")

    def linked(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("words").alias("wa"), F.col("n").alias("na"))
        right = texts.select(F.col("node").alias("b"), F.col("words").alias("wb"), F.col("n").alias("nb"))
        near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent  # sizes too far apart can't be that alike
        full = pairs.join(right, "b").join(left, "a").filter(near)
        return full.select("a", "b", "wa", "wb").mapInArrow(_verify(shingle_words, percent), "a long, b long")

    def joined(links: DataFrame | None, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All links with those of more pairs, and the components' labels."""
        more = materialize(linked(pairs.distinct()), "minhash-links")
        links = more if links is None else links.union(more)
        return links, materialize(components(links, "minhash-components"), "minhash-labels")

    # every member with the pivots of its bands
    links, labels = joined(None, member.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    # bands of which two other members are still of different components
    rest = member.filter("node <> pivot").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    span = rest.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("band")
    rest = rest.join(materialize(span, "minhash-span"), "band").select("node", "label", "n").distinct()
    sizes = materialize(labels.groupBy("label").agg(F.count("*").alias("size")), "minhash-sizes")
    rest = materialize(rest.join(sizes, "label", "left").withColumn("size", F.coalesce("size", F.lit(1))), "minhash-rest")
    shingles = texts.select("node", "words").join(rest.select("node"), "node").mapInArrow(_listed(shingle_words), "node long, shingle long")
    links, labels = joined(links, _prefix_pairs(materialize(shingles, "minhash-shingles"), rest, percent))

    # different texts under one id: their nodes are one component
    ids = rows.filter("key is not null and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi")
    shared_ids = materialize(rows.filter("key is not null").select("doc_id", "key").join(ids.select("doc_id"), "doc_id"), "minhash-ids")
    if not shared_ids.isEmpty():
        of_id = shared_ids.join(at_key, "key").select("doc_id", "node")
        same = of_id.join(of_id.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
        labels = materialize(components(links.union(same), "minhash-components"), "minhash-labels")

    named = classes.select("key", "node", "first_id").join(labels, "node", "left").select("key", "first_id", F.coalesce("label", "node").alias("label"))
    named = materialize(named, "minhash-named")
    first = materialize(named.groupBy("label").agg(F.min("first_id").alias("first")), "minhash-first")
    named = materialize(named.join(first, "label").select("key", "label", "first"), "minhash-known")
    return rows.select("doc_id", "h", "n_shingles", "key").join(named, "key", "left").drop("key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    found = components_of(docs, id_col, text_col, **parameters)
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id, once; rows without words stay."""
    found = components_of(docs, id_col, text_col, **parameters)
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("i"), F.col("h"))
    winners = materialize(found.filter("label is not null").groupBy("label").agg(F.min(place).alias("p")).select("p.i", "p.h"), "minhash-winners")
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("i"), F.xxhash64(whole).alias("h"), words_of(whole).alias("w"))
    rows = rows.select("row", "i", "h", (F.size("w") == 0).alias("bare"))
    first = F.row_number().over(Window.partitionBy("i", "h").orderBy("i"))
    once = rows.filter("not bare").join(winners, ["i", "h"]).withColumn("copy", first).filter("copy = 1")
    return once.select("row").union(rows.filter("bare").select("row")).select("row.*")


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``documents``: two-word shingles, similarity 0.8 or more."""
    return near_duplicates(documents(spark, sf_dir))
