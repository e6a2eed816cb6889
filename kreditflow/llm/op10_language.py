"""Language identification by mixture inference.

Each language's model is its byte n-gram counts (n = 1, 2, 3) in hashed tables
of a fixed size, summed over all labelled texts; so the model's size is the
number of languages times the tables, whatever the corpus.  A document is a
mixture: expectation-maximisation estimates the language proportions from the
likelihoods of its n-grams, then the languages are taken in order of proportion
and the set with the best penalised likelihood (half a log count for each free
parameter) is chosen.  The prediction is the largest language of that set.

A null text or one without a letter (a character of category L; number signs such as Roman or circled ones are none) is
``und`` with score 0, as is every text if
no language was learned; ties go to the language first in the alphabet; rows
without an id count as if their id were the empty text; repeated rows are learned
and predicted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kreditflow.llm.common import documents, materialize

ORDERS = (1, 2, 3)
#: Hash buckets of each order.
BUCKETS = 1 << 15
SMOOTHING = 0.5
MAX_STEPS, TOLERANCE, LEAST_SHARE = 40, 1e-3, 0.02
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Other ASCII characters than letters become spaces.
_SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def grams(text: str) -> np.ndarray:
    """Bucket of every n-gram of a text, in lower case with single spaces."""
    raw = b" " + b" ".join(text.lower().encode().translate(_SPACED).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint64)
    out = []
    for k, n in enumerate(ORDERS):
        x = np.zeros(max(0, len(a) - n + 1), np.uint64)
        for j in range(n):
            x = x << np.uint64(8) | a[j : len(a) - n + 1 + j]
        out.append(((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64) + k * BUCKETS)
    return np.concatenate(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, t in tables.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(t[at])], ["lang", "bucket", "n"])

    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if lang not in tables:
                if len(tables) >= 64:  # what one task holds; the sums are made by Spark
                    yield from out()
                    tables.clear()
                tables[lang] = np.zeros(len(ORDERS) * BUCKETS, np.int64)
            tables[lang] += np.bincount(grams(text), minlength=len(ORDERS) * BUCKETS)
    yield from out()


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n): n-gram counts of each language over all labelled texts."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    return rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def load(model: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and each bucket's probability in each: at most languages x buckets numbers."""
    t = model.toArrow()
    names = sorted(set(t.column("lang").to_pylist()))
    counts = np.full((len(ORDERS) * BUCKETS, len(names)), SMOOTHING)
    place = {n: i for i, n in enumerate(names)}
    np.add.at(counts, (t.column("bucket").to_numpy(), np.array([place[x] for x in t.column("lang").to_pylist()], np.int64)), t.column("n").to_numpy())
    for k in range(len(ORDERS)):
        part = counts[k * BUCKETS : (k + 1) * BUCKETS]
        part /= part.sum(axis=0)
    return names, counts.astype(np.float32)


def mixture(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions that maximise the likelihood of n-grams with probabilities p (n-gram, language), and that likelihood."""
    share, total = np.full(p.shape[1], 1 / p.shape[1]), n.sum()
    for _ in range(MAX_STEPS if p.shape[1] > 1 else 0):
        new = share * ((n / (p @ share)) @ p) / total
        done = np.abs(new - share).max() < TOLERANCE
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def infer(text: str, p: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Proportions of all languages, and the chosen set with the largest first."""
    counts = np.bincount(grams(text), minlength=len(p))
    at = np.flatnonzero(counts)
    n = counts[at].astype(np.float64)
    q = p[at].astype(np.float64)
    share, _ = mixture(q, n)
    order = [int(i) for i in np.argsort(-share, kind="stable") if share[i] >= LEAST_SHARE] or [int(np.argmax(share))]
    if len(order) == 1:
        return share, order
    free = 0.5 * np.log(max(2.0, n.sum() / len(ORDERS)))
    best, chosen = -np.inf, order[:1]
    for size in range(1, len(order) + 1):
        own, ll = mixture(q[:, order[:size]], n)
        value = ll / len(ORDERS) - free * (2 * size - 1)
        if value > best:
            best, chosen = value, [order[i] for i in np.argsort(-own, kind="stable")]
    return share, chosen


PREDICTED = "lang_pred string, score double, languages array<string>"


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = shared.value
        for b in batches:
            pred, score, sets = [], [], []
            for text in b.column("text").to_pylist():
                if not text or not names or not LETTER.search(text):
                    pred, score, sets = [*pred, UNKNOWN], [*score, 0.0], [*sets, []]
                    continue
                share, chosen = infer(text, p)
                pred.append(names[chosen[0]])
                score.append(float(min(1.0, share[chosen[0]])))
                sets.append([names[i] for i in chosen])
            new = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("key"), *new], ["key", "lang_pred", "score", "languages"])

    return run


def predict(docs: DataFrame, key: Column, model: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, lang_pred, score, languages) of every row; ``key`` may be any column or struct that is to be kept."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    rows = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_predict(shared), f"key {kind}, {PREDICTED}")


def op10_language(spark, sf_dir: str) -> DataFrame:
    """Language of all ``documents``, learned from those that aren't held out."""
    docs = documents(spark, sf_dir)
    model = materialize(learn(docs.filter(~held_out(F.col("doc_id")))), "language")
    out = predict(docs, F.col("doc_id"), model)
    return out.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "lang_pred", "score", "languages")
