"""I-Match document fingerprints, in DataFrame operations alone.

Terms are the lower-cased runs of letters and digits.  The lexicon keeps terms
whose inverse document frequency ln(N / df) lies in a band, counted over distinct
texts, so that copies don't push their terms out of it.  Its size has a
bound that the data cannot exceed: the document frequencies sum to N times the
mean number of distinct terms, and each kept one is at least N * exp(-high), so
there are at most mean * exp(high) terms (about 150,000 for 300 distinct terms
a document), whatever N is; only such a table is broadcast, with the codes of the
terms too frequent for the band, which the same bound counts in.  Every lexicon term
belongs at random (by hash) to lexicon subsets of falling density.  A text's
sorted distinct lexicon terms are hashed once for each subset.  The same is done
with all its distinct terms and OWN of the subsets, which speak for texts with few
lexicon terms, such as one of many near copies.  A fingerprint is the list of all
these hashes, each at its place whatever the text, and two fingerprints are as
alike as the share of equal hashes among the places that either of them fills.

The next document is found without a global sort in one task: ids are dealt out
by range, each range looks one row ahead, and the ranges' first rows link them.

A null or empty text has no terms and fills one place, the hash of all its terms;
documents without an id come last; rows repeated with the same id and text count as one document and return
one row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kreditflow.llm.common import computed_once, documents, id_text, materialize

IDF_BAND = (3.0, 6.2)
#: Subsets of each density 1/4, 1/8, ... 1/512; the first subset is the whole lexicon.
DENSITIES, EACH = 8, 4
SUBSETS = DENSITIES * EACH - 1
#: From these subsets on, all sparser ones together hold less than a half and a seventh of the terms.
SPARSE = (2 * EACH + 1, 4 * EACH + 1)
#: Subsets that are taken of all terms of a text too.
OWN = tuple(range(SUBSETS + 1))
RANGE_ROWS = 500_000
NO_ID = -(2**63)


def terms_of(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def _mask(term: Column) -> Column:
    """32 bits: bit 0 always, bit j with the density of subset j."""
    bits = F.lit(1).cast("long")
    for j in range(1, SUBSETS + 1):
        power = (j - 1) // EACH + 2
        hit = F.xxhash64(term, F.lit(j)).bitwiseAND(F.lit(2**power - 1)) == 0
        bits = bits + F.when(hit, F.lit(2**j).cast("long")).otherwise(F.lit(0).cast("long"))
    return bits


def _code(term: Column) -> Column:
    """The subsets' bits under 31 bits of the term's hash."""
    return F.shiftleft(F.xxhash64(term).bitwiseAND(F.lit(2**31 - 1)), 32) + _mask(term)


def _outside(term: Column) -> Column:
    """The code of a term outside the lexicon: it has the sign bit."""
    return _code(term).bitwiseOR(F.lit(NO_ID))


def known_terms(texts: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """(term, code) of the terms in the band and, with the sign bit, of those too frequent for it; documents are counted over distinct texts."""
    hashed = texts.select("text", F.xxhash64("text").alias("h"))
    copies = materialize(hashed.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "imatch-copies")
    more = copies.agg(F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("n")).collect()[0]["n"]  # one number
    total = texts.count() - more
    # each text counts once: all rows, less the further copies of one row of each
    one = hashed.join(copies, "h").groupBy("h").agg(F.first("text").alias("text"), (1 - F.first("m")).alias("w"))
    rows = hashed.select("text", F.lit(1).cast("long").alias("w")).unionByName(one.select("text", "w"))
    df = rows.select("w", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.sum("w").alias("df"))
    idf = F.log(F.lit(float(total)) / F.col("df"))
    term = F.col("term")
    return df.filter(idf <= band[1]).select("term", F.when(idf >= band[0], _code(term)).otherwise(_outside(term)).alias("code"))


def lexicon(texts: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """(term, code) of the terms in the band alone."""
    return known_terms(texts, band).filter("code >= 0")


def fingerprints(texts: DataFrame, keys: list[str], known: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``fp`` for each key: hashes of the subsets of the lexicon, then of the OWN subsets of all terms; null where a text has none of it.

    ``known`` is the lexicon, or ``known_terms``, which spares frequent terms the hashing of each occurrence.  Columns
    of ``carry`` go with their key; only a text's first term takes them along, so that the grouped rows stay short.
    """
    rows = texts.select(*keys, *carry, F.posexplode_outer(terms_of(F.col("text"))).alias("at", "term"))
    rows = rows.join(F.broadcast(known), "term", "left")
    code = F.when(F.col("term").isNotNull(), F.coalesce("code", _outside(F.col("term"))))
    # codes are columns before they are collected: the aggregate would interpret their expression for every term
    rows = rows.select(*keys, code.alias("code"), *[F.when(F.coalesce("at", F.lit(0)) == 0, F.col(c)).alias(c) for c in carry])
    got = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("code")).alias("every"), *[F.max(c).alias(c) for c in carry])
    got = got.select(*keys, *carry, "every", computed_once(F.filter("every", lambda c: c >= 0)).alias("inside"))
    # the sparse subsets look only at the terms that are in any of them
    lists = {"every": "every", "inside": "inside"}
    source = {(c, j): c for c in lists for j in range(SUBSETS + 1)}
    for first in SPARSE:
        any_of = F.lit(2**32 - 2**first).cast("long")
        thinner = {c: f"{c}_{first}" for c in lists}
        got = got.select("*", *[computed_once(F.filter(lists[c], lambda x: x.bitwiseAND(any_of) != 0)).alias(n) for c, n in thinner.items()])
        source.update({(c, j): n for c, n in thinner.items() for j in range(first, SUBSETS + 1)})
        lists = thinner
    low = lambda c: c.bitwiseAND(F.lit(2**31 - 1)).cast("int")

    def subset(codes: str, j: int) -> Column:
        own = F.filter(source[codes, j], lambda c: c.bitwiseAND(F.lit(2**j).cast("long")) != 0) if j else F.col(codes)
        return F.transform(F.array(own), lambda a: F.when(F.size(a) > 0, low(F.xxhash64(a))))[0]

    places = [*(subset("inside", j) for j in range(SUBSETS + 1)), low(F.xxhash64("every")), *(subset("every", j) for j in OWN[1:])]
    return got.select(*keys, *carry, F.array(*places).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the places that either fingerprint fills; that of all terms is filled always."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda t: t))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, y).isNotNull()), lambda t: t))
    return same.cast("double") / either


def show(fp: Column) -> Column:
    """A fingerprint as text."""
    return F.array_join(F.transform(fp, lambda x: F.coalesce(F.lower(F.hex(x)), F.lit("-"))), ".")


def next_documents(keyed: DataFrame) -> DataFrame:
    """(k, h, n, copies, k2, h2): each document and the one after it by descending id; the last is followed by the first."""
    rows = keyed.groupBy("k", "h", "n").agg(F.count("*").alias("copies"))
    rows = materialize(rows, "imatch-keys")
    ranges = max(1, math.ceil(rows.count() / RANGE_ROWS))
    order = [F.col("k").desc(), F.col("h")]
    dealt = materialize(rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "imatch-ranges")
    w = Window.partitionBy("part").orderBy(*order)
    ahead = dealt.withColumn("to", F.lead(F.struct("k", "h")).over(w))
    heads = dealt.groupBy("part").agg(F.max(F.struct("k", (-F.col("h") - 1).alias("g"))).alias("top"))  # -h - 1 turns the order of h round
    heads = heads.select("part", F.struct(F.col("top.k").alias("k"), (-F.col("top.g") - 1).alias("h")).alias("head"))
    all_ranges = Window.orderBy("part")  # one row for each range of RANGE_ROWS documents
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = heads.select("part", F.coalesce(F.lead("head").over(all_ranges), F.first("head").over(every)).alias("then"))
    found = ahead.join(links, "part").withColumn("to", F.coalesce("to", "then"))
    return found.select("k", "h", "n", "copies", F.col("to.k").alias("k2"), F.col("to.h").alias("h2"))


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with their edited text, and the table of next documents."""
    rows = id_text(docs, id_col, text_col)
    base = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.xxhash64("text", F.col("doc_id").isNull()).alias("h"), "text")
    links = materialize(next_documents(base.select("k", "h", F.char_length("text").cast("long").alias("n"))), "imatch-next")
    once = base.dropDuplicates(["k", "h"])
    half = F.floor(F.col("n") / 2).cast("int")
    after = once.select(F.col("k").alias("k2"), F.col("h").alias("h2"), F.col("text").alias("then"))
    heads = links.select("k", "h", "n", "k2", "h2").join(after, ["k2", "h2"]).select("k", "h", "n", F.left("then", half).alias("head"))
    whole = once.join(heads, ["k", "h"])
    edited = F.concat(F.left("text", (F.col("n") - half).cast("int")), F.col("head"))
    return whole.select("k", "h", "n", "text", edited.alias("edited")), links


def op5_imatch(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts, and how alike they are."""
    docs = documents(spark, sf_dir)
    known = materialize(known_terms(id_text(docs)), "imatch-lexicon")
    whole, links = with_edited(docs)
    both = F.array(
        F.struct(F.lit(0).alias("which"), F.col("text").alias("t"), F.lit(None).cast("string").alias("sha")),
        F.struct(F.lit(1).alias("which"), F.col("edited").alias("t"), F.sha2("edited", 256).alias("sha")),
    )
    texts = whole.select("k", "h", F.explode(both).alias("e")).select("k", "h", "e.which", "e.sha", F.col("e.t").alias("text"))
    fps = fingerprints(texts, ["k", "h", "which"], known, carry=("sha",))
    pair = fps.groupBy("k", "h").agg(
        F.max("sha").alias("edited_sha256"),
        F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("efp"),
    )
    pair = materialize(pair, "imatch-prints")
    following = pair.select(F.col("k").alias("k2"), F.col("h").alias("h2"), F.col("fp").alias("nfp"))
    out = links.join(pair, ["k", "h"]).join(following, ["k2", "h2"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(
        F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        show(F.col("fp")).alias("fingerprint"),
        show(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    )
