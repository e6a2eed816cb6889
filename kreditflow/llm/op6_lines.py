"""Line deduplication by a suffix array over line sequences, in DataFrame operations alone.

A document is the sequence of its lines that hold a word.  A run of lines that
occurs again is repeated; runs of at least ``min_words`` words are deleted
wherever a copy comes earlier, by document and place.

Suffixes are ranked by distributed prefix doubling: the rank of a line is its
place among the sorted distinct lines, and the rank of 2h lines is the place of
the pair (rank of the first h, rank of the next h) among the sorted pairs; the
pairs are counted, sorted by range and numbered in order, so no task sees all of
them.  Suffixes whose prefix occurs once drop out at once, so each round works on
what still repeats.  Ranks are needed up to the longest prefix that decides: the
shortest run of min_words words from a line on has at most min_words lines.

Two places lie in one longest-common-prefix interval of depth n exactly if they
have equal ranks for their first and for their last 2^k <= n of n lines.  Every
maximal repeated run is the union of its shortest runs of min_words words, one
forward and one backward from each line, and these repeat with it, so the
intervals of the shortest runs are enough to delete exactly the later copies of
maximal runs.

A null or empty text has no lines and stays empty; lines without words are kept,
unless no line with a word remains: then the text is empty.  Documents without
an id come last; rows repeated with the same id and text count as one document
and all get its result; an empty table gives an empty result; extra columns pass
through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kreditflow.llm.common import SPACE, computed_once, documents, materialize, words_of

MIN_WORDS = 50
LAST_ID = 2**63 - 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` with the order (k, h) of its document and its text t; inner names don't clash with the table's."""
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return own.select("row", F.coalesce("i", F.lit(LAST_ID)).alias("k"), F.xxhash64("t", F.col("i").isNull()).alias("h"), "t")


def _has_word(line: Column) -> Column:
    return line.rlike(f"[^{SPACE}]")


def repeated_lines(keyed: DataFrame) -> DataFrame:
    """(k, h, pos, line_no, line, n): lines that occur more than once; pos counts a document's lines with words."""
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("x"))), lambda s: _has_word(s["x"]))
    rows = keyed.select("k", "h", F.posexplode(lines).alias("pos", "s"))
    rows = rows.select("k", "h", "pos", "s.line_no", F.xxhash64("s.x").alias("line"), F.size(words_of(F.col("s.x"))).alias("n"))
    again = materialize(rows.groupBy("line").agg(F.count("*").alias("c")).filter("c > 1").select("line"), "lines-again")
    return rows.join(again, "line").dropDuplicates(["k", "h", "pos"])


def _named(pairs: DataFrame, level: int) -> DataFrame:
    """(k, h, pos, rank): the order of the pair (a, b) among all pairs that occur more than once."""
    found = pairs.groupBy("a", "b").agg(F.count("*").alias("c")).filter("c > 1")
    names = materialize(found.select("a", "b").orderBy("a", "b").withColumn("rank", F.monotonically_increasing_id()), f"lines-names{level}")
    return materialize(pairs.join(names, ["a", "b"]).select("k", "h", "pos", "rank"), f"lines-ranks{level}")


def prefix_ranks(lines: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (k, h, pos, rank) for prefixes of 1, 2, 4, ... lines; places whose prefix occurs once are left out."""
    out = [_named(lines.select("k", "h", "pos", F.col("line").alias("a"), F.lit(0).cast("long").alias("b")), 0)]
    for level in range(1, levels):
        first = out[-1].withColumnRenamed("rank", "a")
        then = out[-1].select("k", "h", (F.col("pos") - 2 ** (level - 1)).alias("pos"), F.col("rank").alias("b"))
        out.append(_named(first.join(then, ["k", "h", "pos"]), level))
    return out


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(k, h, pos, size): from each line on, forward and backward, the shortest run of min_words words without a gap."""
    ahead = Window.partitionBy("k", "h").orderBy("pos").rowsBetween(0, min_words - 1)
    back = Window.partitionBy("k", "h").orderBy(F.col("pos").desc()).rowsBetween(0, min_words - 1)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("size"), F.lit(True).alias("open"))

    def size_of(run: Column, pos: Column, way: int) -> Column:
        def step(a: Column, x: Column) -> Column:
            go = a["open"] & (a["sum"] < min_words) & (x["pos"] == pos + way * a["size"])
            return F.struct(F.when(go, a["sum"] + x["n"]).otherwise(a["sum"]).alias("sum"), F.when(go, a["size"] + 1).otherwise(a["size"]).alias("size"), go.alias("open"))

        return F.aggregate(run, start, step, lambda a: F.when(a["sum"] >= min_words, a["size"]))

    item = F.struct("pos", F.least("n", F.lit(min_words)).alias("n"))
    runs = lines.select("k", "h", "pos", F.collect_list(item).over(ahead).alias("f"), F.collect_list(item).over(back).alias("g"))
    sized = runs.select("k", "h", "pos", size_of(F.col("f"), F.col("pos"), 1).alias("f"), size_of(F.col("g"), F.col("pos"), -1).alias("g"))
    both = F.array(F.struct("pos", F.col("f").alias("size")), F.struct((F.col("pos") - F.col("g") + 1).alias("pos"), F.col("g").alias("size")))
    return sized.select("k", "h", F.explode(both).alias("e")).filter("e.size is not null").select("k", "h", "e.pos", "e.size").distinct()


def later_copies(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, h, pos) of the lines to delete."""
    runs = materialize(shortest_runs(lines, min_words), "lines-runs")
    longest = runs.agg(F.max("size")).collect()[0][0] or 0  # one number, at most min_words
    ranks = prefix_ranks(lines, longest.bit_length())
    parts = None
    for level, rank in enumerate(ranks):
        own = runs.filter((F.col("size") >= 2**level) & (F.col("size") < 2 ** (level + 1)))
        last = rank.select("k", "h", F.col("pos").alias("at"), F.col("rank").alias("b"))
        own = own.withColumn("at", F.col("pos") + F.col("size") - 2**level).join(rank.withColumnRenamed("rank", "a"), ["k", "h", "pos"]).join(last, ["k", "h", "at"])
        own = own.select("k", "h", "pos", "size", "a", "b")
        parts = own if parts is None else parts.unionByName(own)
    if parts is None:
        return lines.select("k", "h", "pos").limit(0)
    parts = materialize(parts, "lines-intervals")
    place = F.struct("k", "h", "pos")
    firsts = parts.groupBy("size", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    firsts = materialize(firsts, "lines-firsts")
    later = parts.join(firsts, ["size", "a", "b"]).filter(place != F.col("first"))
    return later.select("k", "h", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("size") - 1)).alias("pos")).distinct()


def drop_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` (the table's columns), ``kept_text``, ``n_lines`` (with words) and ``n_removed``."""
    keyed = _keyed(docs, id_col, text_col)
    lines = materialize(repeated_lines(keyed), "lines")
    gone = later_copies(lines, min_words).join(lines.select("k", "h", "pos", "line_no"), ["k", "h", "pos"])
    gone = materialize(gone.groupBy("k", "h").agg(F.collect_list("line_no").alias("gone")), "lines-gone")
    # a merge join at any size: the deletions have no bound that would allow a broadcast; the text travels once, in its row
    out = keyed.drop("t").join(gone.hint("merge"), ["k", "h"], "left")
    out = out.withColumn("t", F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))).withColumn("lines", F.split("t", "\n"))
    out = out.withColumn("left", F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))))
    text = F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")
    kept = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.when(_has_word(text), text).otherwise(""))
    n_lines = F.size(F.filter("lines", _has_word)).cast("long")
    return out.select("row", computed_once(kept).alias("kept_text"), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op6_lines(spark, sf_dir: str) -> DataFrame:
    """Line deduplication of all ``documents``: what is left of every text."""
    out = drop_repeated_runs(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.char_length("kept_text").cast("long").alias("kept_chars"))


#: Runs as whole strings, with no ranks: the shortest runs forward and backward, their first place, and what they cover.
SQL = rf"""
WITH l0 AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no FROM documents),
l1 AS (SELECT *, regexp_matches(x, '[^ \t\n\x0B\f\r]') AS has FROM l0),
l2 AS (SELECT doc_id, x, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos,
        len(list_filter(regexp_split_to_array(x, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS n FROM l1 WHERE has),
l AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM l2),
f AS (SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.pos < a.pos + {MIN_WORDS} AND b.c - a.c + a.n >= {MIN_WORDS} GROUP BY 1, 2),
g AS (SELECT a.doc_id, max(b.pos) AS s, a.pos AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.pos <= a.pos AND b.pos > a.pos - {MIN_WORDS} AND a.c - b.c + b.n >= {MIN_WORDS} GROUP BY 1, 3),
r AS (SELECT * FROM f UNION SELECT * FROM g),
t AS (SELECT r.doc_id, r.s, r.e, string_agg(l.x, chr(10) ORDER BY l.pos) AS run FROM r JOIN l ON l.doc_id = r.doc_id AND l.pos BETWEEN r.s AND r.e GROUP BY 1, 2, 3),
o AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS copy FROM t),
d AS (SELECT DISTINCT l.doc_id, l.line_no FROM o JOIN l ON l.doc_id = o.doc_id AND l.pos BETWEEN o.s AND o.e WHERE copy > 1),
k AS (SELECT l1.doc_id, string_agg(CASE WHEN d.doc_id IS NULL THEN x END, chr(10) ORDER BY l1.line_no) AS kept,
        CAST(count(*) FILTER (has) AS BIGINT) AS n_lines, CAST(count(d.line_no) AS BIGINT) AS n_removed
      FROM l1 LEFT JOIN d ON d.doc_id = l1.doc_id AND d.line_no = l1.line_no GROUP BY 1),
z AS (SELECT doc_id, n_lines, n_removed, CASE WHEN n_removed = 0 OR regexp_matches(kept, '[^ \t\n\x0B\f\r]') THEN kept ELSE '' END AS kept FROM k)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars FROM z
"""
