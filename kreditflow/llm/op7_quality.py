"""Quality rules: a threshold table compiled into one projection, without user functions or shuffles.

A rule bounds the ratio of two counts of a text, in percent.  The counts come
from built-in functions over the whole text: words are [^\\x20\\x09-\\x0D]+; a
word counts as a stop word when it is in the list of one of four languages
after lower-casing and without punctuation at its end; repeated words are those
covered by three-word windows that occur twice or more, found by sorting the
windows' hashes, never by comparing all pairs.

A null or empty text has no words and fails the base; repeated rows are judged
each on their own; an empty table gives an empty result; extra columns pass
through ``judge`` untouched (its results are one struct).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kreditflow.llm.common import SPACE, computed_once, documents, words_of

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = sorted(
    set(
        "the of and to in is that for it with as on be at by this from or an are was he she his her not but have a i you we they "
        "le la les de des du et en un une que qui dans pour par au ou est el los las y del se por con para su al "
        "der die das und zu den von im mit ist auf für ein eine nicht sich es dem".split()
    )
)
#: (rule, numerator, denominator, least percent, most percent); None: no bound.
RULES: list[tuple[str, str, str, int | None, int | None]] = [
    ("word_length", "word_chars", "n_words", 200, 1200),
    ("symbols", "n_symbols", "n_words", None, 10),
    ("stop_words", "n_stop_words", "n_words", 10, None),
    ("letter_words", "n_letter_words", "n_words", 70, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 40),
]


def _count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def measures(docs: DataFrame, text: Column) -> DataFrame:
    """Adds the struct column ``q`` of counts; inner columns are named so that none of the table's clash."""
    own = docs.select(F.struct("*").alias("row"), F.coalesce(text, F.lit("")).alias("t"))
    d = own.select("row", "t", words_of(F.col("t")).alias("w"))
    d = d.withColumn("n", F.size("w"))
    windows = F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    d = d.withColumn("hs", F.when(F.col("n") >= 3, windows).otherwise(F.array().cast("array<long>")))
    again = F.size(F.array_distinct("hs")) < F.size("hs")
    d = d.withColumn("s", F.when(again, F.sort_array(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = F.filter("s", lambda x, j: F.coalesce(F.when(j > 0, F.get("s", j - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get("s", j + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("p", F.sort_array(F.transform(twin, lambda x: x["i"])))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
    step = lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(3), x - a["last"])).alias("sum"))
    repeat = F.coalesce(F.aggregate("p", start, step, lambda a: a["sum"]), F.lit(0)).cast("long")
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    bare = lambda x: F.rtrim(F.lower(x), F.lit(".,;:!?"))
    q = F.struct(
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("t", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: bare(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        _count_words(F.regexp_replace("t", rf"[^\p{{L}}{SPACE}]+", "")).alias("n_letter_words"),
    )
    return d.select("row", q.alias("q"))


def compile_rules(rules: list = RULES) -> Column:
    """Names of the rules that a text breaks, as one expression over the struct ``q``."""
    broken = []
    for name, top, bottom, least, most in rules:
        percent, of = F.col(f"q.{top}") * 100, F.col(f"q.{bottom}")
        bad = F.lit(False)
        if least is not None:
            bad = bad | (percent < of * least)
        if most is not None:
            bad = bad | (percent > of * most)
        broken.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*broken))


def judge(docs: DataFrame, text_col: str = "text", rules: list = RULES) -> DataFrame:
    """``row`` (the table's columns), ``q`` (counts), ``base_failed``, ``broken`` (rule names) and ``kept``."""
    m = measures(docs, F.col(text_col).cast("string"))
    base = (F.col("q.n_words") < MIN_WORDS) | (F.col("q.n_repeat_words") * 100 > F.col("q.n_words") * MAX_REPEAT_PERCENT)
    m = m.select("row", "q", base.alias("base_failed"), compile_rules(rules).alias("broken"))
    return m.withColumn("kept", computed_once(~F.col("base_failed") & (F.size("broken") == 0)))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict for every whole text of ``documents``."""
    j = judge(documents(spark, sf_dir).select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_letter_words"]
    return j.select(F.col("row.doc_id").alias("doc_id"), *[F.col(f"q.{n}").alias(n) for n in names], "base_failed", "kept")


def _sql_rules() -> str:
    parts = []
    for _, top, bottom, least, most in RULES:
        parts += [f"{top} * 100 >= {bottom} * {least}"] if least is not None else []
        parts += [f"{top} * 100 <= {bottom} * {most}"] if most is not None else []
    return " AND ".join(parts)


_WS = r"[ \t\n\x0B\f\r]+"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM d),
wp AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM a),
tri AS (SELECT doc_id, i, [word, lead(word, 1) OVER s, lead(word, 2) OVER s] AS g,
               lead(word, 2) OVER s IS NOT NULL AS whole FROM wp WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
tw AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri WHERE whole),
cov AS (SELECT DISTINCT doc_id, i + k AS i FROM tw, (VALUES (0), (1), (2)) v(k) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM cov GROUP BY 1),
m AS (SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{_WS}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') IN ({", ".join(f"'{s}'" for s in STOP_WORDS)}))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS BIGINT) AS n_letter_words
  FROM a LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM m)
SELECT *, NOT base_failed AND {_sql_rules()} AS kept FROM b
"""
