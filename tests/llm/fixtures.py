"""Small tables with every hard case: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, k long, h long, key string, block long, "
    "word string, ids string, node long, label string, kept string, piece int, length long, bucket int, lines string, t string, w string, band long"
)
SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
CLASH = ["x", 7, 7, "x", 7, "x", "x", 7, "x", "x", 7, 7, 7, "x", "x", "x", 7]


def prose(rng: random.Random, n: int) -> str:
    few = "the of and to in is that for it with as on be at by this from".split()
    words = [rng.choice(few) if rng.random() < 0.4 else "".join(rng.choice("abcdefghilmnorstuéß") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    out = []
    for i, w in enumerate(words):
        out.append(w)
        out.append("\n" if i % 12 == 11 else " ")
    return "".join(out).strip()


def rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (5, 40, 90, 130, 200, 400, 700)]
    passage = prose(rng, 66)
    texts: list = list(base)
    texts += [base[3], base[3], base[4] + " tail", base[4].replace("the", "The", 3)]  # copies and near copies
    texts += [base[1] + "\n" + passage + "\n" + prose(rng, 80), prose(rng, 70) + "\n" + passage]  # a shared passage
    texts += [None, "", " \n\t ", "\n\n", "a", "A a a a a a a", "1 2 3 4 !!", "### $$$ %%% " * 30, "hello world", "Hello  World\n"]
    texts += ["mañana café İstanbul Σσς 中文字 é \U0001f600 नमस्ते it's we'll 'sx", "x<|endoftext|>y <|startoftext|> z", "tab\tand\x0bvt\x1cfs\x85nel em  two spaces "]
    texts += ["word " * 30_000, prose(rng, 4000), "z" * 5000, "line one\n" * 300]
    out = [(i * 3, t) for i, t in enumerate(texts)]
    out += [(9, base[3]), (9, base[3]), (9, "another text under the same id " + base[0])]  # repeated rows, one id twice
    out += [(None, base[5]), (None, None), (None, base[5])]
    langs = ["en", None, "fr", "de"]
    return [(i, t, langs[n % 4], None if n % 5 == 0 else "s", None, *CLASH) for n, (i, t) in enumerate(out)]


def table(spark, seed: int = 3):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def id_texts(seed: int = 3) -> list[tuple]:
    return [(r[0], r[1]) for r in rows(seed)]


def stored(df, folder) -> str:
    """The table as documents.parquet of a scale folder."""
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)
