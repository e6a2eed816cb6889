"""The corpus pipeline stage by stage against direct computations, on a table with every hard case."""

import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from kreditflow.llm import op7_quality
from tests.llm import fixtures as X
from tests.llm.test_models import brute_quality
from tests.llm.test_near import brute_lines, classes
from tests.llm.test_tokens import check_packing


def rows_of(df):
    assert df.columns == X.SCHEMA_NAMES
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_are_in_order_and_handle_empty_tables(spark):
    assert [n for n, _ in P.STAGES] == ["language", "quality", "lines", "near_duplicates", "packing"]
    for _, stage in P.STAGES:
        assert stage(spark, X.empty(spark), "").collect() == []


def test_language_stage_drops_texts_without_letters(spark):
    docs = X.table(spark)
    got = Counter(rows_of(P.language(spark, docs, "")))
    all_rows = Counter(X.id_texts())
    assert not got - all_rows
    assert not [t for (_, t) in got if not re.search(r"[^\W\d_]", t or "")]
    # clean prose in one language stays
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = docs.filter("n_chars > 300")
    assert P.language(spark, docs, "").filter("n_chars > 300").count() == long.count()


def test_quality_stage_keeps_what_the_rules_keep(spark):
    got = Counter(rows_of(P.quality(spark, X.table(spark), "")))
    judged = op7_quality.judge(X.table(spark)).filter("kept").select("row.doc_id", "row.text").collect()
    assert got == Counter((r.doc_id, r.text) for r in judged) and got
    assert not [1 for (_, t) in got if brute_quality(t)[-1]]


def test_lines_stage_deletes_later_copies(spark):
    texts = [(i, t) for i, t in X.id_texts() if i != 9 and len(t or "") < 20_000 and (t or "").count("\n") < 120]
    docs = X.table(spark).filter("(doc_id IS NULL OR doc_id <> 9) AND coalesce(length(text), 0) < 20000 AND size(split(coalesce(text, ''), '\n')) <= 120")
    want = Counter()
    for (i, t), (_, gone, kept) in (((i, t), brute_lines(texts, 50)[1 << 70 if i is None else i, t or ""]) for i, t in texts):
        if not gone:
            want[(i, t)] += 1
        elif kept:
            want[(i, kept)] += 1
    got = P.lines(spark, docs, "")
    assert Counter(rows_of(got)) == want
    assert sum(want.values()) < len(texts)


def test_near_duplicates_stage_keeps_one_of_each_group(spark):
    got = Counter(i for i, t in rows_of(P.near_duplicates(spark, X.table(spark), "")) if t and t.split())
    groups = {c for (_, n, c, _) in classes(X.id_texts(), 5) if n}
    assert {i for i in got} == groups and max(got.values()) == 1


def test_whole_pipeline(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).checkpoint(eager=True)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(r.doc_id, [*t.encode(r.text, add_special_tokens=False).ids, 2]) for r in docs.collect()]
    assert len(ids) > 100
    check_packing(out, ids)
