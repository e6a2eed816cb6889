"""Near-duplicates, fingerprints and line runs against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import regex
import xxhash
from pyspark.sql import functions as F

from kreditflow.llm import op3_minhash as M
from kreditflow.llm import op5_imatch as I
from kreditflow.llm import op6_lines as L
from kreditflow.llm.components import components
from tests.llm import fixtures as X


def classes(texts, k, percent=80):
    """Component of each row by comparing all pairs; the smallest id, ids of None last."""
    sets = [M.shingle_set(M.split_words(t or ""), k) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            one_id = sets[i] and sets[j] and texts[i][0] is not None and texts[i][0] == texts[j][0]
            if one_id or (sets[i] and both * 100 >= percent * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(texts):
        r = find(i)
        low[r] = min(low.get(r, 1 << 70), 1 << 70 if doc is None else doc)
    out = []
    for i, (doc, _) in enumerate(texts):
        c = doc if not sets[i] else None if low[find(i)] == 1 << 70 else low[find(i)]
        out.append((doc, len(sets[i]), c, doc == c))
    return Counter(out)


def test_near_duplicates_equal_all_pairs(spark, tmp_path):
    got = M.op3_minhash(spark, X.stored(X.table(spark), tmp_path)).collect()
    assert Counter(map(tuple, got)) == classes(X.id_texts(), 2)
    assert M.op3_minhash(spark, X.stored(X.empty(spark), tmp_path)).collect() == []


def test_different_texts_under_one_id_lose_no_link(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(90)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " q"), (3, b + " q"), (4, "alone here"), (5, a + " r"), (5, "alone there too"), (6, "alone there too")]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (6, 1)}
    big = [(2**63 - 1, a), (2**63 - 2**31, a + " q"), (None, b), (None, b + " q")]
    got = M.near_duplicates(spark.createDataFrame(big, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter([(2**63 - 1, 2**63 - 2**31, False), (2**63 - 2**31, 2**63 - 2**31, True), (None, None, True), (None, None, True)])


def chain(n=40):
    """Texts of which each is linked with its neighbours alone, and a hub of near copies."""
    words = [f"w{i}" for i in range(300)]
    texts = [(i, " ".join(words[i * 3 : i * 3 + 60])) for i in range(n)]
    body = [f"v{i}" for i in range(100)]
    for i in range(n):
        own = list(body)
        own[i], own[(i * 7 + 3) % 100] = f"u{i}", f"t{i}"
        texts.append((1000 + i, " ".join(own)))
    return texts


def test_chains_and_large_groups_keep_all_links(spark):
    for k in (2, 5):
        df = spark.createDataFrame(chain(), "doc_id long, text string").repartition(4)
        assert Counter(map(tuple, M.near_duplicates(df, shingle_words=k).collect())) == classes(chain(), k)


def test_sketches_fill_every_coordinate_and_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 400, 5000):
        own = rng.integers(0, 2**63, n).astype(np.uint64)
        assert (M.sketch([own], 360) != np.iinfo(np.uint64).max).all()
    both, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    a, b = M.sketch([np.concatenate([both, one]), np.concatenate([both, two])], 360)
    assert abs((a == b).mean() - 0.8) < 0.09


def test_keep_one_row_of_each_group(spark):
    texts = X.id_texts()
    kept = M.keep_one(X.table(spark), shingle_words=5)
    assert kept.columns == X.table(spark).columns
    bare = Counter(i for i, t in texts if not (t or "").split())
    want = Counter({c: 1 for c in {c for (_, n, c, _), _ in classes(texts, 5).items() if n and c is not None}})
    got = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert got - bare - Counter([None]) == want - bare
    assert M.keep_one(X.empty(spark)).collect() == []


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 300), (300, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


# ---------------------------------------------------------------- fingerprints
def test_fingerprints_of_edited_and_next_texts(spark, tmp_path):
    texts = X.id_texts()
    got = I.op5_imatch(spark, X.stored(X.table(spark), tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts)
    named = [(i, t or "") for i, t in texts if i is not None]
    for r in got:
        own = {t for i, t in texts if i == r.doc_id and len(t or "") == r.n_chars}
        below = [i for i, _ in named if r.doc_id is not None and i < r.doc_id]
        if r.doc_id is not None and sum(i == r.doc_id for i, _ in named) == 1 and below and sum(i == max(below) for i, _ in named) == 1:
            text, then = (own.pop() or ""), dict(named)[max(below)]
            edited = text[: len(text) - len(text) // 2] + then[: len(text) // 2]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert (r.near_edited == 1.0) == (r.fingerprint == r.edited_fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text = {}
    for i, t in texts:
        own = {r.fingerprint for r in got if r.doc_id == i and r.n_chars == len(t or "")}
        if len(own) == 1:
            by_text.setdefault(t or "", set()).update(own)
    assert all(len(v) == 1 for v in by_text.values())
    assert I.op5_imatch(spark, X.stored(X.empty(spark), tmp_path)).collect() == []


def brute_prints(texts):
    """Fingerprint of every text by plain counting, sorting and hashing; the chain of seeds is Spark's."""
    hashed = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed=seed)
    terms = [sorted({w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}) for t in texts]
    distinct = {t: set(w) for t, w in zip(texts, terms, strict=True)}
    df = Counter(w for own in distinct.values() for w in own)
    low, high = I.IDF_BAND
    inside = {w for w, n in df.items() if low <= math.log(len(distinct) / n) <= high}

    def code(w):
        h = hashed(w.encode())
        bits = 1
        for j in range(1, I.SUBSETS + 1):
            x = hashed(j.to_bytes(4, "little"), h)
            bits |= (x & (2 ** ((j - 1) // I.EACH + 2) - 1) == 0) << j
        return ((h & (2**31 - 1)) << 32) + bits - (0 if w in inside else 1 << 63)

    def of(codes):
        h = 42
        for c in codes:
            h = hashed((c % (1 << 64)).to_bytes(8, "little"), h)
        return h & (2**31 - 1)

    out = []
    for own in terms:
        every = sorted(map(code, own))
        lex = [c for c in every if c >= 0]
        picks = [lex if j == 0 else [c for c in lex if c >> j & 1] for j in range(I.SUBSETS + 1)] + [[c for c in every if c % (1 << 64) >> j & 1] for j in I.OWN[1:]]
        prints = [of(c) if c else None for c in picks]
        out.append([*prints[: I.SUBSETS + 1], of(every), *prints[I.SUBSETS + 1 :]])
    return out


def test_fingerprints_and_likeness_equal_direct_computation(spark):
    rng = random.Random(12)
    common = ["".join(rng.choice("abcdefghé") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(rng.choice(common) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += [" ".join(f"s{i}x{j}" for j in range(30)) for i in range(5)] + ["", "Élan ÉLAN 42! mid-word", texts[3], texts[3], "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lex = I.lexicon(docs)
    assert lex.count() > 100
    got = {r.doc_id: list(r.fp) for r in I.fingerprints(docs, ["doc_id"], lex).collect()}
    want = brute_prints(texts)
    assert [got[i] for i in range(len(texts))] == want
    pairs = spark.createDataFrame([(want[i], want[i + 1]) for i in range(len(want) - 1)], "a array<int>, b array<int>")
    like = [r.x for r in pairs.select(I.likeness(F.col("a"), F.col("b")).alias("x")).collect()]
    plain = [sum(x is not None and x == y for x, y in zip(a, b, strict=True)) / sum(x is not None or y is not None for x, y in zip(a, b, strict=True)) for a, b in zip(want, want[1:], strict=False)]
    assert Counter(like) == Counter(plain)


def test_fingerprints_with_known_terms_equal_direct_computation(spark):
    """Terms too frequent for the band are looked up too; what goes with a key stays with it, and codes are hashed before they are collected."""
    rng = random.Random(21)
    often = [f"often{i}" for i in range(5)]  # in every text of words, so outside the band
    texts = [" ".join([*often, *(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(1, 40)))]) for _ in range(120)] + ["", "...", "only", "once again", "once again"]
    docs = spark.createDataFrame([(i, t, f"c{i}") for i, t in enumerate(texts)], "doc_id long, text string, own string")
    known = {r.term: r.code for r in I.known_terms(docs).collect()}
    inside = {r.term: r.code for r in I.lexicon(docs).collect()}
    assert {t: c for t, c in known.items() if c >= 0} == inside
    assert {t for t, c in known.items() if c < 0} >= set(often)
    fps = I.fingerprints(docs, ["doc_id"], I.known_terms(docs), carry=("own",))
    got = {r.doc_id: r for r in fps.collect()}
    assert [list(got[i].fp) for i in range(len(texts))] == brute_prints(texts)
    assert all(got[i].own == f"c{i}" for i in range(len(texts)))
    plan = fps._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(code#" in plan


def test_fingerprints_do_not_switch_with_the_number_of_lexicon_terms(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    shared = [word() for _ in range(8)]  # in the band: each in one text in 25
    rest = [(100 + i, " ".join([word() for _ in range(30)] + ([shared[i % 8]] if i % 3 == 0 else []))) for i in range(200)]
    for few in range(9):  # from no lexicon term to eight of 37
        body = [word() for _ in range(37 - few)] + shared[:few]
        docs = spark.createDataFrame([(0, " ".join(body)), (1, " ".join([*body[:-1], word()])), *rest], "doc_id long, text string")
        fps = I.fingerprints(docs, ["doc_id"], I.lexicon(docs)).filter("doc_id < 2")
        x = fps.alias("a").join(fps.alias("b")).filter("a.doc_id < b.doc_id").select(I.likeness(F.col("a.fp"), F.col("b.fp"))).collect()[0][0]
        assert x > 0.25


def test_fingerprints_in_a_hot_group_of_copies(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    hot = [word() for _ in range(300)]
    near = [(i, " ".join([*hot, f"other{i}"])) for i in range(40)]  # one word differs
    common = [word() for _ in range(30)]  # in 10 % of the others
    rest = [(100 + i, " ".join([word() for _ in range(20)] + [w for k, w in enumerate(common) if (i + k) % 10 == 0])) for i in range(80)]
    docs = spark.createDataFrame(near + [(40, " ".join([*hot, common[0]]))] + rest, "doc_id long, text string")
    fps = I.fingerprints(docs, ["doc_id"], I.lexicon(docs)).cache()
    pairs = fps.alias("a").join(fps.alias("b")).filter("a.doc_id < b.doc_id AND a.doc_id < 41")
    got = pairs.select("a.doc_id", F.col("b.doc_id").alias("other"), I.likeness(F.col("a.fp"), F.col("b.fp")).alias("x")).collect()
    assert all(r.x > 0.5 for r in got if r.other <= 40)
    assert all(r.x < 0.2 for r in got if r.other >= 100)


def test_lexicon_counts_distinct_texts(spark):
    texts = [("alpha beta",)] * 500 + [(f"gamma{i} delta",) for i in range(100)]
    df = spark.createDataFrame(texts, "text string")
    assert {r.term for r in I.lexicon(df, (3.0, 6.2)).collect()} == {"alpha", "beta", *(f"gamma{i}" for i in range(100))}


def test_next_documents_wrap_and_cross_ranges(spark, monkeypatch):
    monkeypatch.setattr(I, "RANGE_ROWS", 3)
    rows = spark.createDataFrame([(i * 5, i % 2, 4) for i in range(20)], "k long, h long, n long")
    got = {r.k: r.k2 for r in I.next_documents(rows).collect()}
    assert got == {i * 5: (i * 5 - 5) % 100 for i in range(20)}


# ---------------------------------------------------------------- line runs
def brute_lines(texts, min_words):
    """Delete, for every place, the longest run from there on that occurs earlier, if it has min_words words."""
    order = sorted({(1 << 70 if i is None else i, t or "") for i, t in texts}, key=lambda x: x[0])
    docs = [[(n, x) for n, x in enumerate(t.split("\n")) if x.encode().split()] for _, t in order]
    out = {}
    for d, (key, text) in enumerate(order):
        own, gone = docs[d], set()
        for i in range(len(own)):
            best = 0
            for e in range(d + 1):
                for j in range(len(docs[e]) if e < d else i):
                    size = 0
                    while i + size < len(own) and j + size < len(docs[e]) and own[i + size][1] == docs[e][j + size][1]:
                        size += 1
                    best = max(best, size)
            if sum(len(x.encode().split()) for _, x in own[i : i + best]) >= min_words:
                gone.update(n for n, _ in own[i : i + best])
        kept = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
        out[key, text] = (len(own), len(gone), kept if not gone or kept.encode().split() else "")
    return out


def test_line_runs_equal_brute_force(spark):
    for seed in (3, 4):
        texts = [(i, t) for i, t in X.id_texts(seed) if len(t or "") < 20_000 and (t or "").count("\n") < 120 and i != 9]
        want = brute_lines(texts, 20)
        df = X.table(spark, seed).filter("doc_id IS NULL OR doc_id <> 9").filter("coalesce(length(text), 0) < 20000 AND size(split(coalesce(text, ''), '\n')) <= 120")
        got = L.drop_repeated_runs(df, min_words=20).select("row.doc_id", "row.text", "n_lines", "n_removed", "kept_text").collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r.n_lines, r.n_removed, r.kept_text) == want[1 << 70 if r.doc_id is None else r.doc_id, r.text or ""]


def test_line_runs_of_random_lines(spark):
    import random

    rng = random.Random(8)
    texts = [(i, "\n".join(rng.choice(["a b c", "d e", "f", "g h i j k", "", "l m n", "o"]) for _ in range(rng.randint(1, 25)))) for i in range(30)]
    want = brute_lines(texts, 9)
    got = L.drop_repeated_runs(spark.createDataFrame(texts, "doc_id long, text string"), min_words=9).collect()
    for r in got:
        assert (r.n_lines, r.n_removed, r.kept_text) == want[r.row.doc_id, r.row.text]
    assert sum(r.n_removed for r in got) > 20


def test_line_query_on_empty_table(spark, tmp_path):
    assert L.op6_lines(spark, X.stored(X.empty(spark), tmp_path)).collect() == []
