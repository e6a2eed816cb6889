"""WARC round trip, quality rules, language model and language identification."""

import gzip
import itertools
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np

from kreditflow.llm import op4_warc as W
from kreditflow.llm import op7_quality as Q
from kreditflow.llm import op8_suffix_tree as S
from kreditflow.llm import op10_language as G
from kreditflow.session import scratch_path
from tests.llm import fixtures as X

# ---------------------------------------------------------------- WARC
BIG = "<html>" + "x" * 200
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2", "<p>short</p>"), (3, "http://a/3", "<p>short</p>"), (4, None, None), (5, "http://a/5", ""), (6, "http://a/6\r\nX: y", BIG),
         (7, "http://a/7", "WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\n" * 9 + "é中"), (8, "http://a/8", "WARC/1.1\r\n"), (8, "http://a/8", "WARC/1.1\r\n"),
         (9, "u", BIG), (9, "u", BIG), (None, "n", BIG), (10, "t", "y" * 3_000_000 + "\r\n\r\n"), (11, "t", "tail\r\n" * 40), (12, "t", "tail\r\n" * 40), (None, "m", "z" * 150), (None, "m", "z" * 150)]


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, payload string, digest int")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = W.op4_warc(spark, str(tmp_path)).collect()
    assert Counter((r.page_id, r.payload_bytes) for r in got) == Counter((p, len((h or "").encode())) for p, _, h in PAGES)
    kind = {}
    for r in got:
        kind.setdefault(r.page_id, []).append((r.record_type, r.refers_to))
    assert kind[1] == [("response", None)] and kind[6] == [("revisit", 1)] and kind[9] == [("revisit", 1)] * 2
    assert kind[2] == kind[3] == kind[4] == kind[5] == [("response", None)]
    assert kind[8] == [("response", None)] * 2  # under 100 bytes
    assert kind[12] == [("revisit", 11)]
    assert sorted(kind[None], key=str) == sorted([("revisit", 1), ("response", None), ("revisit", None)], key=str)
    empty = str(tmp_path / "none")
    spark.createDataFrame([], df.schema).write.parquet(f"{empty}/pages.parquet")
    assert W.op4_warc(spark, empty).collect() == []


def test_warc_nested_rows(spark):
    path = scratch_path(spark, "warc-test")
    W.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    records = W.read_archives(spark, path).cache()
    assert records.count() == 3 * len(PAGES)
    rows = W.assemble(records).collect()
    assert len(rows) == len(PAGES) and all(r.main and r.request and r.metadata for r in rows)
    by_page = {r.metadata.head.strip(): r for r in rows}
    assert bytes(by_page["page-id: 7"].main.payload).decode() == PAGES[6][2]
    assert by_page["page-id: 6"].main.payload is None and by_page["page-id: 6"].main.refers_to == by_page["page-id: 1"].main.record_id
    assert by_page["page-id: 6"].request.target_uri == "http://a/6%0D%0AX: y"


def record(version, kind, block, more=""):
    return f"WARC/{version}\r\nWARC-Type: {kind}\r\n{more}Content-Length: {len(block.encode())}\r\n\r\n{block}\r\n\r\n".encode()


def test_warc_versions_members_and_broken_records(spark, tmp_path):
    http = "HTTP/1.1 200 OK\r\n\r\n"
    kind = "Content-Type: application/http; msgtype=response\r\n"
    own = [record(v, "response", http + body, kind + f"WARC-Record-ID: <{i}>\r\n") for i, (v, body) in enumerate([("1.0", "one"), ("1.1", "WARC/1.0\r\nWARC-Type: fake\r\n\r\nWARC/1."), ("1.0", "three"), ("1.1", "")])]
    files = {"old": [b"".join(own[:1] * 3)], "mixed": [b"".join(own)], "members": own, "bare": [own[2].rstrip(b"\r\n")]}
    for name, members in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in members))
    got = W.read_archives(spark, str(tmp_path)).collect()
    bodies = [b"one", b"WARC/1.0\r\nWARC-Type: fake\r\n\r\nWARC/1.", b"three", b""]
    assert Counter((r.record_id, bytes(r.payload)) for r in got) == Counter([("<0>", b"one")] * 3 + [(f"<{i}>", b) for i, b in enumerate(bodies)] * 2 + [("<2>", b"three")])
    broken = tmp_path / "broken"
    broken.mkdir()
    cut, lost, before = own[0][:-12], b"WARC/1.0\r\nWARC-Type: response\r\n\r\nno length\r\n\r\n", b"before the first\r\n"
    for name, data in {"cut": own[1] + cut, "length": lost + own[2], "before": before + own[0], "after": own[0] + b"tail", "last": own[0] + b"WARC/1.0"}.items():
        (broken / f"{name}.warc.gz").write_bytes(gzip.compress(data))
    got = W.read_archives(spark, str(broken)).collect()
    assert Counter(r.record_id for r in got if r.warc_type == "response") == Counter({"<0>": 3, "<1>": 1, "<2>": 1})
    left = sorted(bytes(r.payload).strip() for r in got if r.warc_type == W.UNCOVERED)
    assert left == sorted([cut[7:].strip(), lost.strip(), before.strip(), b"tail", b"WARC/1.0"])


# ---------------------------------------------------------------- quality
def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + j for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_counts(spark, tmp_path):
    got = Q.op7_quality(spark, X.stored(X.table(spark), tmp_path))
    assert Counter(map(tuple, got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())) == Counter((i, *brute_quality(t)) for i, t in X.id_texts())
    assert all(not r.kept for r in got.collect() if r.base_failed)
    assert Q.op7_quality(spark, X.stored(X.empty(spark), tmp_path)).collect() == []


def test_quality_rules_and_filter(spark):
    good = " ".join(f"the word{i} of place{i} and other{i}" for i in range(20))
    rows = [(1, good), (2, good.replace("word", "### $$$ ")), (3, " ".join(f"q{i} zz{i} x{i}x" for i in range(40))), (4, None)]
    j = Q.judge(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.row.doc_id for r in j.filter("kept").collect()] == [1]
    assert {r.row.doc_id: (r.kept, "symbols" in r.broken, "stop_words" in r.broken) for r in j.collect()} == {1: (True, False, False), 2: (False, True, False), 3: (False, False, True), 4: (False, False, False)}


# ---------------------------------------------------------------- language model
def test_suffix_tree_base_and_sums(spark, tmp_path):
    texts = X.id_texts()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    toks = [(i, [*(t or "").encode().lower().split(), 0]) for i, t in texts]
    c = Counter(x for i, t in toks if not held(i) for x in t)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 6)) for i, t in toks)
    got = S.op8_suffix_tree(spark, X.stored(X.table(spark), tmp_path)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert S.op8_suffix_tree(spark, X.stored(X.empty(spark), tmp_path)).collect() == []


def test_suffix_tree_keeps_the_end_and_words_with_nul_apart(spark):
    words = ["\0end", "\0start", "\0total", "x", "end"]
    texts = [(i, " ".join(words[(i * k) % 5] for k in range(1, 8 + i % 3))) for i in range(80)] + [(80, "x \0end y"), (81, "\0end"), (82, None)]
    _, want = brute_tree(texts, 99)
    c = Counter(x for i, t in texts if not S.is_held_out(i) for x in [*(t or "").encode().lower().split(), 0])
    n, v = sum(c.values()), len(c)
    got = S.score_texts(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, round(r.score, 6)) for r in got) == want
    base = {i: sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*(t or "").encode().lower().split(), 0]) for i, t in texts}
    assert all(abs(r.base_score - base[r.doc_id]) < 1e-9 and r.train_tokens == n for r in got)


def test_suffix_tree_states_sum_to_one_and_are_closed(spark, monkeypatch):
    monkeypatch.setattr(S, "P_MIN", 0.01)
    import random

    rng = random.Random(2)
    texts = []
    for i in range(300):
        w = ["a", "b"]
        while len(w) < 40:
            w.append("c" if w[-2:] == ["a", "b"] else "a" if w[-1] == "c" and rng.random() < 0.9 else rng.choice("abdef"))
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    seen = {}
    learn = S.learn
    monkeypatch.setattr(S, "learn", lambda *a, **k: seen.setdefault("tree", learn(*a, **k)))
    rows = S.score_texts(docs).collect()
    tree = seen["tree"]
    assert any(at.kept.any() for at in tree.levels)
    unseen = 1 - tree.root.sum()
    for d, at in enumerate(tree.levels, 1):
        for c in np.flatnonzero(at.kept):
            own = tree.prob(d, np.full(len(tree.symbols), c), np.arange(len(tree.symbols))).sum()
            other, level, place = unseen, d, c
            while level:
                other, place, level = other * tree.levels[level - 1].rest[place], tree.levels[level - 1].suffix[place], level - 1
            assert abs(own + other - 1) < 1e-9
            assert d == 1 or tree.levels[d - 2].kept[at.suffix[c]]
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def brute_tree(texts, depth):
    """Kept contexts of each length and every text's score, by direct counting."""
    toks = [(i, [*(t or "").encode().lower().split(), 0]) for i, t in texts]
    train = [w for i, w in toks if not S.is_held_out(i)]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    levels = []

    def prob(w, k):
        p = (c[w[k]] + 1) / (n + v + 1)
        for d, kept in enumerate(levels, 1):
            x = context(w, k, d)
            if x not in kept:
                break
            total, follow, rest = kept[x]
            p = (follow[w[k]] - 0.5) / total if w[k] in follow else rest * p
        return p

    def context(w, k, d):
        return tuple(w[j] if j >= 0 else -1 for j in range(k - d, k))

    while len(levels) < depth:
        d, found, above = len(levels) + 1, {}, {}
        for w in train:
            for k in range(len(w)):
                x = context(w, k, d)
                if d == 1 or x[1:] in levels[-1]:
                    found.setdefault(x, Counter())[w[k]] += 1
                    above[x, w[k]] = (w, k)
        kept = {}
        for x, follow in found.items():
            total, follow = sum(follow.values()), {s: m for s, m in follow.items() if m > 1}
            p = {s: (m - 0.5) / total for s, m in follow.items()}
            q = {s: prob(*above[x, s]) for s in follow}
            left, under = (max(1 - sum(y.values()), 1e-12) for y in (p, q))
            gain = sum(p[s] * math.log(p[s] / q[s]) for s in p) + left * math.log(left / under)
            if total > 1 and total * gain > 0.5 * len(p) * math.log(total):
                kept[x] = (total, follow, (1 - sum(p.values())) / under)
        if not kept:
            break
        levels.append(kept)
    return levels, Counter((i, round(sum(math.log10(prob(w, k)) for k in range(len(w))), 6)) for i, w in toks)


def test_suffix_tree_keeps_rare_contexts(spark):
    import random

    rng = random.Random(5)
    often = [f"w{k}" for k in range(60)]
    texts = [(i, " ".join(rng.choice(often) for _ in range(100))) for i in range(300)]
    rare = [i for i, _ in texts if not S.is_held_out(i)][:3]  # three of 25,000 tokens
    texts = [(i, t + " scarce pair" if i in rare else t) for i, t in texts]
    new = next(i for i, _ in texts if S.is_held_out(i))
    texts = [(i, "scarce pair" if i == new else t) for i, t in texts]
    got = S.score_texts(spark.createDataFrame(texts, "doc_id long, text string"), depth=2).collect()
    levels, want = brute_tree(texts, 2)
    assert (b"scarce",) in levels[0]
    assert Counter((r.doc_id, round(r.score, 6)) for r in got) == want
    own = next(r for r in got if r.doc_id == new)
    assert own.score > own.base_score + 3


def test_suffix_tree_grows_past_two_tokens(spark):
    import random

    rng = random.Random(8)
    texts = []
    for i in range(150):
        w = [rng.choice("ab") for _ in range(4)]
        while len(w) < 80:
            w.append("a" if rng.random() < 0.5 + 0.12 * sum(1 if x == "a" else -1 for x in w[-4:]) else "b")  # each of four tokens back tells of the next
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    levels, want = brute_tree(texts, 99)
    assert len(levels) >= 4
    rows = S.score_texts(docs).collect()
    assert Counter((r.doc_id, round(r.score, 6)) for r in rows) == want
    # frequent contexts in salted parts, many parts, walks that look at their texts again every two levels
    for limits in (S.Limits(salt_at=300, part_pairs=500), S.Limits(from_texts=1, reach=2), S.Limits(salt_at=50, part_pairs=2_000, from_texts=1, reach=1)):
        assert Counter((r.doc_id, round(r.score, 6)) for r in S.score_texts(docs, limits=limits).collect()) == want
    two = {r.doc_id: r.score for r in S.score_texts(docs, depth=2).collect()}
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(two[r.doc_id] for r in held) + 0.01 * sum(r.n_tokens for r in held)


# ---------------------------------------------------------------- languages
def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.001"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = G.op10_language(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_mixtures_find_both_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, p = G.load(G.learn(docs.filter("doc_id % 2 = 0")))
    texts = {r.lang: r.text for r in docs.filter("doc_id % 2 = 1 AND n_chars BETWEEN 1500 AND 3000").collect()}
    for a, b in (("en", "fr"), ("de", "es")):
        share, chosen = G.infer(texts[a][:1200] + " " + texts[b][:1200], p)
        assert {names[i] for i in chosen} == {a, b}
        assert abs(share[chosen[0]] - 0.5) < 0.15
        assert [names[i] for i in G.infer(texts[a], p)[1]] == [a]


def test_language_of_odd_rows(spark, tmp_path):
    got = G.op10_language(spark, X.stored(X.table(spark), tmp_path)).collect()
    assert len(got) == len(X.rows())
    letters = {i: bool(t) and any(unicodedata.category(c)[0] == "L" for c in t) for i, t in X.id_texts() if i not in (None, 9)}
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) for r in got if r.doc_id in letters)
    assert all(0 <= r.score <= 1 for r in got)
    assert G.op10_language(spark, X.stored(X.empty(spark), tmp_path)).collect() == []
    unlabelled = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in X.rows()], X.SCHEMA)
    assert {r.lang_pred for r in G.op10_language(spark, X.stored(unlabelled, tmp_path)).collect()} <= {"und"}


def test_language_needs_a_letter_and_not_a_number_sign(spark):
    bare = ["½ ² ³", "Ⅷ ①", "१२३", "_ 12 !", "\u0301", "ⓐ", ""]
    some = ["ª", "中", "ʰ", "e½"]
    assert not any(unicodedata.category(c)[0] == "L" for t in bare for c in t)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["plain words of a text", *bare, *some])], "doc_id long, text string, lang string")
    got = G.predict(docs, docs["doc_id"], G.learn(docs)).collect()
    assert {r.key: (r.lang_pred, r.score) for r in got if 1 <= r.key <= len(bare)} == dict.fromkeys(range(1, len(bare) + 1), ("und", 0.0))
    assert {r.lang_pred for r in got if r.key > len(bare)} == {"en"}


def brute_mixture(q, n):
    """The same maximum by many plain steps from even proportions."""
    share = [1 / q.shape[1]] * q.shape[1]
    for _ in range(3000):
        new = [0.0] * len(share)
        for row, m in zip(q, n, strict=True):
            whole = sum(s * x for s, x in zip(share, row, strict=True))
            for i, x in enumerate(row):
                new[i] += m * share[i] * x / whole
        share = [x / sum(n) for x in new]
    return share, sum(m * math.log(sum(s * x for s, x in zip(share, row, strict=True))) for row, m in zip(q, n, strict=True))


def test_language_mixture_and_set_equal_direct_search(spark):
    rng = np.random.default_rng(3)
    for k in (1, 2, 3):  # expectation-maximisation against many plain steps
        q, n = rng.random((12, k)) + 0.05, rng.integers(1, 9, 12).astype(float)
        share, value = G.mixture(q, n)
        plain, best = brute_mixture(q, n)
        assert value <= best + 1e-9 and best - value < 0.05 and np.abs(share - plain).max() < 0.06
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, p = G.load(G.learn(docs.filter("doc_id % 2 = 0")))
    held = docs.filter("doc_id % 2 = 1 AND n_chars BETWEEN 300 AND 3000").orderBy("doc_id").collect()
    by = {x: [r.text for r in held if r.lang == x] for x in names}
    texts = [t for x in names for t in by[x][:6]] + [by[a][i][:700] + " " + by[b][i][:500] for a in names for b in names if a < b for i in range(2)]
    for text in texts:  # the chosen set against every subset of the languages
        counts = np.bincount(G.grams(text), minlength=len(p))
        at = np.flatnonzero(counts)
        n, q = counts[at].astype(float), p[at].astype(float)
        free = 0.5 * math.log(max(2.0, n.sum() / 3))
        value = {s: G.mixture(q[:, list(s)], n)[1] / 3 - free * (2 * len(s) - 1) for size in range(1, len(names) + 1) for s in itertools.combinations(range(len(names)), size)}
        chosen = G.infer(text, p)[1]
        assert value[tuple(sorted(chosen))] >= max(value.values()) - 0.05
