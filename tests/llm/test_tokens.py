"""BPE encoding, packing and token counts against the libraries."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from kreditflow.llm import op1_bpe, op2_packing, op9_counts
from tests.llm import fixtures as X


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_encode_and_decode_equal_the_library(spark, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text in X.id_texts():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[(i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))] += 1
    got = op1_bpe.op1_bpe(spark, X.stored(X.table(spark), tmp_path))
    assert Counter(map(tuple, got.collect())) == want
    assert op1_bpe.op1_bpe(spark, X.stored(X.empty(spark), tmp_path)).collect() == []


def test_encode_keeps_ids_and_text(spark):
    out = op1_bpe.decode(op1_bpe.encode(spark.createDataFrame([(1, "The cat"), (2, None)], "doc_id long, text string"))).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id: (r.ids, r.decoded) for r in out} == {1: (t.encode("The cat", add_special_tokens=False).ids, "the</w> cat</w>"), 2: ([], "")}


def check_packing(rows, ids, capacity=1024):
    places, pieces = {}, Counter()
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for doc, own in ids:
        first = len(own) if len(own) <= capacity else len(own) % capacity or capacity
        cuts = [0, *range(first, len(own) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(doc, k, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes()))] += 1
    assert pieces == want
    return len(places)


def test_packing_pieces_and_places(spark, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in X.id_texts()]
    n = check_packing(op2_packing.op2_packing(spark, X.stored(X.table(spark), tmp_path)).collect(), ids)
    assert n <= -(-sum(len(x) for _, x in ids) // 1024) + 1
    assert op2_packing.op2_packing(spark, X.stored(X.empty(spark), tmp_path)).collect() == []


@pytest.mark.parametrize("counts", [{5: 3, 7: 2, 3: 1}, {10: 4}, {6: 10, 4: 9, 3: 5, 1: 2}, {9: 2, 8: 3, 2: 1, 1: 1}])
def test_bins_are_the_fullest_that_brute_force_finds(counts):
    import itertools

    left = dict(counts)
    for used, times in op2_packing.plan_bins(counts, 10):
        for _ in range(times):
            longest = max(k for k in left if left[k])
            items = [k for k in left for _ in range(left[k])]
            items.remove(longest)
            room = 10 - longest
            best = max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= room)
            assert sum(k * n for k, n in used.items()) == longest + best
            for k, n in used.items():
                left[k] -= n
    assert not any(left.values())


def test_token_counts_equal_the_unigram_library(spark, tmp_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    odd = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
    t = Tokenizer(models.Unigram([(sp.id_to_piece(i), -1e9 if odd(i) else sp.get_score(i)) for i in range(sp.get_piece_size())], unk_id=0, byte_fallback=True))
    want = Counter((i, len(t.encode("▁" + x.replace(" ", "▁"), add_special_tokens=False).ids) if x else 0) for i, x in X.id_texts())
    got = op9_counts.op9_counts(spark, X.stored(X.table(spark), tmp_path)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert op9_counts.op9_counts(spark, X.stored(X.empty(spark), tmp_path)).collect() == []


def test_viterbi_ties_and_unknowns_against_all_paths():
    import itertools

    pieces = [("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -3.0), ("ba", -3.5)]
    v = op9_counts.CountViterbi(pieces, byte_pieces=False)
    known = dict(pieces)
    for n in range(1, 7):
        for letters in itertools.product("abc", repeat=n):
            text = "▁" + "".join(letters)
            best = -1e18
            for mask in range(2 ** (len(text) - 1)):
                cuts = [0, *[i + 1 for i in range(len(text) - 1) if mask >> i & 1], len(text)]
                parts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                if all(p in known or (len(p) == 1) for p in parts):
                    best = max(best, sum(known.get(p, v.unknown) for p in parts))
            assert v.solve(text)[1] == best
    assert v.solve("▁cc")[0] == 2  # a run of unknown characters counts once
    assert v.solve("▁ab")[0] == 2  # ▁a + b ties with ▁ + ab: the path found first has the longer last piece
