"""Token counts of a unigram tokenizer, without its pieces: count-only Viterbi.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at
each character; dynamic programming carries the best score and the number of
pieces up to there, and nothing else.  Ties go to the path found first, as in the
tokenizer: candidates come by their start, so the longer last piece wins, and a
character that is no piece by itself may be unknown, at ten below the least score.
Unknown characters count as their bytes if the vocabulary has byte pieces, else
a run of them counts once.

No piece holds the word mark after another character, so the best path of a text
is made of the best paths of its words (with the marks before them); each task
solves a word once and remembers a bounded number of them.  Scores are whole
numbers in the default vocabulary, so sums are exact.  A vocabulary with pieces
across words is solved over whole texts instead.

A null or empty text has no tokens and scores 0; repeated rows are counted each
on their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from kreditflow.llm.bpe import resolve
from kreditflow.llm.common import documents, id_text

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a task remembers.
REMEMBER = 400_000


class CountViterbi:
    """Best score and number of pieces of strings over (piece, score) pairs."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.byte_pieces = byte_pieces
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        known = {p for p, _ in pieces}
        self.by_word = MARK in known and not any(MARK in p.lstrip(MARK) for p in known)

    def solve(self, text: str) -> tuple[int, float]:
        n = len(text)
        ends: list[list] = [[] for _ in range(n + 1)]
        for last, found in self.automaton.iter(text):
            ends[last + 1].append(found)
        score, count, lost = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            best, pieces, single = None, 0, False
            for length, s in sorted(ends[e], reverse=True):  # by start: the longest first
                single = single or length == 1
                s += score[e - length]
                if best is None or s > best:
                    best, pieces = s, count[e - length] + 1
            if not single:
                s = score[e - 1] + self.unknown
                if best is None or s > best:
                    best, lost[e] = s, True
                    more = len(text[e - 1].encode()) if self.byte_pieces else int(not lost[e - 1])
                    pieces = count[e - 1] + more
            score[e], count[e] = best, pieces
        return count[n], score[n]


@functools.lru_cache(maxsize=2)
def load(name: str) -> CountViterbi:
    """Ordinary pieces of a sentencepiece file with their scores, read as a unigram vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=resolve(name))
    size = sp.get_piece_size()
    plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return CountViterbi([(sp.id_to_piece(i), sp.get_score(i)) for i in plain], any(sp.is_byte(i) for i in range(size)))


class Words(dict):
    """Rest of a word after its mark -> (count, score)."""

    def __init__(self, viterbi: CountViterbi):
        super().__init__()
        self.viterbi = viterbi

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = out = self.viterbi.solve(MARK + word)
        return out


#: Marks with the word after them.
_RUN = re.compile(f"{MARK}+[^{MARK}]*")


def count_text(text: str, words: Words) -> tuple[int, float]:
    """(pieces, score) of a text: a mark in front and in place of each space."""
    if not text:
        return 0, 0.0
    if not words.viterbi.by_word:
        return words.viterbi.solve(MARK + text.replace(" ", MARK))
    if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
        found = [words[m[1:]] for m in _RUN.findall(MARK + text.replace(" ", MARK))]
    else:
        found = list(map(words.__getitem__, text.split(" ")))
    return sum(c for c, _ in found), sum(s for _, s in found)


def _count(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(load(vocabulary))
        for b in batches:
            got = [count_text(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c for c, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, score) of every whole text."""
    return id_text(docs, id_col, text_col).mapInArrow(_count(vocabulary), "doc_id long, n_tokens long, score double")


def op9_counts(spark, sf_dir: str) -> DataFrame:
    """Unigram token counts and best scores of all ``documents``."""
    return token_counts(documents(spark, sf_dir))
