"""Language-model scoring with a probabilistic suffix tree.

Tokens are lower-cased words and one end per text.  The root is the smoothed
distribution of single tokens over the whole training part.  A context is a
candidate if it occurs MIN_COUNT times, and has the next tokens that follow it
MIN_COUNT times, so the model grows with the corpus.  A candidate stays in the
tree if its next-token distribution diverges from its suffix's: its count times
the Kullback-Leibler divergence must exceed half a log count for each of its next
tokens.  A level extends the contexts kept at the level before, and levels grow
until one keeps none, whatever their length.  Next tokens lose a discount, and the
rest of the distribution follows the suffix's, so every state sums to one.  A
token is scored in the longest context of the tree that ends before it.

Counts cover the whole training part and are gathered by Spark; nothing of the
tree reaches the driver or is broadcast whole.  Texts are split once and stored as
compressed blocks of token numbers, bucketed by block, so that only what a block is
told moves to it; each block deals its distinct tokens with their
counts by hash, and the sums go back to the blocks.  For each level a block deals its
distinct contexts with their next tokens by the context's hash; each part sums them,
tests its contexts and answers every block.  A context that may occur more than
SALT_AT times is dealt in several parts, whose sums Spark adds and tests.  What is
known to be rare is not dealt: a context occurs as often as its last token follows
the rest of it, a pair at most as often as its suffix's.  The first levels walk from
the texts; later ones go on from a stored walk of the tokens that are still in the
tree, which looks at the texts again every REACH levels.  Contexts are compared by
64-bit hashes.

A null or empty text is one end token; rows without an id are numbered as the
empty text; repeated rows are learned and scored each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kreditflow.llm.common import documents, id_text, iter_blocks, materialize
from kreditflow.session import scratch_path

MODULUS, HELD_OUT = 7, 2
#: Times that a context, and a next token in it, must occur; P_MIN is a further least share of the training tokens.
MIN_COUNT = 2
P_MIN = 0.0
DISCOUNT = 0.5
#: Text of one block, and the pairs that one task sums at most.
TEXT_BYTES, PART_PAIRS = 8 << 20, 1_000_000
#: Buckets of the stored texts; Spark allows no more.
MOST_BUCKETS = 100_000
#: A context that may occur more often than this is summed in that many parts more.
SALT_AT = 1 << 20
#: The first levels are walked from the texts each time; later ones are stored with the tokens that the next REACH of them look at.
FROM_TEXTS, REACH = 3, 16


class Limits(NamedTuple):
    """When contexts are salted, how many pairs a part takes, and which walks are stored (the first level never is); no result depends on it."""

    salt_at: int = SALT_AT
    part_pairs: int = PART_PAIRS
    from_texts: int = FROM_TEXTS
    reach: int = REACH


#: Text start and end, and any next token, are hashed from bytes that no word can be, as words hold no space.
START, END = (np.uint64(xxhash.xxh64_intdigest(b" " + x)) for x in (b"start", b"end"))
_G = np.uint64(0x9E3779B97F4A7C15)


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % MODULUS == HELD_OUT


class _Numbers(dict):
    """Token -> its number in the block, in order of appearance; the end is None."""

    def __missing__(self, token: bytes | None) -> int:
        self[token] = n = len(self)
        return n


def deeper(context: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hash of contexts that take one more token in front."""
    x = (context * _G) ^ (before + (context >> np.uint64(29)))
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _find(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x among the keys, -1 where it is none of them."""
    if not len(sorted_keys):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == x, at, -1)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the place of each x among them, and where one of each stands.

    Sorted are the high bits with the place in the low ones, which is faster than to sort places; different
    values with the same high bits, which are rare among hashes, are sorted in full.
    """
    low = np.uint64(int(len(x)).bit_length())
    x = x.astype(np.uint64, copy=False)
    free = np.uint64(64 - int(x.max()).bit_length() if len(x) else 0)
    order = x << free
    order >>= low
    order <<= low
    order |= np.arange(len(x), dtype=np.uint64)
    order.sort()
    order &= np.uint64((1 << int(low)) - 1)
    ordered, new = x[order], np.ones(len(x), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    keys = ordered[new]
    if (((keys[1:] ^ keys[:-1]) << free) >> low == 0).any():
        order = np.argsort(x)
        ordered = x[order]
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        keys = ordered[new]
    del ordered
    at = np.empty(len(x), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys, at, order[new].astype(np.int64)


# ---------------------------------------------------------------- blocks of numbered tokens
PACKED = "block long, kind string, level int, part int, data binary"
_COLUMNS = [c.split()[0] for c in PACKED.split(", ")]


def _zip(a: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes of small numbers and of sorted hashes' steps are alike."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unzip(blob: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _bundle(*arrays: np.ndarray) -> bytes:
    parts = [_zip(a) for a in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _unbundle(data: bytes, *kinds) -> list[np.ndarray]:
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(data, np.int64, len(kinds)).tolist(), kinds, strict=True):
        out.append(_unzip(data[at : at + size], kind))
        at += size
    return out


def _packed(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["block", "kind", "level", "part", "data"])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a block as numbers of its distinct tokens, and the hash of each of these."""
    at, numbers, docs, parts = None, _Numbers(), [], []

    def out() -> list[pa.RecordBatch]:
        words = np.fromiter((END if w is None else xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
        missing = np.array([d is None for d in docs])
        ids = np.array([0 if d is None else d for d in docs], np.int64)
        data = _bundle(words, ids, missing, np.array([len(p) for p in parts], np.int64), np.concatenate(parts))
        return _packed([(at, "texts", 0, 0, data)]).to_batches()

    for block, ids, texts in iter_blocks(batches, TEXT_BYTES):
        if at is not None and block != at:
            yield from out()
            numbers, docs, parts = _Numbers(), [], []
        at = block
        for i, t in zip(ids, texts, strict=True):
            own = t.encode().lower().split()
            own.append(None)
            docs.append(i)
            parts.append(np.fromiter(map(numbers.__getitem__, own), np.uint32, len(own)))
    if at is not None:
        yield from out()


class Block:
    """A stored block: document ids (None where missing), distinct tokens, and its texts as token numbers."""

    def __init__(self, data: bytes):
        self.words, ids, missing, self.sizes, self.toks = _unbundle(data, np.uint64, np.int64, np.bool_, np.int64, np.uint32)
        self.ids = [None if m else int(i) for i, m in zip(ids, missing, strict=True)]
        self.train = np.array([not is_held_out(i) for i in self.ids])
        self.starts = np.cumsum(self.sizes) - self.sizes


def _deal_words(parts: int):
    """A block's distinct tokens with their training counts, a run of the sorted hashes to each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(4), strict=True):
                block = Block(data.as_py())
                n = np.bincount(block.toks, np.repeat(block.train, block.sizes), len(block.words)).astype(np.int64)
                order = np.argsort(block.words)
                words, n = block.words[order], n[order]
                out = [(number, "words", 0, p, _bundle(np.diff(words[a:b], prepend=np.uint64(0)), n[a:b])) for p, a, b in _runs(words, parts)]
                yield from _packed(out).to_batches()

    return run


def _runs(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted keys."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return [(int(part[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _add_words(parts: int):
    """The training counts of a part's tokens over all blocks, and numbers that all blocks share; and how many there are."""

    def run(rows: pa.Table) -> pa.Table:
        got = [_unbundle(data.as_py(), np.uint64, np.int64) for data in rows.column("data")]
        keys, at, _ = _distinct(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in got]))
        c = np.bincount(at, np.concatenate([n for _, n in got]), len(keys)).astype(np.int64)
        part, out, a = rows.column("part")[0].as_py(), [], 0
        for k, _ in got:
            own = at[a : a + len(k)]
            out.append(_bundle(c[own], np.diff(own.astype(np.int64) * parts + part, prepend=0)))
            a += len(k)
        return pa.concat_tables([
            _added("known", block=rows.column("block").to_numpy(), level=[0] * len(out), part=[part] * len(out), data=out),
            _added("sum", total=[int(c.sum())], m=[int((c > 0).sum())]),
        ])

    return run


class Walk:
    """A block's tokens on the way down the tree.

    ``p`` is the probability of each token in the longest context so far.  A token goes on while its context of this
    length is in the tree and the next one may be: ``pos`` names it, ``x`` and ``t`` are how often it and anything follow
    its context (``x`` 0 under MIN_COUNT), and ``longer`` is None before the next contexts are looked at.
    """

    def __init__(self, rows: pa.Table, limits: Limits):
        self.limits = limits
        self.number = rows.column("block")[0].as_py()
        self.held: dict = {}
        for kind, level, part, data in sorted(zip(*(rows.column(c).to_pylist() for c in ("kind", "level", "part", "data")), strict=True), key=lambda r: r[:3]):
            self.held.setdefault((kind, level), []).append(data)

    def from_texts(self, n: int, v: int) -> Walk:
        block = Block(self.held["texts", 0][0])
        got = [_unbundle(data, np.int64, np.int64) for data in self.held["known", 0]]
        counts = np.concatenate([x for x, _ in got])
        if len(counts) != len(block.words):
            raise RuntimeError("a block's tokens and their counts differ")
        c, self.symbol = np.empty(len(counts), np.int64), np.empty(len(counts), np.int64)
        order = np.argsort(block.words)
        c[order], self.symbol[order] = counts, np.concatenate([np.cumsum(x) for _, x in got])
        toks, self.ids, self.train, self.sizes, self.c = block.toks, block.ids, block.train, block.sizes, c
        p = (c + 1) / (n + v + 1)
        self.base = np.add.reduceat(np.log10(p)[toks], block.starts)
        self.known = np.add.reduceat((c > 0)[toks].astype(np.int64), block.starts)
        self.full, self.level, self.words, self.toks = np.zeros(len(self.ids)), 0, block.words, toks
        self.inside = (np.arange(len(toks)) - np.repeat(block.starts, self.sizes)).astype(np.int32)
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        self.pos, self.p, self.x = np.arange(len(toks), dtype=np.int32), p[toks], np.where(c >= MIN_COUNT, c + 1, 0)[toks]
        # a context of one token occurs as often as the token, that of the start as often as the end
        followed = np.concatenate([[0], c[toks[:-1]]])
        followed[self.inside == 0] = c[block.words == END]
        self.rare = followed < MIN_COUNT
        self.window = None
        self._go_on(~self.rare)
        # nothing is known of the suffix, so the contexts' own counts bound them
        self.bound, self.t, self.context = followed[~self.rare], np.broadcast_to(np.int64(n + v + 1), len(self.pos)), None
        return self

    # ------------------------------------------------------------ the walk of few tokens, stored without its texts
    def from_state(self) -> Walk:
        got = _unbundle(self.held["state", 0][0], *(k for _, k in STATE))
        for (name, _), x in zip(STATE, got, strict=True):
            setattr(self, name, x)
        self.level, self.window = int(self.depth[0]), self.window.reshape(-1, self.limits.reach)
        self.ids = [None if m else int(i) for i, m in zip(self.ids, self.missing, strict=True)]
        self.first, self.rare = int(self.depth[1]), None
        return self

    def state(self) -> bytes:
        """Without the texts: each token still walking has itself and the REACH tokens before its context."""
        first = self.first if self.window is not None else self.level
        sym = self.sym
        if self.window is None:
            back = np.arange(1, self.limits.reach + 1, dtype=np.int32) + first
            used = np.where(self.inside[self.pos][:, None] >= back, self.toks[np.maximum(self.pos[:, None] - back, 0)].astype(np.int64), -1)
            inside, doc = self.inside[self.pos], self.doc[self.pos]
        else:
            used, inside, doc = self.window.astype(np.int64), self.inside, self.doc
        few, at = np.unique(np.concatenate([sym.astype(np.int64), used.ravel()]), return_inverse=True)
        few_words = np.where(few < 0, START, self.words[np.maximum(few, 0)])
        at = at.astype(np.int32) - int(len(few) and few[0] < 0)  # the start stays -1
        few_words, symbol = few_words[few >= 0], self.symbol[few[few >= 0]]
        cols = {
            "depth": np.array([self.level, first], np.int64), "ids": np.array([0 if i is None else i for i in self.ids], np.int64),
            "missing": np.array([i is None for i in self.ids]), "train": self.train, "sizes": self.sizes, "base": self.base, "known": self.known,
            "full": self.full, "words": few_words, "symbol": symbol, "own_sym": at[: len(sym)], "window": at[len(sym) :], "inside": inside, "doc": doc,
            "pos": self.pos, "p": self.p, "x": self.x, "t": self.t, "bound": self.bound, "context": self.context}
        return _bundle(*(np.ascontiguousarray(cols[name], kind) for name, kind in STATE))

    @property
    def sym(self) -> np.ndarray:
        return self.toks[self.pos] if self.window is None else self.own_sym

    def _go_on(self, stays: np.ndarray) -> None:
        """Tokens that end here are scored."""
        doc = self.doc[self.pos] if self.window is None else self.doc
        done = ~stays
        self.full = self.full + np.bincount(doc[done], np.log10(self.p[done]), len(self.full))
        for name in ("pos", "p", "x", *(("t", "context", "bound") if self.level else ()), *(() if self.window is None else ("own_sym", "window", "inside", "doc"))):
            setattr(self, name, getattr(self, name)[stays])

    # ------------------------------------------------------------ a level
    def extend(self) -> None:
        """Contexts of one token more, and the (context, next token) pairs that may occur often enough."""
        self.level += 1
        if self.window is None:
            before = self.words[self.toks[np.maximum(self.pos - self.level, 0)]]
            before[self.inside[self.pos] < self.level] = START
        else:
            at = self.window[:, self.level - self.first - 1]
            before = np.where(at >= 0, self.words[at] if len(self.words) else START, START)
        self.longer = before if self.level == 1 else deeper(self.context, before)
        contexts, self.at, some = _distinct(self.longer)
        # a pair is as rare as its suffix's at most
        self.listed = np.flatnonzero(self.x)
        order = np.argsort(self.symbol)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sym, entry = self.sym[self.listed], self.at[self.listed]
        self.keys, self.sub, self.entry_some = contexts, np.zeros(len(contexts), np.int32), some
        if (self.bound >= self.limits.salt_at).any():
            salts = self.bound // self.limits.salt_at + 1
            self.sub = (salts[some] > 1).astype(np.int32)
            sub = ((self.words[sym] >> np.uint64(8)) % salts[self.listed].astype(np.uint64)).astype(np.uint64)
            spread = np.flatnonzero(sub)
            own = contexts[entry]
            own[spread] += sub[spread] * _G
            more, _, k = _distinct(own[spread])
            spread = spread[k]
            keys = np.concatenate([contexts, more])
            new = np.argsort(keys)
            self.keys = keys[new]
            self.sub = np.concatenate([self.sub, 1 + sub[spread].astype(np.int32)])[new]
            self.entry_some = np.concatenate([some, self.listed[spread]])[new]
            entry = np.searchsorted(self.keys, own)
        self.place = np.searchsorted(self.keys, contexts)
        codes, self.pair_at, pair_some = _distinct(entry * np.int64(len(self.words)) + rank[sym])
        codes = codes.view(np.int64)
        self.pair_some, self.pairs = self.listed[pair_some], len(codes)
        self.entry_pairs = np.bincount(codes // max(1, len(self.words)), minlength=len(self.keys)).astype(np.int32)
        self.symbols = self.symbol[order][codes % max(1, len(self.words))].view(np.uint64)

    def deal(self, parts: int) -> list[tuple]:
        """Entries (a context, or a salted part of a frequent one) with their pairs and training counts, a run of keys to each part."""
        train = self.train[self.doc[self.pos] if self.window is None else self.doc].astype(np.float64)
        seen = np.zeros(len(self.keys), np.int64)
        seen[self.place] = np.bincount(self.at, train, len(self.place)).astype(np.int64)
        n = np.bincount(self.pair_at, train[self.listed], self.pairs).astype(np.int64)
        ends, out = np.concatenate([[0], np.cumsum(self.entry_pairs)]), []
        t, x = self.t[self.entry_some], self.x[self.pair_some]
        for part, a, b in _runs(self.keys, parts):
            i, j = ends[a], ends[b]
            step = lambda y: np.diff(y, prepend=np.uint64(0))
            data = _bundle(step(self.keys[a:b]), self.sub[a:b], self.entry_pairs[a:b], t[a:b], seen[a:b], step(self.symbols[i:j]), n[i:j], x[i:j])
            out.append((self.number, "pairs", self.level, part, data))
        return out

    def answers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of pairs in the corpus, 0 under MIN_COUNT; total (0: not in the tree) and rest of contexts."""
        got = [_unbundle(data, np.int64, np.int64, np.float64) for data in self.held.get(("sums", self.level), [])]
        n, total, share = (np.concatenate([x[i] for x in got]) if got else np.empty(0, k) for i, k in enumerate((np.int64, np.int64, np.float64)))
        if len(n) != self.pairs or len(total) != len(self.keys):
            raise RuntimeError("a block's pairs and their sums differ")
        rest = np.zeros(len(total))
        rest[total > 0] = share
        total[total < 0] = 0
        for data in self.held.get(("hot", self.level), []):
            context, hot_total, hot_rest = _unbundle(data, np.int64, np.int64, np.float64)
            at = np.searchsorted(self.keys, context.view(np.uint64))
            total[at], rest[at] = hot_total, hot_rest
        return n, total[self.place], rest[self.place]

    def advance(self) -> None:
        """Score in the contexts that the tree keeps, and go on with their tokens."""
        pair_n, total, rest = self.answers()
        n = np.zeros(len(self.pos), np.int64)
        n[self.listed] = pair_n[self.pair_at]
        # how often the next longer context occurs, as the token before follows its own: 0 is under MIN_COUNT, -1 unknown
        if self.window is None:
            grams = np.full(len(self.rare) + 1, -1)
            grams[1:][self.rare] = 0
            grams[1:][self.pos] = n
            grams = grams[:-1]
            grams[self.inside == 0] = -1
            self.rare |= grams == 0
            grams, inside = grams[self.pos], self.inside[self.pos]
        else:
            inside, at = self.inside, _find(self.pos, self.pos - 1)
            grams = np.where((at >= 0) & (inside > 0), n[at] if len(n) else -1, -1)
        t = total[self.at]
        kept = t > 0
        self.p = np.where(kept, np.where(n > 0, (n - DISCOUNT) / np.maximum(t, 1), rest[self.at] * self.p), self.p)
        # where unknown, a context occurs as often as its suffix at most
        self.x, self.t, self.context, self.bound = n, t, self.longer, np.where(grams < 0, t, grams)
        # a context that holds the start already has no longer one
        self._go_on(kept & (grams != 0) & (inside >= self.level))

    def scored(self, n: int) -> pa.Table:
        doc = self.doc[self.pos] if self.window is None else self.doc
        full = self.full + np.bincount(doc, np.log10(self.p), len(self.full))
        cols = [pa.array(self.ids, pa.int64()), pa.array(~self.train), pa.array(self.sizes), pa.array(self.known), pa.array(np.full(len(full), n, np.int64)), pa.array(self.base), pa.array(full)]
        return pa.table(cols, names=[c.split()[0] for c in SCORED.split(", ")])


#: What is stored of a walk without texts.
STATE = (("depth", np.int64), ("ids", np.int64), ("missing", np.bool_), ("train", np.bool_), ("sizes", np.int64), ("base", np.float64), ("known", np.int64), ("full", np.float64),
         ("words", np.uint64), ("symbol", np.int64), ("own_sym", np.int32), ("window", np.int32), ("inside", np.int32), ("doc", np.int32),
         ("pos", np.int32), ("p", np.float64), ("x", np.int64), ("t", np.int64), ("bound", np.int64), ("context", np.uint64))


def _walked(rows: pa.Table, n: int, v: int, depth: int, limits: Limits) -> Walk:
    walk = Walk(rows, limits)
    walk = walk.from_state() if ("state", 0) in walk.held else walk.from_texts(n, v)
    while walk.level < depth:
        walk.extend()
        walk.advance()
    return walk


# ---------------------------------------------------------------- one level of the tree
def _deal(n: int, v: int, level: int, parts: int, limits: Limits):
    """A block's entries to the parts; past the first levels also its walk without the texts."""

    def run(rows: pa.Table) -> pa.Table:
        walk = _walked(rows, n, v, level - 1, limits)
        out = [(walk.number, "state", 0, 0, walk.state())] if level > limits.from_texts else []
        walk.extend()
        return _packed(out + walk.deal(parts))

    return run


def _kept(total, m, a, b, above, least: float, log, most):
    """Does the context stay, and the share that the suffix's distribution gets.

    a: sum of the discounted counts, b: of these times their log over the suffix's probability, above: of the latter.
    """
    left, left_above = most(1 - a / total, 1e-12), most(1 - above, 1e-12)
    divergence = (b - log(total) * a) / total + left * log(left / left_above)
    return (total >= least) & (total * divergence > 0.5 * m * log(most(total, 2.0))), (1 - a / total) / left_above


ADDED = PACKED + ", context long, total long, m long, a double, b double, above double"
_ADDED = pa.schema([("block", pa.int64()), ("kind", pa.string()), ("level", pa.int32()), ("part", pa.int32()), ("data", pa.binary()), ("context", pa.int64()),
                    ("total", pa.int64()), ("m", pa.int64()), ("a", pa.float64()), ("b", pa.float64()), ("above", pa.float64())])


def _added(kind: str, **cols) -> pa.Table:
    size = len(next(iter(cols.values())))
    cols["kind"] = [kind] * size
    return pa.table([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(size, f.type) for f in _ADDED], schema=_ADDED)


def _add(level: int, least: float):
    """Sums of a part's entries over all blocks, the test of its contexts, and the answer to each block.

    A frequent context's salted entries give partial sums, and a row for each block that asks for their outcome.
    """

    def run(rows: pa.Table) -> pa.Table:
        kinds = (np.uint64, np.int32, np.int32, np.int64, np.int64, np.uint64, np.int64, np.int64)
        got = [_unbundle(data.as_py(), *kinds) for data in rows.column("data")]
        entries, pairs = [len(g[0]) for g in got], [len(g[5]) for g in got]
        whole = lambda i: np.concatenate([np.cumsum(g[i], dtype=np.uint64) if kinds[i] is np.uint64 else g[i] for g in got])
        keys, at, some = _distinct(whole(0))
        subs, t = whole(1), whole(3)[some]
        sub, total = subs[some], np.bincount(at, whole(4), len(keys)).astype(np.int64)
        of = np.repeat(at, whole(2))
        _, pair_at, some = _distinct(deeper(keys[of], whole(5)))
        n = np.bincount(pair_at, whole(6), len(some)).astype(np.int64)
        n[n < MIN_COUNT] = 0
        own = n > 0
        of, x, less = of[some][own], whole(7)[some][own], n[own] - DISCOUNT
        above = (x if level == 1 else x - DISCOUNT) / t[of]
        add = lambda y: np.bincount(of, y, len(keys))
        m, a, b, under = np.bincount(of, minlength=len(keys)), add(less), add(less * np.log(less / above)), add(above)
        kept, rest = _kept(np.maximum(total, 1), m, a, b, under, least, np.log, np.maximum)
        kept &= sub == 0
        answer, i, j, out = np.where(kept, total, np.where(sub > 0, -1, 0)), 0, 0, []
        blocks, part = rows.column("block").to_numpy(), rows.column("part")[0].as_py()
        for e, q in zip(entries, pairs, strict=True):
            own_at = at[i : i + e]
            out.append(_bundle(n[pair_at[j : j + q]], answer[own_at], rest[own_at][kept[own_at]]))
            i, j = i + e, j + q
        ask = subs == 1
        salted = np.flatnonzero(sub)
        context = (keys[salted] - (sub[salted] - 1).astype(np.uint64) * _G).view(np.int64)
        return pa.concat_tables([
            _added("sums", block=blocks, level=[level] * len(out), part=[part] * len(out), data=out),
            _added("kept", total=[int(kept.sum())]),
            _added("partial", context=context, total=total[salted], m=m[salted], a=a[salted], b=b[salted], above=under[salted]),
            _added("ask", block=np.repeat(blocks, entries)[ask], context=keys[at[ask]].view(np.int64)),
        ])

    return run


def _frequent(added: DataFrame, least: float) -> DataFrame:
    """(block, context, total, rest): outcome of the test of salted contexts, for the blocks that ask; exact sums, in whatever order."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,12)")).cast("double").alias(c)
    sums = added.filter("kind = 'partial'").groupBy("context").agg(F.sum("total").alias("total"), F.sum("m").alias("m"), exact("a"), exact("b"), exact("above"))
    kept, rest = _kept(*(F.col(c) for c in ("total", "m", "a", "b", "above")), least, F.log, lambda x, y: F.greatest(x, F.lit(y)))
    return added.filter("kind = 'ask'").select("block", "context").join(sums.filter(kept).select("context", "total", rest.alias("rest")), "context")


def _pack(kind: str, level: int, **kinds):
    def run(rows: pa.Table) -> pa.Table:
        data = _bundle(*(rows.column(c).to_numpy().astype(k) for c, k in kinds.items()))
        return _packed([(rows.column("block")[0].as_py(), kind, level, 0, data)])

    return run


class Level:
    """Contexts of one length: sorted hashes, suffix places, next tokens."""

    def __init__(self, contexts: pa.Table, pairs: pa.Table, symbols: np.ndarray, above: np.ndarray):
        hashes = lambda t, c: t.column(c).to_numpy().view(np.uint64)
        order = np.argsort(hashes(contexts, "context"))
        self.keys, self.rest = hashes(contexts, "context")[order], contexts.column("rest").to_numpy()[order]
        self.suffix = _find(above, hashes(contexts, "suffix")[order]) if len(above) else np.zeros(len(order), np.int64)
        self.kept = np.ones(len(order), bool)
        codes = _find(self.keys, hashes(pairs, "context")) * len(symbols) + _find(symbols, hashes(pairs, "symbol"))
        order = np.argsort(codes)
        self.codes, self.entry_p = codes[order], ((pairs.column("n").to_numpy() - DISCOUNT) / pairs.column("total").to_numpy())[order]


class Tree:
    """The model: what each block needs to know of each level, a walk to go on from, and the kept levels' number."""

    def __init__(self, blocks: DataFrame, known: DataFrame, n: int, v: int, limits: Limits):
        self.blocks, self.known, self.n, self.v, self.limits = blocks, known, n, v, limits
        self.answers: list[DataFrame] = []
        self.depth, self.state = 0, None

    def walked(self, level: int, state: DataFrame | None, run, schema: str) -> DataFrame:
        """``run`` over all that a block needs to walk to a level: from its texts, which stay where they are, or from a walk stored two levels before."""
        if state is not None:
            return _together([state, *self.answers[level - 1 : level]]).applyInArrow(run, schema)
        told = _together([self.known, *self.answers[:level]])
        return self.blocks.groupBy("block").cogroup(told).applyInArrow(lambda texts, rows: run(pa.concat_tables([texts, rows])), schema)

    def scores(self) -> DataFrame:
        return self.walked(self.depth, self.state, _score(self.n, self.v, self.depth, self.limits), SCORED)

    def contexts(self) -> DataFrame:
        """(level, context, suffix, symbol, n, total, rest): a row for each kept context, and for each next token of its own; level 0 is the root."""
        return self.walked(self.depth, None, _tell(self.n, self.v, self.depth, self.limits), TOLD).dropDuplicates(["level", "context", "symbol"])

    # The tree as arrays, to look at a small one; scoring doesn't use them.
    @cached_property
    def _root(self) -> tuple[np.ndarray, np.ndarray]:
        t = self.contexts().filter("level = 0 AND n > 0").toArrow()
        hashes, c = t.column("symbol").to_numpy().view(np.uint64), t.column("n").to_numpy()
        order = np.argsort(hashes)
        return hashes[order], (c[order] + 1) / (self.n + self.v + 1)

    symbols = property(lambda self: self._root[0])
    root = property(lambda self: self._root[1])

    @cached_property
    def levels(self) -> list[Level]:
        out: list[Level] = []
        for d in range(1, self.depth + 1):
            rows = self.contexts().filter(F.col("level") == d)
            contexts, pairs = rows.filter("symbol IS NULL").toArrow(), rows.filter("symbol IS NOT NULL").toArrow()
            out.append(Level(contexts, pairs, self.symbols, out[-1].keys if out else np.empty(0, np.uint64)))
        return out

    def prob(self, level: int, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """P(symbol | context) for places of contexts of a length (level 0: the root) and known symbols."""
        if level == 0:
            return self.root[symbol]
        at = self.levels[level - 1]
        found = _find(at.codes, context * len(self.symbols) + symbol)
        below = at.rest[context] * self.prob(level - 1, at.suffix[context], symbol)
        return np.where(found >= 0, at.entry_p[found] if len(at.entry_p) else 0.0, below)


def _together(tables: list[DataFrame]):
    """All packed rows of a block in one group."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("block")


#: Spark removes the shuffle files of a finished job itself if this is set; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A shared table, after which the shuffle files that led to it are of no use."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return materialize(df, name)
    finally:
        conf.set(CLEANUP, before)


def _bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """A shared table in buckets of blocks, so that no level shuffles it; its name leaves the catalog at once, its files stay."""
    spark, table = df.sparkSession, f"suffix_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").option("path", scratch_path(spark, f"llm-{name}")).saveAsTable(table, format="parquet")
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def learn(blocks: DataFrame, known: DataFrame, n: int, v: int, depth: int | None = None, limits: Limits = Limits()) -> Tree:
    """The tree; ``known`` gives each block the training counts of its tokens, n is the sum and v the number of all tokens'."""
    tree, least = Tree(blocks, known, n, v, limits), max(MIN_COUNT, P_MIN * n)
    parts = max(1, math.ceil(n * MODULUS / (MODULUS - 1) / limits.part_pairs))
    for d in count(1) if depth is None else range(1, depth + 1):
        again = d <= limits.from_texts or (d - limits.from_texts - 1) % limits.reach == 0
        walked = tree.walked(d - 1, None if again else tree.state, _deal(n, v, d, parts, limits), PACKED)
        if d > limits.from_texts:
            walked = _stored(walked, f"suffix-walk{d}")
            tree.state = walked.filter("kind = 'state'")
        added = _stored(walked.filter("kind = 'pairs'").groupBy("part").applyInArrow(_add(d, least), ADDED), f"suffix-sums{d}")
        found = added.agg(F.sum(F.when(F.col("kind") == "kept", F.col("total"))).alias("kept"), F.count(F.when(F.col("kind") == "partial", 1)).alias("partial")).collect()[0]  # two numbers
        answers, kept = added.filter("kind = 'sums'").select(*_COLUMNS), int(found["kept"] or 0)
        if found["partial"]:
            of = _frequent(added, least).groupBy("block").applyInArrow(_pack("hot", d, context=np.int64, total=np.int64, rest=np.float64), PACKED)
            hot = _stored(of, f"suffix-hot{d}")
            answers, kept = answers.unionByName(hot), kept + (not hot.isEmpty())
        if not kept:
            break
        tree.depth = d
        tree.answers.append(answers)
    return tree


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(n: int, v: int, depth: int, limits: Limits):
    return lambda rows: _walked(rows, n, v, depth, limits).scored(n)


TOLD = "level int, context long, suffix long, symbol long, n long, total long, rest double"


def _tell(n: int, v: int, depth: int, limits: Limits):
    def run(rows: pa.Table) -> pa.Table:
        walk, out, names = _walked(rows, n, v, 0, limits), [], [c.split()[0] for c in TOLD.split(", ")]
        size, far = len(walk.words), (pa.int64(), pa.float64())
        out.append(pa.table([pa.array(np.zeros(size, np.int32)), *[pa.array(np.zeros(size, np.int64))] * 2, pa.array(walk.words.view(np.int64)), pa.array(walk.c), *(pa.nulls(size, k) for k in far)], names=names))
        for d in range(1, depth + 1):
            walk.extend()
            pair_n, total, rest = walk.answers()
            symbol = walk.words[walk.sym]
            suffix = np.zeros(len(walk.pos), np.uint64) if walk.context is None else walk.context
            one = np.unique(walk.at, return_index=True)[1]
            for at, n_own in ((one[total[walk.at[one]] > 0], None), (walk.pair_some[(pair_n > 0) & (total[walk.at[walk.pair_some]] > 0)], pair_n[(pair_n > 0) & (total[walk.at[walk.pair_some]] > 0)])):
                signed = [pa.array(x[at].view(np.int64)) for x in (walk.longer, suffix, symbol)]
                cols = [pa.array(np.full(len(at), d, np.int32)), *signed[:2], pa.nulls(len(at), pa.int64()) if n_own is None else signed[2],
                        pa.nulls(len(at), pa.int64()) if n_own is None else pa.array(n_own), pa.array(total[walk.at[at]]), pa.array(rest[walk.at[at]])]
                out.append(pa.table(cols, names=names))
            walk.advance()
        return pa.concat_tables(out)

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int | None = None, limits: Limits = Limits()) -> DataFrame:
    """Learn from the documents that aren't held out, and score all; contexts of any length unless ``depth`` ends them."""
    texts = id_text(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).collect()[0][0] or 0  # one number
    blocks = _bucketed(texts.mapInArrow(_number, PACKED), "suffix-blocks", min(MOST_BUCKETS, max(1, size // TEXT_BYTES)))
    parts = max(1, blocks.count())
    added = _stored(blocks.mapInArrow(_deal_words(parts), PACKED).groupBy("part").applyInArrow(_add_words(parts), ADDED), "suffix-words")
    sums = added.filter("kind = 'sum'").agg(F.sum("total").alias("n"), F.sum("m").alias("v")).collect()[0]  # two numbers
    tree = learn(blocks, added.filter("kind = 'known'").select(*_COLUMNS), int(sums["n"] or 0), int(sums["v"] or 0), depth, limits)
    return tree.scores()


def op8_suffix_tree(spark, sf_dir: str) -> DataFrame:
    """log10 probabilities of all ``documents`` in the suffix tree, and in single tokens as the base."""
    return score_texts(documents(spark, sf_dir))
