"""Byte-pair encoders loaded once per worker process; their file is a parameter."""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata

import regex

#: Characters whose classes and case have been the same in every Unicode version for long; other texts take the
#: tokenizer library's own normaliser and splitter, so that its tables decide.
PLAIN = re.compile("[\x00-ʯ‐-‧‰-⁞€]*")


def is_plain(text: str) -> bool:
    return text.isascii() or PLAIN.fullmatch(text) is not None


def resolve(name: str) -> str:
    """A path is taken as it is; a bare file name is looked up among the public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_table() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in keep}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class ByteBpe:
    """Byte-level BPE: ids as the tokenizers library gives them with add_special_tokens=False."""

    def __init__(self, name: str):
        import tiktoken
        from tokenizers import Tokenizer

        path = resolve(name)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.hf = Tokenizer.from_file(path)
        self.hf.no_truncation()
        self.hf.no_padding()
        back = {c: b for b, c in byte_table().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        ranks = {bytes(back[c] for c in k): v for k, v in vocab.items()}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        # ids that follow the merge order and the default splitter: the rank form of the same tokenizer
        ordered = all(vocab[m] == 256 + i for i, m in enumerate(merged)) and spec["normalizer"] is None
        ordered = ordered and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.fast = None
        if ordered:
            import public_tokenizers

            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and is_plain(text):
            if any(s in text for s in self.special):
                return self.fast.encode(text, allowed_special=set(self.special))
            return self.fast.encode_ordinary(text)
        return self.hf.encode(text, add_special_tokens=False).ids


class WordBpe:
    """Word-level BPE: the words of a text, and the ids of one word."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        path = resolve(name)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.hf = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        # the shape that the quick path below knows; any other goes through the library
        self.quick = len(splits) == 1 and kinds == ["NFC", "Replace", "Lowercase"]
        self.pattern = regex.compile(splits[0]) if splits else None
        self.to_char = byte_table()
        self.pieces = {i: p for p, i in self.hf.get_vocab(True).items()}

    def plain_words(self, text: str) -> list[str]:
        if not text:
            return []
        if self.quick and is_plain(text):
            return self.pattern.findall(unicodedata.normalize("NFC", text).lower())
        norm = self.hf.normalizer.normalize_str(text)
        return [norm[a:b] for _, (a, b) in self.hf.pre_tokenizer.pre_tokenize_str(norm)]

    def words(self, text: str) -> list[str]:
        """Words in order; a special token of the vocabulary is a word of its own (after \\0)."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain_words(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out.extend(["\0" + part] if part in self.special else self.plain_words(part))
        return out

    def word_ids(self, word: str) -> list[int]:
        if word[:1] == "\0" and word[1:] in self.special:
            return [self.special[word[1:]]]
        return [t.id for t in self.hf.model.tokenize("".join(map(self.to_char.__getitem__, word.encode())))]


@functools.lru_cache(maxsize=4)
def byte_bpe(name: str) -> ByteBpe:
    return ByteBpe(name)


@functools.lru_cache(maxsize=4)
def word_bpe(name: str) -> WordBpe:
    return WordBpe(name)
