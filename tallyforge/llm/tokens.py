"""Encoding with the tokenizers library, a distinct word at a time.

The lower-casing BPE vocabularies here drop white space between words, so a text's ids are
the ids of its white-space-separated chunks, one after another. A chunk of common Latin
letters, digits and marks (SAFE) is split further by the vocabulary's own word pattern;
any other chunk goes to the library as it stands, which settles Unicode composition, casing
and special tokens. Nothing is encoded by rules of our own.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Characters for which the split below is the library's: no composition, plain casing.
_LETTER = "a-zªµºß-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
#: For Python and Java alike.
SAFE_CLASS = "\\x21-\\x7e¡-¬®-įĲ-ňŊ-ž‐-‧‰-⁞€"
SPACES = " \\t\\n\\r"
WORDS = f"[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBER}]|[^{SPACES}{_LETTER}{_NUMBER}]+"
SPECIAL = "<|"

_SAFE = re.compile(f"[{SAFE_CLASS}]*")
_SAFE_TEXT = re.compile(f"[{SAFE_CLASS}{SPACES}]*")
_WORDS = re.compile(WORDS)
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_GAP = re.compile(f"[{SPACES}]+")

_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in each process, without truncation or padding."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    return tokenizer(path).get_vocab_size(with_added_tokens=True)


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def chunks_of(text: str) -> list[str]:
    return text.split() if not _ODD_SPACE.search(text) else [c for c in _GAP.split(text) if c]


def words_of(text: str) -> list[str]:
    """The units that are encoded: in the same order, their ids are the text's."""
    if SPECIAL not in text and _SAFE_TEXT.fullmatch(text):
        return _WORDS.findall(text.lower())
    return chunks_of(text)


#: One unit each: the letters and numbers of SAFE_CLASS, in lower case.
_SINGLE = re.compile(f"[a-zªµºß-öø-įĲ-ňŊ-ž]+|[{_NUMBER}]")
_ends: dict[str, np.ndarray] = {}


def _word_ends(path: str) -> np.ndarray:
    """Which ids end a word."""
    if path not in _ends:
        vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        out[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        _ends[path] = out
    return _ends[path]


def encode_words(path: str, words: list[str], dtype: np.dtype) -> list[bytes]:
    """Each word's ids as bytes, from the library.

    Words of letters are one unit to the vocabulary's pattern and end in one id that says so,
    so many of them go to the library as one text, at half the cost of one call each.
    """
    t, ends = tokenizer(path), _word_ends(path)
    out: list[bytes | None] = [None] * len(words)
    plain = [k for k, w in enumerate(words) if (w.isalpha() and w.isascii()) or _SINGLE.fullmatch(w)]
    groups = [plain[at : at + 512] for at in range(0, len(plain), 512)]
    for at in range(0, len(groups), 8):
        some = groups[at : at + 8]
        for group, e in zip(some, t.encode_batch_fast([" ".join([words[k] for k in g]) for g in some], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype)
            to = (np.flatnonzero(ends[ids]) + 1) * dtype.itemsize
            if len(to) != len(group):
                raise RuntimeError("the vocabulary does not mark word ends")
            raw = ids.tobytes()
            for k, a, b in zip(group, [0, *to.tolist()], to.tolist(), strict=False):
                out[k] = raw[a:b]
    rest = [k for k, x in enumerate(out) if x is None]
    for at in range(0, len(rest), 4096):
        group = rest[at : at + 4096]
        for k, e in zip(group, t.encode_batch_fast([words[k] for k in group], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, dtype).tobytes()
    return out


class Encoder:
    """Encodes texts, keeping chunks and words seen before.

    Texts are taken STEP characters at a time, so that what is new in many goes to the library
    together. A full cache of chunks keeps those of the texts at hand; words are emptied when full.
    """

    STEP = 1 << 13

    def __init__(self, path: str, most_chunks: int = 350_000, most_words: int = 800_000):
        self.path, self.dtype = path, id_type(vocabulary_size(path))
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.most = most_chunks, most_words

    def _learn(self, missing: list[str]) -> None:
        one, split = {}, {}
        for c in missing:
            if c.isalpha() and c.isascii():
                one[c] = c.lower()
            elif SPECIAL not in c and _SAFE.fullmatch(c):
                split[c] = _WORDS.findall(c.lower())
            else:
                one[c] = c
        wanted = {*one.values()}
        wanted.update(*split.values())
        new = [*wanted.difference(self.words)]
        if len(self.words) + len(new) > self.most[1]:
            self.words.clear()
            new = [*wanted]
        words = self.words
        words.update(zip(new, encode_words(self.path, new, self.dtype), strict=True))
        self.chunks.update(zip(one, map(words.__getitem__, one.values()), strict=True))
        for c, ws in split.items():
            self.chunks[c] = b"".join(map(words.__getitem__, ws))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(chunks_of(text))
            size += len(text)
            if size >= self.STEP:
                out += self._encode(held)
                held, size = [], 0
        return out + self._encode(held)

    def _encode(self, texts: list[list[str]]) -> list[bytes]:
        every: set[str] = set()
        every.update(*texts)
        missing = [*every.difference(self.chunks)]
        if len(self.chunks) + len(missing) > self.most[0]:
            self.chunks = {c: self.chunks[c] for c in every.intersection(self.chunks)}
        if missing:
            self._learn(missing)
        find = self.chunks.__getitem__
        return [b"".join(map(find, parts)) for parts in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so that what a task has learnt serves the next."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
