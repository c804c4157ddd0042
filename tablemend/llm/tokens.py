"""Token ids of whole texts with a byte-level vocabulary of the tokenizers library.

A byte-level tokenizer merges within pre-tokens only. Texts of Latin letters are cut into pre-tokens, and each distinct one
goes through the library's model once while a worker remembers it; a text's ids are its pre-tokens' ids in a row. Other
texts, whose letters may be of another Unicode version here and there, are cut at the gaps before a blank that precedes
other text, which no pre-token crosses, and the library encodes the distinct pieces. Texts for which that does not hold
(added tokens, control separators that the regular expression dialects class differently) and other kinds of tokenizer are
encoded by the library as they stand.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

from .worker import held

#: A blank with what follows, white space before the last blank of a gap, other white space.
PIECES = re.compile(r" ?\S+|\s+(?=\s\S)|\s+")
#: Fixed value: the pre-tokens of byte-level vocabularies, for the characters that are not ``FOREIGN``.
WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Control separators, numbers that are words here and digits there, and what is beyond Latin letters and common punctuation.
ODD = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027]")
CONTROL = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it is visible Latin, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Known(dict):
    """Values made on demand and kept in two generations: a full young one becomes the old one, a hit there moves up."""

    def __init__(self, make: Callable[[str], bytes], keep: int) -> None:
        super().__init__()
        self.make, self.keep = make, keep
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.keep:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Encode texts to little-endian unsigned 32-bit ids; about ``keep`` recent words and pieces are remembered, twice."""

    def __init__(self, path: str, keep: int = 250_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.pieces = Known(self.word, keep), Known(self.whole, keep // 4)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not spec.get("normalizer")
            and spec["model"].get("type", "BPE") == "BPE"
        )
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.letters = byte_letters()
        self.raw = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """The ids of one pre-token."""
        if word[0] == " " and word.isascii() and word[1:].isalpha():
            return b"".join([self.raw[t.id] for t in self.model.tokenize(self.letters[32] + word[1:])])
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        return b"".join([self.raw[t.id] for t in tokens])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        if not self.by_piece:
            return [self.whole(t or "") for t in texts]
        out, join = [], b"".join
        for text in texts:
            if not text:
                out.append(b"")
            elif any(s in text for s in self.special):
                out.append(self.whole(text))
            elif (odd := ODD.search(text)) is None:
                out.append(join(map(self.words.__getitem__, WORDS.findall(text))))
                self.words.turn()
            elif CONTROL.search(text, odd.start()):
                out.append(self.whole(text))
            else:
                out.append(join(map(self.pieces.__getitem__, PIECES.findall(text))))
                self.pieces.turn()
        return out


def encoder(path: str, keep: int = 250_000) -> Encoder:
    """The worker's encoder of a vocabulary file; it outlives the task."""
    return held("encoder", (path, keep), lambda: Encoder(path, keep))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
