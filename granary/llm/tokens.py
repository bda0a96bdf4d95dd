"""Whole texts to token ids, by the tokenizers library, with the ids of repeated words kept.

A text is cut into chunks where its tokenizer always begins a new word; the ids of the chunks, joined, are the ids of the
text. Chunks repeat, so most of them are looked up. A text of another form than the cuts allow is encoded as it is.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Chunks whose ids a task keeps, at most, and the longest chunk kept (code points).
KEPT = 1_000_000
LONGEST = 40
#: Punctuation that, at the end of a word, is always a token of its own.
TAIL = ".,;:!?*#$%&|)\"-"

_ODD = re.compile(r"[^\S \n]")  # white space other than space and line feed
_CUT = re.compile(r"(?<=\S)(?= \S)")
_CONTROL = re.compile("[\x1c-\x1f]")  # white space to Python, not to the tokenizers


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file. A path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _before_space(text: str) -> list[str]:
    """Chunks that keep the white space before them. A single space or line feed between words always begins a new word for a byte-level
    tokenizer with the usual pattern; where other white space occurs, cuts are made only at single spaces between words."""
    if "\x01" not in text and not _ODD.search(text):
        chunks = text.replace(" ", "\x01 ").replace("\n", "\x01\n").split("\x01")
        if " " not in chunks and "\n" not in chunks and chunks[0]:
            return chunks
    return _CUT.split(text)


def _without_space(text: str) -> list[str]:
    """Words, for a tokenizer that drops white space."""
    return [text] if _CONTROL.search(text) else text.split()


class Encoder(dict):
    """encode(texts) gives an array of ids for each text; dtype is the smallest that holds the vocabulary. As a dict: the ids of chunks, as bytes."""

    def __init__(self, name: str, specials_as_text: bool = False):
        """specials_as_text: the strings of special tokens are ordinary text; else they are found as the library finds them."""
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.tokenizer.encode_special_tokens = specials_as_text
        # strings that the tokenizer looks for before anything else: texts that may hold one are not cut
        added = [] if specials_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(added))), re.IGNORECASE) if added else None
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._mapped = dict(enumerate(_byte_letters()))
        self.cut, self.word = self._kind(json.loads(self.tokenizer.to_str()))

    def _kind(self, spec: dict):
        pre, normalizer = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps = {x["type"] for x in (normalizer or {}).get("normalizers", [])}
        inner = pre.get("pretokenizers") or [{}]
        split = inner[0].get("type") == "Split" and inner[0].get("behavior") == "Removed" and inner[0].get("invert") and (inner[0].get("pattern") or {}).get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        if pre.get("type") == "ByteLevel" and normalizer is None and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return _before_space, self._cased
        if split and inner[-1].get("type") == "ByteLevel" and steps == {"NFC", "Replace", "Lowercase"}:
            return _without_space, self._lower
        return lambda text: [text], lambda chunk: None

    @staticmethod
    def _cased(chunk: str) -> str | None:
        """The word that the model sees, if the chunk is one of letters; else None."""
        return chunk if chunk[chunk[:1] == " " :].isalpha() else None

    @staticmethod
    def _lower(chunk: str) -> str | None:
        return chunk.lower() if chunk.isalpha() and max(chunk) < "\u0130" else None  # there, nothing decomposes and lower case is one letter

    def __missing__(self, chunk: str) -> bytes:
        stem = chunk.rstrip(TAIL)
        if stem != chunk and stem[-1:].isalpha():
            ids = self[stem] + self[chunk[len(stem) :]]
        elif self.word and (word := self.word(chunk)):
            found = self.model.tokenize(word.encode().decode("latin-1").translate(self._mapped))
            ids = np.array([t.id for t in found], self.dtype).tobytes()
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(chunk) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as the library gives them with add_special_tokens=False."""
        return [self.whole(t) if self.special and self.special.search(t) else np.frombuffer(b"".join(map(self.__getitem__, self.cut(t))), self.dtype) for t in texts]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)


@lru_cache(2)
def encoder(name: str) -> Encoder:
    """A worker's encoder. The tokenizer serves all tasks that the worker runs; the ids of chunks are for one task, which ends with forget()."""
    return Encoder(name)


def forget(name: str) -> None:
    """Drops the ids of chunks that a worker's encoder keeps: hundreds of thousands in a task, and other tasks on the executor need the memory."""
    encoder(name).clear()


def _byte_letters() -> list[str]:
    """The letter that byte-level models use for each byte: printable bytes stand for themselves, the others follow U+0100 in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]
