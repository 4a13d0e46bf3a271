"""Pre-tokens of byte-level BPE tokenizers (the published GPT-2 rule)."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property, lru_cache

import regex
from tokenizers import Tokenizer

# Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same rule in the standard library's terms, which it matches faster, for
# text up to U+024F: there its classes agree, but for numbers that are no
# digits and for controls that are space to one side only.
LATIN = re.compile(r"'(?:[stdm]|re|ve|ll)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
ASCII = re.compile(r"'(?:[stdm]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
_BEYOND = re.compile("[\x1c-\x1f²³¹¼½¾ɐ-\U0010ffff]")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in such vocabularies:
    itself where Latin-1 prints it, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class ByteLevel:
    """A byte-level BPE tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        self.path = path
        spec = read_spec(path)
        pre = spec["pre_tokenizer"]
        if (spec["model"]["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel"
                or pre["add_prefix_space"] or not pre["use_regex"]):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take in white space or need whole words")
        names = sorted(self.special, key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self._find = regex.compile(PATTERN).findall

    @cached_property
    def library(self) -> Tokenizer:
        t = Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        return t

    def _plain(self, text: str) -> list[str]:
        if not _BEYOND.search(text):
            return (ASCII if text.isascii() else LATIN).findall(text)
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            # unassigned characters: the library's Unicode version decides
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self._find(text)

    def split(self, text: str) -> tuple[list[str], list[tuple[int, int]]]:
        """The pre-tokens of a text, and (index, id) of each special token that
        stands before the pre-token with that index."""
        if not any(s in text for s in self.special):
            return self._plain(text), []
        pieces, marks, at = [], [], 0
        for m in self._special.finditer(text):
            pieces += self._plain(text[at:m.start()])
            marks.append((len(pieces), self.special[m.group()]))
            at = m.end()
        return pieces + self._plain(text[at:]), marks


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevel:
    """One per path and Python worker."""
    return ByteLevel(path)
