"""Texts as words and pieces of words, for tokenizers that fold case and never join across white space.

A text's tokens are those of its words (between ASCII white space) in turn, and a word's those of its pieces (the
tokenizer's own splitting pattern, after NFC and case folding). Both are remembered, so a text costs little more
than looking its words up.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import Generic, TypeVar

import regex

T = TypeVar("T")
#: Words, and pieces, of each of the two generations that a worker remembers. Longer words are not remembered.
CACHE, LONG = 200_000, 48
#: White space to str.split() that is none of ASCII's six.
OTHER_SPACE = re.compile("[%s]" % "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])))
BATCH = 256


def words(text: str) -> list[str]:
    if OTHER_SPACE.search(text):
        for space in "\t\n\v\f\r":
            text = text.replace(space, " ")
        return [w for w in text.split(" ") if w]
    return text.split()


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Spec:
    """What of a tokenizer file matters here: model, special tokens, and the pattern of pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.model = spec["model"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.ascii = re.compile(pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\s\p{L}\p{N}", r" \t\n\r\f\va-z0-9"))

    def pieces(self, word: str) -> list[str]:
        """The pieces of a text without special tokens."""
        if word.isascii():
            word = word.lower()
            return [word] if word.isalpha() else self.ascii.findall(word)
        word = "".join([c.lower() for c in unicodedata.normalize("NFC", word)])  # one by one: no final sigma
        return [word] if word.isalpha() else self.pattern.findall(word)


class Memory(Generic[T]):
    """A bounded memory in two generations: what is asked for again moves to the young one, so frequent words stay when
    the young one is full and becomes the old."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def unknown(self, wanted: set[str]) -> set[str]:
        """Those of wanted that are in neither generation; the others are in the young one from here on."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, missing = self.young, wanted.difference(self.young)
        if old := self.old:
            again = [w for w in missing if w in old]
            young.update(zip(again, map(old.__getitem__, again), strict=True))
            missing.difference_update(again)
        return missing


class Remembered(Generic[T]):
    """Values of words, made by join from the values of their pieces, or by whole where a word needs care."""

    def __init__(self, spec: Spec, pieces: Callable[[list[str]], list[T]], join: Callable[[list[T]], T], whole: Callable[[str], T], careful: Callable[[str], bool], most: int = CACHE):
        self.spec, self.value, self.join, self.whole, self.careful = spec, pieces, join, whole, careful
        self.words: Memory[T] = Memory(most)
        self.spelled: Memory[T] = Memory(most)

    def __call__(self, texts: list[str]) -> Iterator[list[T]]:
        """For each text, the values of its words."""
        for k in range(0, len(texts), BATCH):
            split = [words(t) for t in texts[k : k + BATCH]]
            new = self.words.unknown(set().union(*split))
            self.learn(new)
            known = self.words.young
            for tokens in split:
                yield list(map(known.__getitem__, tokens))
            for w in new:
                if len(w) > LONG:
                    del known[w]

    def learn(self, new: set[str]) -> None:
        known, todo, careful, pieces = self.words.young, {}, self.careful, self.spec.pieces
        for w in new:
            if careful(w):
                known[w] = self.whole(w)
            else:
                todo[w] = pieces(w)
        fresh = list(self.spelled.unknown({p for ps in todo.values() for p in ps}))
        spelled = self.spelled.young
        spelled.update(zip(fresh, self.value(fresh), strict=True))
        join = self.join
        for w, ps in todo.items():
            known[w] = spelled[ps[0]] if len(ps) == 1 else join([spelled[p] for p in ps])
        for p in fresh:
            if len(p) > LONG:
                del spelled[p]
