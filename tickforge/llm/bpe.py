"""BPE encoding and decoding through an automaton that is compiled from the merge list.

The automaton reads tokens. It starts as one state with a loop for every base symbol and is changed by one gadget
for each merge u v -> c, in rank order: the state that u leads to is split, the copy that u now leads to loses its
arc for v, and c becomes an arc from wherever u was one, to where v led. What it accepts in the end are exactly the
token sequences that the merges produce, one for each string.

All arcs of a token lead to one state at any time, so a table of targets gives the next state, and a state has an arc
for every token by default: a copy shares all arcs of the state it was split from but the one it loses, and those that
would have been made from it later. Numbered by their left ends (a token before all that it is the left end of, and
these by rank), the tokens that one gadget takes from a state are the lost one and one range. So a state's row of the
table is a list of ranges that it has no arc for, and a transition is a search in that row and a look at the targets.

A word is encoded left to right: for each of its prefixes one state at most is live, since the string has one path. A
keyword search over the vocabulary names the arcs whose token ends at a place, the table tells which of them is there.
Decoding emits the labels of the arcs passed.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from ._shared import documents, map_texts
from ._words import Remembered, Spec, byte_symbols


#: Stands for the suffix in the keyword search; no stand-in symbol of a byte.
END = "\0"


class MergeAutomaton:
    """Deterministic automaton over tokens for a list of merges and the suffix that marks a word's last symbol.

    target: the state that a token's arcs lead to. Row s of the table, from row[s] to row[s + 1], holds the ranges of
    token numbers, first in low and last in high, that state s has no arc for. number: a token's number in these.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix, self.vocab = suffix, vocab
        self.label = {i: t for t, i in vocab.items()}
        self.compile(merges)
        self.search = ahocorasick.Automaton()  # of each token: arc, symbols, number and target
        for token, arc in vocab.items():
            spelled = self.spelled(token)
            self.search.add_word(spelled, (arc, len(spelled), self.number[arc], self.target[arc]))
        self.search.make_automaton()

    def compile(self, merges: list[tuple[str, str]]) -> None:
        parent, lost = [-1], [("", -1)]  # of each state: what it was split from, and the token it lost at which rank
        target = dict.fromkeys(self.vocab, 0)
        children: dict[str, list[tuple[int, str]]] = {}  # tokens by their left ends, with the rank that made them
        made: set[str] = set()
        for rank, (u, v) in enumerate(merges):
            c, beyond = u + v, target[v]
            parent.append(target[u])
            lost.append((v, rank))
            target[u] = len(parent) - 1
            if c not in made:  # a second pair that gives the same token adds no new arc
                made.add(c)
                target[c] = beyond
                children.setdefault(u, []).append((rank, c))
        number, last = self.numbered(children, made)

        @functools.cache
        def gap(state: int) -> list[tuple[int, int]]:
            """The numbers of the token that a state lost and of what would have been made of it from then on."""
            v, rank = lost[state]
            later = children.get(v, [])
            k = bisect_left(later, (rank, ""))
            return [(number[v], number[v])] + ([(number[later[k][1]], last[v])] if k < len(later) else [])

        live = sorted(set(target.values()))
        place = {state: k for k, state in enumerate(live)}
        self.row, self.low, self.high = array("i", [0]), array("i"), array("i")
        for state in live:
            ranges = []
            while state > 0:
                ranges += gap(state)
                state = parent[state]
            end = -2
            for a, b in sorted(ranges):
                if a > end + 1:
                    self.low.append(a)
                    self.high.append(b)
                else:
                    self.high[-1] = max(end, b)
                end = self.high[-1]
            self.row.append(len(self.low))
        size = max(self.vocab.values(), default=-1) + 1
        self.number, self.target = array("i", [0]) * size, array("i", [0]) * size
        for token, arc in self.vocab.items():
            self.number[arc], self.target[arc] = number[token], place[target[token]]
        self.start = len(live)  # nothing was read yet: every arc is there
        self.row.append(len(self.low))

    def numbered(self, children: dict[str, list[tuple[int, str]]], made: set[str]) -> tuple[dict[str, int], dict[str, int]]:
        """The number of each token, and the last number of those that it is the left end of."""
        number: dict[str, int] = {}
        last: dict[str, int] = {}
        for root in self.vocab:
            if root in made:
                continue
            stack = [(root, False)]
            while stack:
                token, done = stack.pop()
                if done:
                    last[token] = len(number) - 1
                    continue
                number[token] = len(number)
                stack.append((token, True))
                stack += [(c, False) for _, c in reversed(children.get(token, []))]
        return number, last

    def spelled(self, token: str) -> str:
        """A token as the keyword search reads it: END in the place of the suffix."""
        end = self.suffix
        return token[: -len(end)] + END if end and token.endswith(end) and len(token) > len(end) else token

    def step(self, state: int, arc: int) -> int:
        """The state that arc leads to from state, -1 where state has no such arc."""
        at, first = self.number[arc], self.row[state]
        k = bisect_right(self.low, at, first, self.row[state + 1]) - 1
        return -1 if k >= first and self.high[k] >= at else self.target[arc]

    def path(self, word: str) -> list[int]:
        """The arcs that a word, given in stand-in symbols, passes from the start."""
        if not word:
            return []
        read = word + END if self.suffix else word
        n = len(read)
        state, into = [-1] * (n + 1), [(0, 0)] * (n + 1)  # the one live state after each prefix, and where from by which arc
        state[0] = self.start
        row, low, high = self.row, self.low, self.high
        for last, (arc, size, number, target) in self.search.iter(read):
            if state[last + 1] >= 0 or state[last + 1 - size] < 0:
                continue
            here = state[last + 1 - size]
            k = bisect_right(low, number, row[here], row[here + 1]) - 1
            if k < row[here] or high[k] < number:
                state[last + 1], into[last + 1] = target, (last + 1 - size, arc)
        out, at = [], n
        while at:
            if state[at] < 0:
                raise ValueError(f"a symbol of {word!r} is not in the vocabulary")
            at, arc = into[at]
            out.append(arc)
        return out[::-1]

    def encode(self, word: str) -> list[str]:
        """The tokens of a word given in stand-in symbols."""
        return [self.label[arc] for arc in self.path(word)]


Coded = tuple[str, str]  # ids in decimal and labels of arcs, each joined by a space


class Encoder(Remembered[Coded]):
    """Whole texts to token ids and back, for a tokenizer file with NFC, white space and case folding before BPE."""

    def __init__(self, path: str):
        spec = Spec(path)
        model = spec.model
        self.vocab: dict[str, int] = model["vocab"]
        self.automaton = MergeAutomaton(self.vocab, [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.labels = self.automaton.label | {i: t for t, i in spec.special.items()}
        self.shown, self.special = byte_symbols(), tuple(spec.special)
        super().__init__(spec, lambda pieces: [self.coded(self.piece(p)) for p in pieces], self.joined, lambda w: self.coded(self.word(w)), self.with_special)

    def piece(self, piece: str) -> list[int]:
        return self.automaton.path(piece if piece.isascii() and piece.isprintable() else "".join([self.shown[b] for b in piece.encode()]))

    def word(self, word: str) -> list[int]:
        """The ids of a word with special tokens in it, which part it."""
        ids, at, spec = [], 0, self.spec
        for m in spec.at_special.finditer(word):
            ids += [i for p in spec.pieces(word[at : m.start()]) for i in self.piece(p)] + [spec.special[m[0]]]
            at = m.end()
        return ids + [i for p in spec.pieces(word[at:]) for i in self.piece(p)]

    def with_special(self, word: str) -> bool:
        return "<" in word and any(s in word for s in self.special)

    def coded(self, ids: list[int]) -> Coded:
        return " ".join(map(str, ids)), self.decode(ids)

    @staticmethod
    def joined(parts: list[Coded]) -> Coded:
        return " ".join([p[0] for p in parts if p[0]]), " ".join([p[1] for p in parts if p[0]])

    def encode(self, text: str) -> list[int]:
        return list(map(int, " ".join([p[0] for p in next(self([text])) if p[0]]).split()))

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs passed, emitted in turn; a tokenizer without a decoder joins them by spaces."""
        return " ".join(map(self.labels.__getitem__, ids))


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One for each worker process and file, so that later tasks find the automaton compiled and words known."""
    return Encoder(path)


def encode_decode(docs: DataFrame, tokenizer: str, digest: bool = False, **columns: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by a space) and decoded of every text; null is as empty: no tokens, ''.

    With digest, ids_sha256 and decoded_sha256 stand in their place, computed where they arise. Rows are
    independent of each other; an empty table gives no rows.
    """
    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    told: Callable[[str], str] = (lambda s: hashlib.sha256(s.encode()).hexdigest()) if digest else str

    def make() -> Callable[[list[str]], dict[str, list]]:
        encoder = encoder_of(tokenizer)

        def work(texts: list[str]) -> dict[str, list]:
            out: dict[str, list] = {"n_tokens": [], names[0]: [], names[1]: []}
            for parts in encoder(texts):
                ids, decoded = encoder.joined(parts)
                out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                out[names[0]].append(told(ids))
                out[names[1]].append(told(decoded))
            return out

        return work

    return map_texts(docs, make, f"n_tokens long, {names[0]} string, {names[1]} string", **columns)


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digest=True)
