"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a pre-token exactly one token can stand last in its BPE encoding. An automaton
over the bytes of all tokens gives the tokens that end at a position, the longest first; the first of
them that is compatible with the last token of the prefix before it is that unique token. Following
the last tokens back from the end gives the ids. Many pre-tokens are advanced together, one byte at a
time, so that every step is a handful of numpy operations; a long one with few companions is walked
alone, in plain Python with a memory of the pairs tested.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

#: Fixed values of the byte-level format: the contractions and classes of its split pattern.
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
SPLIT = rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+"
#: Below this code point the classes are spelt out for the standard library's faster engine.
LATIN_END = 0x250
NONE = np.iinfo(np.int32).max
#: A numpy step over a block costs about as much as walking this many bytes one by one.
STEP_BYTES = 40


def char_class(kinds: str) -> str:
    """The code points below LATIN_END whose general category starts with one of ``kinds``, for use in [...]."""
    return "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] in kinds)


LETTER, NUMBER = char_class("L"), char_class("N")
SPACE = r"\t-\r \x85\xa0"
_LATIN_SPLIT = re.compile(f"{CONTRACTIONS}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_ANY_SPLIT = regex.compile(SPLIT)
BEYOND_LATIN = re.compile(f"[^\x00-{chr(LATIN_END - 1)}]")


def pre_tokens(text: str) -> list[str]:
    return (_ANY_SPLIT if BEYOND_LATIN.search(text) else _LATIN_SPLIT).findall(text)


def byte_chars() -> dict[str, int]:
    """The format's printable stand-in for each byte: itself where printable, else 256 upwards in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ragged:
    """Growing rows of numbers, flat; gathers many rows at once."""

    def __init__(self, dtype) -> None:
        self.flat, self.used = np.empty(1 << 16, dtype), 0
        self.start, self.size, self.rows = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.empty(max(n, 2 * len(a)) - len(a), a.dtype)])

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, k = self.used + len(flat), self.rows + len(sizes)
        self.flat = self._room(self.flat, n)
        self.start, self.size = self._room(self.start, k), self._room(self.size, k)
        self.flat[self.used : n] = flat
        self.size[self.rows : k] = sizes
        self.start[self.rows : k] = self.used + np.cumsum(sizes) - sizes
        self.used, self.rows = n, k

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows one after the other, and their sizes."""
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.start[rows] - (ends - sizes), sizes)], sizes


class _Index(dict):
    """Numbers pieces as they come; ``new`` has those not yet encoded, ``chars`` counts all characters held."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.chars += len(piece)
        self.new.append(piece)
        return n


class PieceTable:
    """Encodes each distinct piece once; starts afresh when it holds more than ``limit`` pieces or ``chars`` characters."""

    def __init__(self, encode_pieces, known: dict[str, int] | None = None, limit: int = 400_000, chars: int = 16_000_000) -> None:
        self.encode_pieces, self.known, self.limit, self.chars = encode_pieces, known or {}, limit, chars
        self._clear()

    def _clear(self) -> None:
        self.index, self.ids = _Index(), Ragged(np.uint32)
        for piece, i in self.known.items():
            self.index[piece] = len(self.index)
            self.ids.add(np.array([i], np.uint32), np.array([1]))

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of each text."""
        if len(self.index) > self.limit or self.index.chars > self.chars:
            self._clear()
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        rows = np.fromiter(map(self.index.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        if self.index.new:
            self.ids.add(*self.encode_pieces(self.index.new))
            self.index.new = []
        ids, sizes = self.ids.gather(rows)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)


class ByteBpe:
    """The model of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, of = data["model"]["vocab"], byte_chars()
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * n
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(of[c] for c in token) if i not in self.special.values() else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        # rank of the merge that makes a token, and its two halves; single bytes have rank -1
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        keys, ranks = np.empty(len(data["model"]["merges"]), np.int64), np.arange(len(data["model"]["merges"]))
        for r, (a, b) in enumerate(data["model"]["merges"]):
            t, x, y = vocab[a + b], vocab[a], vocab[b]
            self.rank[t], self.left[t], self.right[t] = r, x, y
            keys[r] = x * n + y
        order = np.argsort(keys)
        self.n, self.pair_keys, self.pair_ranks = n, keys[order], ranks[order]
        self._automaton({i: self.bytes_of[i] for i in vocab.values() if i not in self.special.values()})
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        self._alone: tuple | None = None
        self._tested: dict[int, bool] = {}
        self.text = Ragged(np.uint8)
        self.text.add(np.frombuffer(b"".join(self.bytes_of), np.uint8), self.length)
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.table = PieceTable(self.encode_pieces, self.special)

    def _automaton(self, tokens: dict[int, bytes]) -> None:
        children: dict[int, int] = {}
        parent, byte, depth, token_at = [0], [0], [0], {}
        for i, b in tokens.items():
            node = 0
            for c in b:
                key = node << 8 | c
                if key not in children:
                    children[key] = len(parent)
                    parent.append(node), byte.append(c), depth.append(depth[node] + 1)
                node = children[key]
            token_at[node] = i
        parent, byte, depth = np.array(parent), np.array(byte), np.array(depth)
        ends = np.full(len(parent), -1, np.int32)
        ends[list(token_at)] = list(token_at.values())
        step, fail = np.zeros((len(parent), 256), np.int32), np.zeros(len(parent), np.int64)
        self.shorter = np.full(self.n, -1, np.int32)
        for d in range(int(depth.max(initial=0)) + 1):
            level = np.flatnonzero(depth == d)
            if d > 1:
                fail[level] = step[fail[parent[level]], byte[level]]
            if d:
                step[level] = step[fail[level]]
                whole = level[ends[level] >= 0]
                self.shorter[ends[whole]] = ends[fail[whole]]
                ends[level] = np.where(ends[level] >= 0, ends[level], ends[fail[level]])
            below = np.flatnonzero(depth == d + 1)
            step[parent[below], byte[below]] = below
        self.step, self.longest = step, ends

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each a | b apart.

        Merges are undone from the latest on. Parts that then meet at the border would have merged
        instead if their pair's rank comes before the merge just undone; at equal ranks the leftmost
        pair merges first, which is the border's if the merge undone lies right of it.
        """
        good, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), NONE, np.int64)
        while len(live):
            across = self.pair_rank(a, b) < limit
            good[live[across]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~across & (np.maximum(ra, rb) >= 0)
            a, b, ra, rb, live = a[go], b[go], ra[go], rb[go], live[go]
            on_left = ra > rb
            limit = np.where(on_left, ra, rb + 1)
            a, b = np.where(on_left, self.right[a], a), np.where(on_left, b, self.left[b])
        return good

    def _pair_test(self):
        """``compatible`` for one pair of tokens, in plain Python."""
        ranks, n = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True)), self.n
        rank, left, right = self.rank.tolist(), self.left.tolist(), self.right.tolist()

        def apart(a: int, b: int) -> bool:
            limit = int(NONE)
            while ranks.get(a * n + b, limit) >= limit:
                ra, rb = rank[a], rank[b]
                if ra < 0 and rb < 0:
                    return True
                if ra > rb:
                    limit, a = ra, right[a]
                else:
                    limit, b = rb + 1, left[b]
            return False

        return apart

    def _walk(self, word: bytes) -> np.ndarray:
        """The ids of one word, by the same table of last tokens as in _encode_block."""
        if self._alone is None:
            self._alone = *(x.tolist() for x in (self.longest, self.shorter, self.length)), self._pair_test()
        (longest, shorter, length, apart), tested, n = self._alone, self._tested, self.n
        step, state, last = memoryview(self.step), 0, array("i", bytes(4 * len(word)))
        for p, c in enumerate(word):
            state = step[state, c]
            token = longest[state]
            while (before := p - length[token]) >= 0:
                pair = last[before] * n + token
                good = tested.get(pair)
                if good is None:
                    if len(tested) >= 1_000_000:
                        tested.clear()
                    good = tested[pair] = apart(last[before], token)
                if good:
                    break
                token = shorter[token]
            last[p] = token
        out, at = array("I"), len(word) - 1
        while at >= 0:
            out.append(last[at])
            at -= length[last[at]]
        return np.array(out, np.uint32)[::-1]

    def _encode_block(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of similar length, longest first. Their ids (right-aligned in a matrix) and counts."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes[0])
        text = np.zeros((len(words), width), np.uint8)
        text[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        last = np.zeros((len(words), width), np.int64)
        state = np.zeros(len(words), np.int64)
        for p in range(width):
            n = int(np.searchsorted(-sizes, -p, "left"))  # words longer than p
            state = self.step[state[:n], text[:n, p]].astype(np.int64)
            rows, token = np.arange(n), self.longest[state].astype(np.int64)
            while len(rows):
                before = p - self.length[token]
                good = before < 0
                test = np.flatnonzero(~good)
                good[test] = self.compatible(last[rows[test], before[test]], token[test])
                last[rows[good], p] = token[good]
                rows, token = rows[~good], self.shorter[token[~good]].astype(np.int64)
        out, count = np.empty((len(words), width), np.uint32), np.zeros(len(words), np.int64)
        at, rows = sizes - 1, np.arange(len(words))
        while len(rows):
            token = last[rows, at]
            count[rows] += 1
            out[rows, width - count[rows]] = token
            at = at - self.length[token]
            rows, at = rows[at >= 0], at[at >= 0]
        return out, count

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [x.encode() for x in pieces]
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        parts, sizes, i = [b""] * len(words), np.zeros(len(words), np.int64), 0
        while i < len(order):
            longest = max(1, len(words[order[i]]))
            stop = i + 1
            while stop < len(order) and 2 * len(words[order[stop]]) > longest and (stop - i) * longest < 2_000_000:
                stop += 1
            if sum(len(words[k]) for k in order[i:stop]) < STEP_BYTES * longest:
                for k in order[i:stop]:
                    found = self._walk(words[k])
                    parts[k], sizes[k] = found.tobytes(), len(found)
                i = stop
                continue
            out, count = self._encode_block([words[k] for k in order[i:stop]])
            for row, n, k in zip(out, count.tolist(), order[i:stop], strict=True):
                parts[k] = row[len(row) - n :].tobytes()
                sizes[k] = n
            i = stop
        return np.frombuffer(b"".join(parts), np.uint32), sizes

    def split(self, text: str) -> list[str]:
        """Pre-tokens; strings of special tokens are cut out first, each as a piece of its own."""
        if self._special is None or not self._special.search(text):
            return pre_tokens(text)
        return [p for x in self._special.split(text) for p in ([x] if x in self.special else pre_tokens(x))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of each text."""
        return self.table.encode([self.split(x) for x in texts])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are not UTF-8 become U+FFFD. An unknown id raises IndexError."""
        flat, sizes = self.text.gather(ids.astype(np.int64))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return [flat[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
