"""Token ids by installed tokenizer libraries, with work on repeated words done once."""

from __future__ import annotations

import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np

from .bpe import BEYOND_LATIN, CONTRACTIONS, LETTER, NUMBER, SPACE, SPLIT, PieceTable, byte_chars


def library_tokenizer(path: str):
    """The file as a Tokenizer of the tokenizers library, one thread, no truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


class ByteLevelIds:
    """Ids of a byte-level BPE file. Texts below U+0250 go through tiktoken with the same vocabulary
    and split pattern, which is several times as fast; others, whose character classes can depend on
    a library's Unicode version, through the tokenizers library, which is loaded for the first of them.
    So do texts that tiktoken's regular expressions refuse, which are those with a run of about a million blanks."""

    def __init__(self, path: str, data: dict) -> None:
        import tiktoken

        self.path = path
        special, of = {x["content"]: x["id"] for x in data["added_tokens"]}, byte_chars()
        ranks = {bytes(of[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.vocab_size = len(data["model"]["vocab"].keys() | special.keys())

    @cached_property
    def library(self):
        return library_tokenizer(self.path)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._one(x) for x in texts]

    def _one(self, text: str) -> np.ndarray:
        if not BEYOND_LATIN.search(text):
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)
            except ValueError:  # its expression engine ran out of stack
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


class WordEndIds:
    """Ids of a lower-casing BPE file whose words end with a marked token.

    Texts below U+0250 are lower-cased and cut into words here, and the tokenizers library encodes
    each new word once: many are sent as one text, and every token that ends a word ends a piece.
    Other texts, and texts with a special token, go to the library whole.
    """

    def __init__(self, path: str, data: dict) -> None:
        self.library = library_tokenizer(path)
        vocab, suffix = data["model"]["vocab"], data["model"]["end_of_word_suffix"]
        self.vocab_size = self.library.get_vocab_size()
        self.ends = np.zeros(self.vocab_size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.special = re.compile("|".join(re.escape(x["content"]) for x in data["added_tokens"]) or r"\Z\A.")
        self.words = re.compile(f"{CONTRACTIONS}|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
        self.table = PieceTable(self._pieces)

    def _one(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._one(" ".join(pieces))
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) == len(pieces) and (not len(ids) or ends[-1] == len(ids) - 1):
            return ids, np.diff(ends, prepend=-1)
        if len(pieces) > 1:  # some piece's end is not marked as expected: halve until it is alone
            a, b = self._pieces(pieces[: len(pieces) // 2]), self._pieces(pieces[len(pieces) // 2 :])
            return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        return ids, np.array([len(ids)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        lower = [x.lower() for x in texts]  # a few capitals have their small letter beyond U+0250
        whole = [bool(BEYOND_LATIN.search(y) or self.special.search(x)) for x, y in zip(texts, lower, strict=True)]
        ids, counts = self.table.encode([[] if w else self.words.findall(y) for y, w in zip(lower, whole, strict=True)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return [self._one(x) if w else ids[a:b] for x, w, a, b in zip(texts, whole, ends[:-1], ends[1:], strict=True)]


class AnyIds:
    """Ids of any other file, by the tokenizers library."""

    def __init__(self, path: str, data: dict) -> None:
        self.library = library_tokenizer(path)
        self.vocab_size = self.library.get_vocab_size()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]


def _byte_level(data: dict) -> bool:
    kind, model = data["pre_tokenizer"] or {}, data["model"]
    plain = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) and x["content"] for x in data["added_tokens"])
    vocab = model.get("vocab") or {}
    in_order = lambda: [vocab[a + b] for a, b in model["merges"]] == list(range(256, 256 + len(model["merges"])))
    return plain and kind.get("type") == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"] and data["normalizer"] is None and model["type"] == "BPE" and not model["ignore_merges"] and in_order()


def _word_end(data: dict) -> bool:
    steps = [x["type"] for x in (data["normalizer"] or {}).get("normalizers", [])]
    cut = [x["type"] for x in (data["pre_tokenizer"] or {}).get("pretokenizers", [])]
    return data["model"].get("end_of_word_suffix") == "</w>" and steps == ["NFC", "Replace", "Lowercase"] and cut == ["Split", "ByteLevel"]


@lru_cache(maxsize=2)
def library_ids(path: str):
    """The encoder for a tokenizer file: ``encode(texts)`` gives an array of ids for each text."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return (ByteLevelIds if _byte_level(data) else WordEndIds if _word_end(data) else AnyIds)(path, data)
