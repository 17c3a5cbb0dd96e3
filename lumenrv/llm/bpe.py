"""Whole-text encoding with a file of the tokenizers library, each distinct word encoded once per worker."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .words import WordCache, code_points, per_text, spread, text_starts

#: Characters for which WORDS splits exactly as the byte-level pre-tokenizer does; any other text goes whole to the library.
PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ]")
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t\n\r \xa0"
WORDS = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
SPACED = re.compile(f" [{_L}]+")


CONTRACTION = re.compile("'(?:[stmd]|re|ve|ll)")
SPACE, LETTER, DIGIT, OTHER = range(4)
_CLASSES = np.array([SPACE if re.match(f"[{_S}]", chr(c)) else LETTER if re.match(f"[{_L}]", chr(c)) else DIGIT if re.match(f"[{_N}]", chr(c)) else OTHER for c in range(0x250)], np.uint8)


def word_starts(points: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Starts of the words that WORDS finds in texts without contractions, given the texts' borders.

    A run of letters, digits or other marks is a word, with one space before it; of a run of white space
    the last character stands alone unless it is such a space or ends the text.
    """
    n = len(points)
    kind = _CLASSES[points]
    begins = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    inner = borders[(borders > 0) & (borders < n)]
    begins[inner] = True
    blank = kind == SPACE
    first = np.zeros(n, bool)  # first character of a text
    first[borders[borders < n]] = True
    # the last white space before a word of the same text begins a word of its own
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~first[1:]
    joins = last & (points == 32)
    starts = begins | last
    starts[1:] &= ~(joins[:-1] & ~blank[1:])  # the run after such a space begins at the space
    return np.flatnonzero(starts)


class CachedBpe:
    """encode(texts) gives an id array for each text, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    A byte-level pre-tokenizer splits a text into words that are encoded apart, so a text's ids are its words' ids
    in order. Words are found and told apart by array operations; the library encodes each when it is first seen.
    Texts with contractions are split by WORDS. Texts with an added token's string, or with characters outside PLAIN,
    and all texts of other kinds of tokenizers, go to the library whole.
    """

    def __init__(self, file: str, cache_words: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        spec = json.load(open(file, encoding="utf-8"))
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.split = (
            model.get("type") == "BPE" and not model.get("dropout") and spec.get("normalizer") is None and spec.get("truncation") is None
            and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        )
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.cache = WordCache(self._learn, self.dtype, cache_words)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode new words; those of a space and letters some hundred to a call, as they split alike when joined.

        A token stands for as many bytes as its string has characters, which tells where the words end.
        """
        joint = np.fromiter((SPACED.fullmatch(w) is not None for w in words), bool, len(words))
        parts, sizes = [], np.zeros(len(words), np.int64)
        places = np.flatnonzero(joint)
        for start in range(0, len(places), 500):
            at = places[start : start + 500]
            part = [words[i] for i in at.tolist()]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids)
            ends = np.cumsum(self.bytes[ids])
            stop = np.searchsorted(ends, np.cumsum(np.fromiter((len(w.encode()) for w in part), np.int64, len(part)))) + 1
            sizes[at] = np.diff(stop, prepend=0)
            parts.append(ids)
        others = np.flatnonzero(~joint)
        for start in range(0, len(others), 2000):
            at = others[start : start + 2000]
            for i, e in zip(at.tolist(), self.tokenizer.encode_batch_fast([words[i] for i in at.tolist()], add_special_tokens=False)):
                parts.append(np.array(e.ids, np.int64))
                sizes[i] = len(e.ids)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        order = np.concatenate([places, others])  # as flat has the words
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return flat[spread(begin, sizes)].astype(self.dtype), sizes

    def _words(self, texts: list[str], split: list[np.ndarray] | None = None) -> list[np.ndarray]:
        joined, borders = "".join(texts), text_starts(texts)
        points = code_points(joined)
        starts = word_starts(points, borders) if split is None else np.concatenate([b + s for b, s in zip(borders.tolist(), split)])
        flat, lens = self.cache.encode(joined, points, starts, np.append(starts[1:], len(points)))
        return per_text(flat, lens, starts, borders)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.split:
            return self._whole(texts)
        out: list[np.ndarray] = [np.empty(0, self.dtype)] * len(texts)
        plain, marked, odd = [], [], []
        for i, t in enumerate(texts):
            if t:
                kind = odd if PLAIN.search(t) or any(a in t for a in self.added) else marked if CONTRACTION.search(t) else plain
                kind.append(i)
        for places, ids in (
            (plain, self._words([texts[i] for i in plain]) if plain else []),
            (marked, self._words(few := [texts[i] for i in marked], [np.array([m.start() for m in WORDS.finditer(t)]) for t in few]) if marked else []),
            (odd, self._whole([texts[i] for i in odd]) if odd else []),
        ):
            for i, x in zip(places, ids):
                out[i] = x
        return out


def vocabulary_size(file: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file).get_vocab_size(with_added_tokens=True)
