"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by the score of the piece that they would make, and merges
the best pair (the leftmost among equals) until none is left. No merge crosses two characters that no piece of the
vocabulary holds side by side, so that texts are cut there and each distinct part is encoded once per worker. The words
whose parts an Arrow batch brings anew are compared with the sentencepiece library's ids.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import PLAIN
from .common import byte_slices, texts
from .words import WordCache, code_points, per_text, text_starts

SPACE = "▁"
LATIN = 0x250
NEVER = 1 << 40


class MergeEncoder:
    """ids(text) for one model file, without begin and end ids."""

    def __init__(self, file: str, cache_words: int = 500_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=file)
        sp = self.library
        n = sp.get_piece_size()
        reserved = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.pieces = {pieces[i]: (sp.get_score(i), i) for i in range(n) if not reserved[i]}
        order = {x: k for k, x in enumerate(sorted({x for x, _ in self.pieces.values()}, reverse=True))}
        self.rank = {p: order[x] for p, (x, _) in self.pieces.items()}
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        # which two characters stand side by side in a piece; characters beyond LATIN may with any
        self.joins = np.zeros((LATIN + 1, LATIN + 1), bool)
        self.joins[LATIN, :] = self.joins[:, LATIN] = True
        mark = lambda c: 32 if c == SPACE else min(ord(c), LATIN)
        for p in self.pieces:
            for a, b in zip(p, p[1:]):
                self.joins[mark(a), mark(b)] = True
        self.by_word = not self.joins[:, 32][np.arange(LATIN + 1) != 32][:-1].any() and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        # What the agenda does not cover goes to the library: pieces that must be split again, and rewriting normalizers.
        probe = ["a  b", " ａ①", "a\tb ", "Å"]
        self.plain_rules = not any(sp.is_unused(i) for i in range(n)) and all(sp.decode(sp.encode(p)) == p for p in probe)
        self.cache = WordCache(self._learn, "<u4", cache_words)
        self.mismatches = 0

    def merge(self, text: str) -> list[int]:
        """Ids of marked text by the agenda."""
        symbols = list(text)
        n = len(symbols)
        return self._as_ids(self._merge_few(symbols) if n <= 24 else self._merge_many(symbols, n))

    def _merge_few(self, symbols: list[str]) -> list[str]:
        """The agenda of a short word: the pairs' ranks in place, the first of the best is taken."""
        rank = self.rank.get
        agenda = [rank(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def _merge_many(self, symbols: list[str | None], n: int) -> list[str]:
        """The agenda as a heap, for long unbroken text."""
        pieces = self.pieces
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            if found := pieces.get(symbols[i] + symbols[i + 1]):
                agenda.append((-found[0], i, i + 1, symbols[i] + symbols[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, made = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right or symbols[left] + symbols[right] != made:
                continue
            symbols[left], symbols[right] = made, None
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                if found := pieces.get(pair := made + symbols[nxt]):
                    heapq.heappush(agenda, (-found[0], left, nxt, pair))
            if (prev := before[left]) >= 0 and (found := pieces.get(pair := symbols[prev] + made)):
                heapq.heappush(agenda, (-found[0], prev, left, pair))
        return [s for s in symbols if s is not None]

    def _as_ids(self, symbols: list[str]) -> list[int]:
        out = []
        for s in symbols:
            if found := self.pieces.get(s):
                out.append(found[1])
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode())
            else:
                out.append(self.unknown)
        return out

    def _learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Agenda ids of parts."""
        mine = [self.merge(w.replace(" ", SPACE)) for w in parts]
        return np.array(list(chain.from_iterable(mine)), "<u4"), np.fromiter(map(len, mine), np.int64, len(mine))

    def _wrong(self, joined: str, starts: np.ndarray, words: np.ndarray, flat: np.ndarray, lens: np.ndarray, n: int) -> list[int]:
        """Starts of the words with new parts for which the library has other ids; it has the last word."""
        of = np.searchsorted(words, starts, "right") - 1
        ask = np.unique(of[self.cache.fresh])
        done = np.concatenate([[0], np.cumsum(lens)])
        first = np.searchsorted(starts, words)
        a, b = words[ask], np.append(words[1:], n)[ask]
        ids = self.library.encode([joined[x + 1 : y].replace(SPACE, " ") for x, y in zip(a.tolist(), b.tolist())], num_threads=1)
        cut = done[np.append(first, len(starts))]
        return [x for x, k, found in zip(a.tolist(), ask.tolist(), ids) if found != flat[cut[k] : cut[k + 1]].tolist()]

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.plain_rules:
            return [np.array(ids, "<u4").tobytes() for ids in self.library.encode(batch, num_threads=1)]
        # every text begins with a space of its own; a word begins where a run of spaces does
        held = [i for i, t in enumerate(batch) if t]
        out = [b""] * len(batch)
        if held:
            spaced = [" " + batch[i] for i in held]
            joined, borders = "".join(spaced), text_starts(spaced)
            points = code_points(joined)
            points = np.where(points == ord(SPACE), 32, points)
            small = np.minimum(points, LATIN)
            begins = np.zeros(len(points), bool)
            begins[borders[:-1]] = True
            word = begins.copy()  # a word begins where a run of spaces does
            if self.by_word:
                begins[1:] |= ~self.joins[small[:-1], small[1:]]
                word[1:] |= (points[1:] == 32) & (points[:-1] != 32)
                begins |= word
            starts = np.flatnonzero(begins)
            flat, lens = self.cache.encode(joined, points, starts, np.append(starts[1:], len(points)))
            for i, x in zip(held, per_text(flat, lens, starts, borders)):
                out[i] = x.tobytes()
            if wrong := self._wrong(joined, starts, np.flatnonzero(word), flat, lens, len(points)):
                self.mismatches += len(wrong)
                again = [held[i] for i in np.unique(np.searchsorted(borders, wrong, "right") - 1).tolist()]
                for i, ids in zip(again, self.library.encode([batch[i] for i in again], num_threads=1)):
                    out[i] = np.array(ids, "<u4").tobytes()
        # texts beyond common Latin script are compared whole as well
        odd = [i for i, t in enumerate(batch) if PLAIN.search(t)]
        for i, ids in zip(odd, self.library.encode([batch[i] for i in odd], num_threads=1) if odd else []):
            if (ids := np.array(ids, "<u4").tobytes()) != out[i]:
                self.mismatches += 1
                out[i] = ids
        return out


def encode_pieces(df: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded text and mismatches of every whole text.

    mismatches counts, in a batch's first row, the words or texts whose ids the library corrected (none is known).
    A null text is the empty one and has begin and end ids only; rows stay as many as they are, in any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = MergeEncoder(model)
        head = np.array([enc.library.bos_id()] * begin, "<u4").tobytes()
        tail = np.array([enc.library.eos_id()] * end, "<u4").tobytes()
        for batch in batches:
            for part in byte_slices(batch, "text", 2 << 20):
                before = enc.mismatches
                ids = [head + x + tail for x in enc.encode(part.column("text").to_pylist())]
                decoded = enc.library.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1)
                wrong = [enc.mismatches - before] + [0] * (len(ids) - 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string()), pa.array(wrong, pa.int64())], ["doc_id", "ids", "decoded", "mismatches"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string, mismatches long")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    coded = encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.as_buffer() for x in batch.column("ids")]
            decoded = [x.as_buffer() for x in batch.column("decoded")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                 pa.array([hashlib.sha256(x).hexdigest() for x in decoded]), batch.column("mismatches")],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "mismatches"])

    return coded.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, mismatches long")
