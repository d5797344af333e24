"""A SentencePiece BPE vocabulary as arrays: which pieces match, and which may stand next to each other.

The segmentation is the best path through the lattice of pieces under max-plus weights: minus the number of ids for a piece
that may follow the one before, minus infinity otherwise. "May follow" means that encoding the two pieces' text alone gives
just these two. A path on which every neighbouring pair is allowed is the model's own merge result, and there is only one: the
first merge across a piece border would also happen in the text of the two pieces alone, as no merge from outside precedes it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from itertools import count

import numpy as np
import sentencepiece

SPACE = "▁"
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words up to this many characters are encoded many at a time.
LONG_WORD = 64
BLOCK_WORDS = 1 << 15
_B = 0x9E3779B97F4A7C15 | 1
_M = 2**64 - 1
_NONE = -np.inf


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * _B + ord(c) + 1) & _M
    return h


class PieceModel:
    """Built from the bytes of a model file. Piece number ``unknown`` stands for any one character without a piece."""

    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        self.unknown = size
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for i in range(size):
            if sp.is_byte(i):
                self.byte_ids[int(names[i][3:5], 16)] = i
        self.number = {names[i]: i for i in range(size) if not special[i]}
        self.score = {names[i]: sp.get_score(i) for i in range(size) if not special[i]}
        loose = {c for piece in self.number for c in piece} - self.number.keys()
        inner = [p for p in self.number if re.search(f"[^{SPACE}]{SPACE}", p)]
        if loose or inner:
            raise ValueError("the model has characters that are no pieces of their own, or pieces across a word's beginning")
        self.longest = max(map(len, self.number))
        self.length = np.array([len(n) if n in self.number else 0 for n in names] + [1])
        raw = [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else (n.replace(SPACE, " ").encode() if n in self.number else b"") for i, n in enumerate(names)]
        self.piece_bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.piece_ends = np.cumsum([len(r) for r in raw])
        self.piece_sizes = np.array([len(r) for r in raw])
        self._runs(names)
        self._cache_key = np.full(1 << 20, 2**63 - 1, dtype=np.int64)
        self._cache_value = np.zeros(1 << 20, dtype=bool)
        self._pair: dict[tuple[int, int], bool] = {}

    def _runs(self, names: list[str]) -> None:
        """How each piece comes about when its text is encoded alone: scores of the merges, its outer symbols before each."""
        steps = self.longest
        self.run_score = np.full((self.unknown + 1, steps + 1), _NONE)
        self.run_left = np.full((self.unknown + 1, steps + 1), self.unknown, dtype=np.int64)
        self.run_right = self.run_left.copy()
        self.whole = np.zeros(self.unknown + 1, dtype=bool)
        self.whole[self.unknown] = True
        for name, i in self.number.items():
            parts, k = list(name), 0
            while True:
                self.run_left[i, k:], self.run_right[i, k:] = self.number[parts[0]], self.number[parts[-1]]
                merges = [(-self.score[a + b], at) for at, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
                if not merges:
                    break
                cost, at = min(merges)
                self.run_score[i, k] = -cost
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                k += 1
            self.whole[i] = len(parts) == 1
        ids = np.fromiter(self.number.values(), dtype=np.int64)
        hashes = np.array([text_hash(n) for n in self.number], dtype=np.uint64)
        order = np.argsort(hashes)
        self.known, self.known_id = hashes[order], ids[order]
        if (self.known[1:] == self.known[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[_mixed(self.known) >> np.uint64(44)] = True
        self.piece_hash = np.zeros(self.unknown + 1, dtype=np.uint64)
        self.piece_hash[ids] = hashes
        self.piece_score = np.full(self.unknown + 1, _NONE)
        self.piece_score[ids] = [self.score[n] for n in self.number]
        self.power = np.array([pow(_B, k, 2**64) for k in range(LONG_WORD + self.longest + 1)], dtype=np.uint64)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers of text hashes, -1 where there is none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        some = np.flatnonzero(self.maybe[_mixed(hashes) >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.known, hashes[some]), len(self.known) - 1)
        out[some] = np.where(self.known[at] == hashes[some], self.known_id[at], -1)
        return out

    def _allowed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pairs of pieces stay apart, by replaying the merges inside both and looking for one between them."""
        out = np.ones(len(left), dtype=bool)
        open_ = np.flatnonzero((left != self.unknown) & (right != self.unknown))
        i, j = np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=np.int64)
        while open_.size:
            a, b = left[open_], right[open_]
            x, y = self.run_right[a, i[open_]], self.run_left[b, j[open_]]
            joined = self.look_up(self.piece_hash[x] * self.power[self.length[y]] + self.piece_hash[y])
            between = np.where(joined >= 0, self.piece_score[joined], _NONE)
            in_left, in_right = self.run_score[a, i[open_]], self.run_score[b, j[open_]]
            merged = (joined >= 0) & (between > in_left) & (between >= in_right)
            out[open_[merged]] = False
            ended = (in_left == _NONE) & (in_right == _NONE)
            first = in_left >= in_right
            go = ~merged & ~ended
            i[open_[go & first]] += 1
            j[open_[go & ~first]] += 1
            open_ = open_[go]
        return out

    def allowed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (self.unknown + 1) + right
        slot = _mixed(key.astype(np.uint64)) >> np.uint64(44)
        out = self._cache_value[slot]
        miss = np.flatnonzero(self._cache_key[slot] != key)
        if miss.size:
            new, at = np.unique(key[miss], return_inverse=True)
            value = self._allowed(new // (self.unknown + 1), new % (self.unknown + 1))
            out[miss] = value[at]
            self._cache_key[slot[miss]], self._cache_value[slot[miss]] = key[miss], out[miss]
        return out

    def pair(self, left: int, right: int) -> bool:
        known = self._pair.get((left, right))
        if known is None:
            if len(self._pair) > 1_000_000:
                self._pair.clear()
            known = self._pair[left, right] = bool(self._allowed(np.array([left]), np.array([right]))[0])
        return known

    # Many short words at once.

    def _block(self, words: list[str], out: list[np.ndarray], where: np.ndarray) -> None:
        size = np.array([len(w) for w in words])
        width, n = int(size.max()), len(words)
        # 64-bit integers column by column: prefix hashes, last piece, ids so far.
        codes = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(n, width)
        hashes = np.zeros((width + 1, n), dtype=np.uint64)
        last = np.full((width + 1, n), -1, dtype=np.int64)
        for p in range(1, width + 1):
            c = codes[:, p - 1].astype(np.uint64)
            hashes[p] = hashes[p - 1] * np.uint64(_B) + c + np.uint64(1)
            here = np.flatnonzero(size >= p)
            for k in range(min(p, self.longest), 0, -1):
                piece = self.look_up(hashes[p, here] - hashes[p - k, here] * self.power[k])
                if k == 1:
                    piece[piece < 0] = self.unknown
                before = last[p - k, here]
                good = np.flatnonzero((piece >= 0) & ((before >= 0) | (p == k)))
                good = good[self.whole[piece[good]]]
                if p > k and good.size:
                    good = good[self.allowed(before[good], piece[good])]
                last[p, here[good]] = piece[good]
                here = np.delete(here, good) if good.size else here
                if not here.size:
                    break
        place, rows, parts = size.copy(), np.arange(n), []
        while rows.size:
            piece = last[place[rows], rows]
            parts.append((rows, piece, place[rows]))
            place[rows] -= self.length[piece]
            rows = rows[place[rows] > 0]
        row = np.concatenate([p[0] for p in parts])
        piece = np.concatenate([p[1] for p in parts])
        end = np.concatenate([p[2] for p in parts])
        order = np.lexsort((end, row))
        row, piece, end = row[order], piece[order], end[order]
        strange = piece == self.unknown
        if strange.any():
            row, piece = self._spelled(row, piece, [chr(c) for c in codes[row[strange], end[strange] - 1]])
        bounds = np.searchsorted(row, np.arange(n + 1))
        for k, w in enumerate(where.tolist()):
            out[w] = piece[bounds[k] : bounds[k + 1]]

    def _spelled(self, row: np.ndarray, piece: np.ndarray, characters: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their bytes."""
        raw = [c.encode("utf-8", "replace") for c in characters]
        times = np.ones(len(piece), dtype=np.int64)
        at = piece == self.unknown
        times[at] = [len(r) for r in raw]
        row, out, spread = np.repeat(row, times), np.repeat(piece, times), np.repeat(at, times)
        out[spread] = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return row, out

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(words)
        size = np.array([len(w) for w in words])
        for low, high in ((0, 6), (6, 10), (10, 16), (16, LONG_WORD)):
            some = np.flatnonzero((size > low) & (size <= high))
            for begin in range(0, len(some), BLOCK_WORDS):
                where = some[begin : begin + BLOCK_WORDS]
                self._block([words[w] for w in where], out, where)
        for w in np.flatnonzero(size > LONG_WORD).tolist():
            path = self.path(words[w], 0, -1, len(words[w]))
            out[w] = self.ids_of(words[w], path)
        return out

    # One stretch of text at a time.

    def ending(self, text: str, p: int, lowest: int) -> list[tuple[int, int]]:
        """(start, piece) of the pieces that end at ``p`` and start at ``lowest`` or later."""
        found = [(s, self.number[text[s:p]]) for s in range(max(lowest, p - self.longest), p) if text[s:p] in self.number]
        found = [(s, t) for s, t in found if self.whole[t]]
        return found if text[p - 1] in self.number else [*found, (p - 1, self.unknown)]

    def forward(self, text: str, begin: int, before: int, end: int) -> dict[int, int]:
        """The piece on which the allowed path from ``begin`` (behind piece ``before``, -1: none) stands at each place."""
        last = {begin: before}
        for p in range(begin + 1, end + 1):
            for s, t in self.ending(text, p, begin):
                if s in last and (last[s] < 0 or self.pair(last[s], t)):
                    last[p] = t
                    break
        return last

    def trace(self, last: dict[int, int], begin: int, end: int) -> list[tuple[int, int]]:
        """(end, piece) along the path that reaches ``end``."""
        out, p = [], end
        while p > begin:
            out.append((p, last[p]))
            p -= int(self.length[last[p]])
        return out[::-1]

    def path(self, text: str, begin: int, before: int, end: int) -> list[tuple[int, int]]:
        return self.trace(self.forward(text, begin, before, end), begin, end)

    def ids_of(self, text: str, path: list[tuple[int, int]]) -> np.ndarray:
        piece = np.array([t for _, t in path], dtype=np.int64)
        if (piece == self.unknown).any():
            _, piece = self._spelled(np.zeros(len(piece), dtype=np.int64), piece, [text[p - 1] for p, t in path if t == self.unknown])
        return piece

    # Whole texts.

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        return self.encode_lists(WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else [] for text in texts)

    def encode_lists(self, lists: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all word lists, and how many each has. Each distinct word is encoded once."""
        index: defaultdict[str, int] = defaultdict(count().__next__)
        uses = [np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words)) for words in lists]
        if not index:
            return np.zeros(0, dtype=np.int64), np.zeros(len(uses), dtype=np.int64)
        ids = self.encode_words(list(index))
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat, head = np.concatenate(ids), np.cumsum(sizes) - sizes
        use = np.concatenate(uses)
        n = sizes[use]
        upto = np.cumsum(n)
        place = np.arange(int(upto[-1])) - np.repeat(upto - n - head[use], n)
        total = np.concatenate([[0], upto])[np.cumsum([0, *map(len, uses)])]
        return flat[place], np.diff(total)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Texts of consecutive groups of ids: their pieces' bytes, the space put before the text taken off."""
        n = self.piece_sizes[ids]
        upto = np.cumsum(n)
        place = np.arange(int(upto[-1]) if len(upto) else 0) - np.repeat(upto - self.piece_ends[ids], n)
        data = self.piece_bytes[place].tobytes()
        ends = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(ends[:-1], ends[1:])]
