"""Byte-level word BPE over many words at once.

The tokenizers library encodes a word at a time and spends most of it on bookkeeping. Here a chunk of texts is cut
into word parts on its bytes, each different part is looked up or encoded once, and the ids are gathered. New parts of
equal length form a matrix of symbols; one round applies each part's first-ranked merge, so a row loses one symbol a
round and the matrix stays rectangular. Only plain words - printable ASCII and the letters of Latin-1 - take this way;
any other is given to the library, and both agree on every plain word (tested).
"""

from __future__ import annotations

import json
import os

import numpy as np

from . import lexing as lx

#: Parts a worker remembers; beyond it the memory is emptied.
KEPT_PARTS = 500_000
#: Longer parts are given to the library.
LONG_PART = 64
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x80:0xC0] = _KIND[0xC3] = _LETTER  # the lead byte of U+00C0 to U+00FF, and what follows it
#: The pattern of parts that the fast way knows (a fixed value of this kind of tokenizer).
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NONE = np.uint64(0xFFFFFFFF)
_LOW, _S16, _S32 = np.uint64(0xFFFFFFFF), np.uint64(16), np.uint64(32)


class PairRanks:
    """(left, right) -> rank << 16 | merged, by two-way hashing: every pair lies in one of two places, and a place
    holds the pair and its value in one 64-bit number. Symbols and ranks must be below 2**16."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], bits: int = 17) -> None:
        self.shift = np.uint64(64 - bits)
        self.factors = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
        empty = 0xFFFFFFFFFFFFFFFF
        places = [[empty] * (1 << bits) for _ in range(2)]
        for (a, b), (rank, merged) in pairs.items():
            entry, side = (a << 48) | (b << 32) | (rank << 16) | merged, 0
            for _ in range(1000):
                at = ((entry >> 32) * int(self.factors[side]) & empty) >> int(self.shift)
                entry, places[side][at] = places[side][at], entry
                if entry == empty:
                    break
                side = 1 - side
            else:
                raise ValueError("the pair table is too small")
        self.places = [np.array(p, np.uint64) for p in places]

    def at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << _S16) | right
        first = self.places[0][(key * self.factors[0]) >> self.shift]
        second = self.places[1][(key * self.factors[1]) >> self.shift]
        return np.where(first >> _S32 == key, first & _LOW, np.where(second >> _S32 == key, second & _LOW, _NONE))


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else extra))
        extra += b not in shown
    return out


class Tables:
    """What a tokenizer file of the word-end kind says - lower case, white space dropped, one pattern of parts - in a few
    arrays. The driver reads the file once and broadcasts them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.text = f.read()
        spec = json.loads(self.text)
        model, end = spec["model"], spec["model"].get("end_of_word_suffix")
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = next((p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"), None)
        self.fast = bool(end) and model["type"] == "BPE" and kinds == ["NFC", "Replace", "Lowercase"] and split is not None and split["pattern"].get("Regex") == PATTERN and not model.get("ignore_merges") and max(model["vocab"].values()) < 1 << 16
        if self.fast:
            vocab, symbols = model["vocab"], _byte_symbols()
            self.inner = np.array([vocab[s] for s in symbols], np.uint64)
            self.last = np.array([vocab[s + end] for s in symbols], np.uint64)
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            self.pairs = PairRanks({(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)})


class WordBpe:
    """Ids of texts, with a memory of the parts met so far."""

    def __init__(self, tables: Tables) -> None:
        self.tables, self.fast = tables, tables.fast
        if self.fast:
            self.inner, self.last, self.pairs = tables.inner, tables.last, tables.pairs
        self._library = None
        self.forget()

    def library(self, texts: list[str], **options):
        """The tokenizers library's own encoding; it is loaded when a word first needs it."""
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.tables.text)
        return self._library.encode_batch(texts, **options)

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def parts(self, data: np.ndarray, offs: np.ndarray):
        """(bytes to encode, part starts, ends, whether the library must encode the part)."""
        kind = _KIND[data]
        starts, ends, _ = lx.words(data, offs, lx.NOT_SPACE)
        odd = kind == _OTHER
        if not self.fast:
            odd[:] = True
        nxt = np.append(data[1:], 0)
        odd |= (data == 0xC3) & ((nxt == 0x97) | (nxt == 0xB7))  # signs, not letters
        odd[1:] |= (kind[1:] == _LETTER) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] != 0xC3)
        quote = (data == 0x27) & (_KIND[nxt] == _LETTER)  # contractions have parts of their own
        odd |= quote | ((data == 0x3C) & (nxt == 0x7C))  # and so have special tokens
        total = np.concatenate([[0], np.cumsum(odd)])
        slow = total[ends] > total[starts]
        mark = np.zeros(len(data) + 1, np.int8)
        mark[starts[slow]] += 1
        mark[ends[slow]] -= 1
        inside = np.cumsum(mark[:-1]).astype(bool)
        low = lx.LOWER[data]
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        low[upper] += 0x20
        low[inside] = data[inside]
        kind[inside] = _OTHER
        edge = np.zeros(len(data) + 1, bool)
        edge[starts] = edge[ends] = True
        edge[1:-1] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        real = kind != _SPACE
        first = np.flatnonzero(edge[:-1] & real)
        last = np.flatnonzero(edge[1:] & real) + 1
        return low, first, last, inside[first] | (last - first > LONG_PART)

    def merge(self, low: np.ndarray, starts: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """[(rows, their ids as a matrix)] of the parts of `size` bytes from `starts` on."""
        out = []
        data = low[starts[:, None] + np.arange(size)]
        symbols = self.inner[data]
        symbols[:, -1] = self.last[data[:, -1]]
        who = np.arange(len(starts))
        ranks = self.pairs.at(symbols[:, :-1], symbols[:, 1:])
        while len(who):
            width = symbols.shape[1]
            rows = np.arange(len(who))
            if width > 1:
                best = ranks.argmin(axis=1)
                value = ranks[rows, best]
                more = value != _NONE
            else:
                more = np.zeros(len(who), bool)
            if not more.all():
                out.append((who[~more], symbols[~more]))
                if not more.any():
                    break
                symbols, ranks, best, value, who = symbols[more], ranks[more], best[more], value[more], who[more]
                rows = np.arange(len(who))
            # the merged symbol takes the place of the left one; only the two pairs beside it change
            symbols[rows, best] = value & np.uint64(0xFFFF)
            keep = np.ones(symbols.shape, bool)
            keep[rows, best + 1] = False
            symbols = symbols[keep].reshape(len(who), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[rows, best] = False
            ranks = ranks[keep].reshape(len(who), width - 2)
            left, right = np.flatnonzero(best > 0), np.flatnonzero(best < width - 2)
            ranks[left, best[left] - 1] = self.pairs.at(symbols[left, best[left] - 1], symbols[left, best[left]])
            ranks[right, best[right]] = self.pairs.at(symbols[right, best[right]], symbols[right, best[right] + 1])
        return out

    def _store(self, at: np.ndarray, size: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        n = ids.size
        while self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + n] = ids.ravel()
        at[rows] = self.used + ids.shape[1] * np.arange(len(rows))
        size[rows] = ids.shape[1]
        self.used += n

    def learn(self, keys: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, slow: np.ndarray) -> None:
        at, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        length = ends - starts
        plain = np.flatnonzero(~slow)
        plain = plain[np.argsort(length[plain], kind="stable")]
        for rows in np.split(plain, np.flatnonzero(np.diff(length[plain])) + 1):
            for i in range(0, len(rows), 1 << 14):
                part = rows[i : i + (1 << 14)]
                for who, ids in self.merge(low, starts[part], int(length[part[0]])):
                    self._store(at, size, part[who], ids)
        rest = np.flatnonzero(slow)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            texts = [low[starts[k] : ends[k]].tobytes().decode("utf-8", "replace") for k in part]
            for k, e in zip(part, self.library(texts, add_special_tokens=False), strict=True):
                self._store(at, size, np.array([k]), np.array(e.ids, np.uint32).reshape(1, -1))
        order = np.argsort(np.concatenate([self.keys, keys]), kind="stable")
        self.keys = np.concatenate([self.keys, keys])[order]
        self.at = np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, size])[order]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of one chunk's documents, bounds by document)."""
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        low, starts, ends, slow = self.parts(data, offs)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        h = lx.word_hashes(low, starts, ends)
        h[slow] ^= np.uint64(0x5851F42D4C957F2D)
        different, first, place = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_PARTS:
            self.forget()
        k = np.searchsorted(self.keys, different)
        new = k == len(self.keys)
        new[~new] = self.keys[k[~new]] != different[~new]
        if new.any():
            own = first[new]
            self.learn(different[new], low, starts[own], ends[own], slow[own])
            k = np.searchsorted(self.keys, different)
        count, at = self.size[k][place], self.at[k][place]
        bounds = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.arange(bounds[-1]) + np.repeat(at - bounds[:-1], count)]
        return ids, bounds[np.searchsorted(starts, offs)]
