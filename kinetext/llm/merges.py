"""Byte-pair merges of many short byte strings side by side in numpy, equal to the tokenizers library's one by one."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Bytes that a string may have; strings that are merged at a time.
LONGEST, CHUNK = 32, 4096
#: How byte-level vocabularies show bytes: printable ones as themselves, the others from U+0100 on.
SHOWN = {b: (chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else None) for b in range(256)}
SHOWN |= {b: chr(256 + k) for k, b in enumerate(b for b, c in list(SHOWN.items()) if c is None)}
_NONE, _END = np.int32(2**31 - 1), 0xFFFF


class Merges:
    """A vocabulary's merges as arrays. A pair of ids is found in one of two tables of ranks, by two multiplicative hashes without collisions."""

    def __init__(self, pairs: np.ndarray, made: np.ndarray, byte_ids: np.ndarray):
        """``pairs`` (n, 2) by rank, the ids that they make, and the ids of the 256 bytes; all ids under 65,535."""
        n = len(pairs)
        self.made = made.astype(np.uint16)
        keys = pairs[:, 0].astype(np.uint32) << np.uint32(16) | pairs[:, 1].astype(np.uint32)
        self.keys = np.append(keys, np.uint32(0xFFFFFFFF))
        self.factors = [np.uint32(2654435769), np.uint32(1)]
        rng = np.random.default_rng(1)
        for k in range(8_000):  # tables of twice the size after each 2000 tries
            self.shift = np.uint32(max(2, 32 - max(n * 8, 2).bit_length() - k // 2000))
            if k % 2000 == 0:
                _, first = np.unique(self._slot(keys, 0), return_index=True)
                rest = np.setdiff1d(np.arange(n), first)
            self.factors[1] = np.uint32(int(rng.integers(1, 1 << 32)) | 1)
            if len(np.unique(self._slot(keys[rest], 1))) == len(rest):
                break
        else:
            raise ValueError("no second hash parts all pairs")
        self.tables = [np.full(1 << (32 - int(self.shift)), n, np.uint16) for _ in range(2)]
        for k, own in enumerate((first, rest)):
            self.tables[k][self._slot(keys[own], k)] = own
        # bytes, and 256 behind a string's end
        self.bytes = np.append(byte_ids, _END).astype(np.uint16)
        self.first = np.full((257, 257), _NONE, np.int32)
        self.first[:256, :256] = self._rank(np.repeat(self.bytes[:256], 256), np.tile(self.bytes[:256], 256)).reshape(256, 256)

    def _slot(self, keys: np.ndarray, k: int) -> np.ndarray:
        return keys * self.factors[k] >> self.shift

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, times 32; _NONE for those that don't merge."""
        key = left.astype(np.uint32) << np.uint32(16) | right
        rank = self.tables[0][self._slot(key, 0)]
        other = np.flatnonzero(self.keys[rank] != key)
        out = rank.astype(np.int32) << 5
        key = key[other]
        rank = self.tables[1][self._slot(key, 1)]
        out[other] = np.where(self.keys[rank] == key, rank.astype(np.int32) << 5, _NONE)
        return out

    def ids(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges the strings of 1 to LONGEST bytes at ``starts``: an order of them, in this order how many ids each has, and all ids (uint16)."""
        order = np.argsort(sizes, kind="stable")
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)]
        for a in range(0, len(order), CHUNK):
            own = order[a : a + CHUNK]
            n, got = self._merge(raw, starts[own], sizes[own])
            counts.append(n)
            ids.append(got)
        return order, np.concatenate(counts), np.concatenate(ids)

    def _merge(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A column per string, a row per byte. In each step every string merges the leftmost of its pairs of the lowest rank; rows are
        linked, and two more stand for what lies behind the end and before the start."""
        n, top = len(starts), int(sizes.max())
        row = np.arange(top + 2)[:, None]
        text = raw[np.minimum(starts + row, len(raw) - 1)].astype(np.int16)
        text[row >= sizes] = 256
        ids = self.bytes[text].ravel()
        best = np.full((top + 2, n), _NONE, np.int32)  # rank and row of the pair that starts here
        best[:top] = self.first[text[:top], text[1 : top + 1]] | row[:top].astype(np.int32)
        flat = best.ravel()
        after = np.repeat(np.arange(1, top + 3, dtype=np.int32), n)
        before = np.repeat(np.arange(-1, top + 1, dtype=np.int32), n)
        before[:n] = top + 1
        while True:
            low = best.min(axis=0)
            col = np.flatnonzero(low != _NONE)
            if not len(col):
                break
            low = low[col]
            here, new = low & 31, self.made[low >> 5]
            at = here * n + col
            gone = after[at] * n + col
            behind, ahead = after[gone], before[at]
            ids[at], ids[gone], flat[gone] = new, _END, _NONE
            after[at] = behind
            behind = behind * n + col
            before[behind] = here
            front = ahead * n + col
            rank = self._rank(np.concatenate([new, ids[front]]), np.concatenate([ids[behind], new]))
            flat[at] = rank[: len(col)] | here
            flat[front] = rank[len(col) :] | ahead
        kept = ids.reshape(top + 2, n).T
        there = kept != _END
        return there.sum(axis=1), kept[there]


@lru_cache(maxsize=8)
def merges_of(path: str) -> Merges | None:
    """Of a byte-level vocabulary's file, if its merges are plain and its ids short; else None."""
    with open(path, encoding="utf-8") as f:
        m = json.load(f)["model"]
    if m["type"] != "BPE" or any(m.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    vocab = m["vocab"]
    shown = [SHOWN[b] for b in range(256)]
    if max(vocab.values()) >= _END or len(m["merges"]) >= _END or any(c not in vocab for c in shown):
        return None
    by_pair = {}
    for rank, pair in enumerate(m["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        by_pair[vocab[a], vocab[b]] = rank, vocab[a + b]  # of equal pairs the last counts
    ranked = sorted((rank, *pair, new) for pair, (rank, new) in by_pair.items())
    ranks = np.asarray(ranked, np.int64).reshape(-1, 4)
    return Merges(ranks[:, 1:3], ranks[:, 3], np.asarray([vocab[c] for c in shown]))
