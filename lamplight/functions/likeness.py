"""Bounds of difflib's ratio for many pairs of texts at once: no pair that reaches a ratio is lost."""

from __future__ import annotations

import numpy as np

#: Letters are folded to so many; folding can only raise a bound.
BINS = 97
#: Longest pattern, in words of 64 bits, that is matched by lanes; longer ones stand alone. Pairs per step of the lanes.
LANES, CHUNK = 4, 8192


class Texts:
    """Texts as one array of folded letters, with their counts."""

    def __init__(self, texts: list[str]) -> None:
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.codes = (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4") % BINS).astype(np.uint8)
        rows = np.repeat(np.arange(len(texts)), self.sizes)
        self.counts = np.bincount(rows * BINS + self.codes, minlength=len(texts) * BINS).reshape(-1, BINS).astype(np.int32)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters the texts a and b share, wherever they stand."""
        parts = [np.minimum(self.counts[a[i : i + CHUNK]], self.counts[b[i : i + CHUNK]]).sum(1) for i in range(0, len(a), CHUNK)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the longest common subsequence of the texts a and b; difflib's matches are one."""
        first = self.sizes[a] <= self.sizes[b]
        short, long = np.where(first, a, b), np.where(first, b, a)
        words, out = (self.sizes[short] + 63) // 64, np.zeros(len(a), np.int64)
        for w in np.unique(words[words > 0]):
            at = np.flatnonzero(words == w)
            if w > LANES:
                out[at] = [self._alone(s, t) for s, t in zip(short[at], long[at], strict=True)]
                continue
            at = at[np.argsort(self.sizes[long[at]], kind="stable")]
            for i in range(0, len(at), CHUNK):
                part = at[i : i + CHUNK]
                out[part] = self._lanes(short[part], long[part], int(w))
        return out

    def _text(self, i: int) -> np.ndarray:
        return self.codes[self.starts[i] : self.starts[i] + self.sizes[i]]

    def _alone(self, short: int, long: int) -> int:
        masks: dict[int, int] = {}
        for letter in range(BINS):
            bits = np.packbits(self._text(short) == letter, bitorder="little")
            masks[letter] = int.from_bytes(bits.tobytes(), "little")
        full = (1 << int(self.sizes[short])) - 1
        v = full
        for letter in self._text(long).tolist():
            if m := masks[letter]:
                u = v & m
                v = ((v + u) | (v - u)) & full
        return int(self.sizes[short]) - v.bit_count()

    def _lanes(self, short: np.ndarray, long: np.ndarray, words: int) -> np.ndarray:
        """Bits of a pattern that are 0 at the end are matched; one column of letters of all long texts at a time."""
        held, lane = np.unique(short, return_inverse=True)
        sizes = self.sizes[held]
        row = np.repeat(np.arange(len(held)), sizes)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        table = np.zeros((words, len(held) * (BINS + 1)), np.uint64)
        letters = self.codes[self.starts[held][row] + pos]
        np.bitwise_or.at(table, (pos >> 6, row * (BINS + 1) + letters), np.left_shift(np.uint64(1), (pos & 63).astype(np.uint64)))
        most = int(self.sizes[long].max())
        column = np.arange(most)[:, None]
        inside = column < self.sizes[long]
        said = np.where(inside, self.codes[np.where(inside, self.starts[long] + column, 0)], BINS)
        base, v = lane * (BINS + 1), [np.full(len(long), ~np.uint64(0)) for _ in range(words)]
        for letters in said:
            at, carry = base + letters, None
            for k in range(words):
                u = v[k] & table[k][at]
                total = v[k] + u
                over = total < u
                if carry is not None:
                    total += carry
                    over |= total < carry
                v[k] = total | (v[k] - u)
                carry = over.astype(np.uint64)
        return 64 * words - sum(np.bitwise_count(x).astype(np.int64) for x in v)
