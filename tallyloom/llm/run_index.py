"""A run-length index: run-compressed Burrows-Wheeler transform with the text
positions of run ends, and matching statistics streamed against it."""

from __future__ import annotations

import numpy as np

#: Ends every indexed string; UTF-8 has no such byte, so patterns never match it.
END = 255


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``text`` in order, by prefix doubling of
    those that are not told apart yet."""
    size = len(text)
    key = np.zeros(size, np.uint64)
    padded = np.append(text, np.zeros(8, np.uint8))
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + size]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    del key
    rank = np.empty(size, np.int64)
    first = np.flatnonzero(new)
    rank[order] = np.repeat(first, np.diff(np.append(first, size)))
    length = 8
    while len(first) < size:
        # places in the order whose suffix still shares its rank
        alone = new & np.append(new[1:], True)
        open_at = np.flatnonzero(~alone)
        at = order[open_at]
        behind = at + length
        next_rank = np.where(behind < size, rank[np.minimum(behind, size - 1)] + 1, 0)
        pair = rank[at] * np.int64(size + 1) + next_rank
        by = np.argsort(pair, kind="stable")
        order[open_at] = at[by]
        pair = pair[by]
        fresh = np.append(True, pair[1:] != pair[:-1])
        new[open_at] = fresh
        first = np.flatnonzero(new)
        group = open_at[fresh]
        rank[at[by]] = np.repeat(group, np.diff(np.append(np.flatnonzero(fresh), len(pair))))
        length *= 2
    return order


class RunIndex:
    """Runs of the transform of ``text`` (strings that each end in ``END``).

    Kept are, for each run, its character, first row, where that row maps to,
    and the text positions at both of its ends: memory follows the number of
    runs, beside the text itself.
    """

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        size = self.size = len(text)
        before = text[order - 1]
        self.heads = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.tails = np.append(self.heads[1:], size) - 1
        self.chars = before[self.heads]
        self.head_at, self.tail_at = order[self.heads], order[self.tails]
        self.start = int(order[0])
        del order
        by_char = np.argsort(self.chars, kind="stable")
        sizes = (self.tails - self.heads + 1)[by_char]
        self.target = np.empty(len(self.heads), np.int64)
        self.target[by_char] = np.cumsum(sizes) - sizes
        self.by_char = by_char
        self.places = self.chars[by_char].astype(np.int64) * (size + 1) + self.heads[by_char]
        self.text = text

    def _common(self, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
        """Common prefix lengths of the suffixes at ``a`` and ``b``, ``cap`` at most."""
        steps = np.arange(cap)
        last = self.size - 1
        one = self.text[np.minimum(a[:, None] + steps, last)]
        two = self.text[np.minimum(b[:, None] + steps, last)]
        differ = (one != two) | (one == END)
        return np.where(differ.any(1), differ.argmax(1), cap)

    def matching_statistics(self, data: np.ndarray, offsets: np.ndarray, cap: int) -> np.ndarray:
        """For each position of the patterns ``data[offsets[k]:offsets[k+1]]``
        the length of the longest match in the text, ``cap`` at most.

        All patterns are streamed backwards in step. A pattern's row moves by
        the mapping of its run; where the run has another character, the row
        goes to the nearer end, by common prefix, of the next run above or
        below with the wanted one, whose text position is stored.
        """
        found = np.zeros(len(data), np.uint8 if cap < 256 else np.int32)
        sizes = np.diff(offsets)
        by_size = np.argsort(-sizes, kind="stable")
        ends, sizes = offsets[1:][by_size], sizes[by_size]
        count = len(sizes)
        row = np.zeros(count, np.int64)
        run = np.zeros(count, np.int64)
        at = np.full(count, self.start, np.int64)
        length = np.zeros(count, np.int64)
        ascending = -sizes
        for step in range(int(sizes[0]) if count else 0):
            live = int(np.searchsorted(ascending, -step, side="left"))
            place = ends[:live] - 1 - step
            char = data[place]
            q, j, p, l = row[:live], run[:live], at[:live], length[:live]
            other = np.flatnonzero(self.chars[j] != char)
            if len(other):
                wanted = char[other].astype(np.int64)
                x = np.searchsorted(self.places, wanted * (self.size + 1) + q[other])
                top = self.by_char[np.maximum(x - 1, 0)]
                low = self.by_char[np.minimum(x, len(self.by_char) - 1)]
                has_top = (x > 0) & (self.chars[top] == wanted)
                has_low = (x < len(self.by_char)) & (self.chars[low] == wanted)
                held = l[other]
                up, down = np.where(has_top, 0, -1), np.where(has_low, 0, -1)
                for has, run_of, sample, into in ((has_top, top, self.tail_at, up), (has_low, low, self.head_at, down)):
                    some = np.flatnonzero(has & (held > 0))
                    into[some] = self._common(p[other[some]], sample[run_of[some]], cap)
                to_low = down > up
                j[other] = np.where(to_low, low, top)
                q[other] = np.where(to_low, self.heads[low], self.tails[top])
                p[other] = np.where(to_low, self.head_at[low], self.tail_at[top])
                best = np.maximum(up, down)
                l[other] = np.where(best < 0, -1, np.minimum(held, best))
                lost = other[best < 0]
            q[:] = self.target[j] + q - self.heads[j]
            p -= 1
            l[:] = np.minimum(l + 1, cap)
            if len(other) and len(lost):
                q[lost], p[lost] = 0, self.start
            j[:] = np.searchsorted(self.heads, q, side="right") - 1
            found[place] = l
        return found


def index_of(strings: list[bytes]) -> RunIndex:
    """The index over ``strings``; matches never cross from one to the next."""
    return RunIndex(np.frombuffer(bytes([END]).join([*strings, b""]), np.uint8))
