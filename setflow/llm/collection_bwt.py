"""The Burrows-Wheeler transform and common prefixes of many strings, built column by column on sequential tapes.

Every round inserts one symbol of every string, from the right: a suffix cT goes to where its symbol c and the place
of T in the present order put it (the LF step), and the common prefixes with its two new neighbours come from
the least common prefix between the places of their rests. The tables are tapes that are read and rewritten front to
back, piece by piece: in memory only one piece of each tape is held, and a few numbers for each string. Tapes longer
than a limit are files in a folder that is given.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

#: Numbers that are held of a tape at once, and bytes beyond which a tape goes to a file.
PIECE = 1 << 20
TAPE_BYTES = 4 << 20


class Tapes:
    """Where tapes are kept: in memory, or as files in a folder of any file system that Arrow knows."""

    def __init__(self, folder: str | None = None, most: int = TAPE_BYTES, piece: int = PIECE):
        self.most, self.piece, self.files, self.fs = most, piece, 0, None
        if folder is not None:
            from pyarrow import fs

            self.fs, root = fs.FileSystem.from_uri(folder)
            self.root = f"{root}/tapes-{uuid.uuid4().hex}"

    def tape(self) -> Tape:
        return Tape(self)

    def open(self) -> tuple[str, object]:
        if not self.files:
            self.fs.create_dir(self.root)
        self.files += 1
        path = f"{self.root}/{self.files}"
        return path, self.fs.open_output_stream(path)

    def close(self) -> None:
        if self.files:
            self.fs.delete_dir(self.root)
            self.files = 0


class Tape:
    """A sequence of numbers, written once from front to back and then read from front to back."""

    def __init__(self, tapes: Tapes):
        self.tapes, self.parts, self.held, self.n = tapes, [], 0, 0
        self.path: str | None = None
        self.stream = None

    def write(self, numbers: np.ndarray) -> None:
        numbers = np.ascontiguousarray(numbers, np.int32)
        self.n += len(numbers)
        self.parts.append(numbers)
        self.held += numbers.nbytes
        if self.tapes.fs is not None and (self.held > self.tapes.most or self.stream is not None):
            if self.stream is None:
                self.path, self.stream = self.tapes.open()
            for part in self.parts:
                self.stream.write(memoryview(part).cast("B"))
            self.parts, self.held = [], 0

    def done(self) -> Tape:
        if self.stream is not None:
            self.stream.close()
            self.stream = None
        elif len(self.parts) != 1:
            self.parts = [np.concatenate([np.empty(0, np.int32), *self.parts])]
        return self

    def read(self) -> Iterator[np.ndarray]:
        """Pieces; none of an empty tape."""
        if self.path is None:
            for a in range(0, self.n, self.tapes.piece):
                yield self.parts[0][a : a + self.tapes.piece]
            return
        with self.tapes.fs.open_input_stream(self.path) as f:
            left = self.n
            while left:
                k = min(left, self.tapes.piece)
                raw = f.read(4 * k)
                yield np.frombuffer(raw, np.int32)
                left -= k

    def drop(self) -> None:
        self.parts = []
        if self.path is not None:
            self.tapes.fs.delete_file(self.path)


def least_between(x: np.ndarray, low: np.ndarray, high: np.ndarray, block: int = 16) -> np.ndarray:
    """min(x[low:high]) of each pair low < high: ends one by one, and what is between by blocks."""

    def each(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = b - a
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        return np.minimum.reduceat(x[np.arange(n.sum()) + np.repeat(a - at, n)], at)

    out = np.empty(len(low), x.dtype)
    short = high - low <= 2 * block
    if short.any():
        out[short] = each(low[short], high[short])
    if not short.all():
        a, b = low[~short], high[~short]
        first, last = -(-a // block), b // block
        whole = np.minimum.reduceat(x[: len(x) // block * block], np.arange(0, len(x) // block * block, block))
        own = least_between(whole, first, last, block)
        for c, d in ((a, first * block), (last * block, b)):
            some = c < d
            if some.any():
                own[some] = np.minimum(own[some], each(c[some], d[some]))
        out[~short] = own
    return out


def collection_bwt(strings: list[np.ndarray], group: np.ndarray, tapes: Tapes | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of (bwt, string, length, lcp) of all suffixes in order.

    strings: of non-negative integers below 2**31; group: strings of different groups share no prefix, and groups
    stay together in their order. bwt holds the symbol before each suffix, -1 before a whole string; string and
    length name the suffix; lcp is the common prefix with the suffix before, 0 for the first. Empty suffixes come
    first in their group, in the order of the strings.
    """
    tapes = tapes or Tapes()
    m = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    flat = np.concatenate([np.empty(0, np.int64), *strings]).astype(np.int64)
    owner = np.repeat(np.arange(m), size)
    # symbols are numbered by group and value, the end of a group's strings before all its symbols
    pair = np.concatenate([group.astype(np.int64) << 32, (group[owner].astype(np.int64) << 32) + flat + 1])
    kinds, number = np.unique(pair, return_inverse=True)
    is_end = (kinds & 0xFFFFFFFF) == 0
    end, code = number[:m], number[m:]
    last = np.cumsum(size)  # string i is code[last[i] - size[i] : last[i]]
    # a suffix is the place of its first symbol in flat; an empty one m places for each string after that
    order = np.argsort(group, kind="stable")
    names = ("first", "rest", "suffix", "lcp")

    def written(name: str, numbers: np.ndarray) -> Tape:
        tape = tapes.tape()
        for a in range(0, len(numbers), tapes.piece):
            tape.write(numbers[a : a + tapes.piece])
        return tape.done()

    now = dict(zip(names, map(written, names, (end[order], np.arange(m), len(flat) + order, np.zeros(m, np.int64)))))
    place, own = np.arange(m), order  # of the suffixes of the last round, in order
    for done in range(int(size.max(initial=0))):
        stay = size[own] > done
        place, own = place[stay], own[stay]
        symbol = code[last[own] - 1 - done]
        by = np.lexsort((place, symbol))
        own, symbol, rest = own[by], symbol[by], place[by]
        key = (symbol << 32) | rest
        at = np.full(len(key), now["first"].n)  # LF: place among the old, in old numbers
        base = asked = 0
        for first, old in zip(now["first"].read(), now["rest"].read()):
            there = (first.astype(np.int64) << 32) | old
            upto = int(np.searchsorted(key, there[-1], side="right"))
            at[asked:upto] = base + np.searchsorted(there, key[asked:upto])
            base, asked = base + len(there), upto
        # merge; a changed neighbour has its common prefix from the rests of both
        new = {n: tapes.tape() for n in names}
        total, start = now["first"].n, 0
        before = (-1, -1, False)  # first and rest of the suffix before this piece, and whether it is new
        touched, same, low, high = [], [], [], []
        for first, old, suffix in zip(*(now[n].read() for n in names[:3])):
            a = int(np.searchsorted(at, start))
            b = len(at) if start + len(first) == total else int(np.searchsorted(at, start + len(first)))
            where = at[a:b] - start
            f = np.insert(first.astype(np.int64), where, symbol[a:b])
            r = np.insert(old.astype(np.int64), where, rest[a:b])
            fresh = np.insert(np.zeros(len(first), bool), where, True)
            left_f, left_r = np.concatenate([[before[0]], f[:-1]]), np.concatenate([[before[1]], r[:-1]])
            t = np.flatnonzero(fresh | np.concatenate([[before[2]], fresh[:-1]]))
            s = t[(f[t] == left_f[t]) & ~is_end[f[t]]]
            touched.append(t + start + a)
            same.append(s + start + a)
            low.append(left_r[s] + 1)
            high.append(r[s] + 1)
            before = (int(f[-1]), int(r[-1]), bool(fresh[-1]))
            new["first"].write(f)
            new["rest"].write(np.where(is_end[f], r, r + np.searchsorted(at, r, side="right")))
            new["suffix"].write(np.insert(suffix.astype(np.int64), where, last[own[a:b]] - 1 - done))
            start += len(first)
        touched, same, low, high = (np.concatenate([np.empty(0, np.int64), *x]) for x in (touched, same, low, high))
        least = np.full(len(same), np.iinfo(np.int32).max, np.int32)
        start = 0
        for lcp in now["lcp"].read():
            own_a, own_b = np.maximum(low - start, 0), np.minimum(high - start, len(lcp))
            some = np.flatnonzero(own_a < own_b)
            if len(some):
                least[some] = np.minimum(least[some], least_between(lcp, own_a[some], own_b[some]))
            start += len(lcp)
        start = 0
        for lcp in now["lcp"].read():
            a = int(np.searchsorted(at, start))
            b = len(at) if start + len(lcp) == total else int(np.searchsorted(at, start + len(lcp)))
            out = np.insert(lcp, at[a:b] - start, 0)
            x, y = np.searchsorted(touched, [start + a, start + a + len(out)])
            out[touched[x:y] - start - a] = 0
            x, y = np.searchsorted(same, [start + a, start + a + len(out)])
            out[same[x:y] - start - a] = 1 + least[x:y]
            new["lcp"].write(out)
            start += len(lcp)
        for tape in now.values():
            tape.drop()
        now = {n: tape.done() for n, tape in new.items()}
        place = at + np.arange(len(at))
    first_of = last - size
    for suffix, lcp in zip(now["suffix"].read(), now["lcp"].read()):
        empty = suffix >= len(flat)
        string = np.where(empty, suffix - len(flat), 0)
        string[~empty] = owner[suffix[~empty]]
        length = np.where(empty, 0, last[string] - suffix)
        bwt = np.full(len(suffix), -1, np.int64)
        held = np.flatnonzero(length < size[string])
        bwt[held] = flat[first_of[string[held]] + size[string[held]] - length[held] - 1]
        yield bwt, string, length, lcp.astype(np.int64)
    tapes.close()
