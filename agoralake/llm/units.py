"""A table of the ids of text units, looked up for a whole block of text at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .words import mix

_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class UnitTable:
    """Ids of units, held in numpy arrays: the bytes of a unit of up to 16 are its key, longer ones are in a dictionary."""

    def __init__(self, limit: int):
        self.limit = limit
        self.slots = 1 << (2 * limit).bit_length()
        self.clear()

    def clear(self) -> None:
        self.slot = np.full(self.slots, -1, np.int32)
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.size = np.zeros(0, np.int64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)
        self.ids = np.zeros(0, "<u4")
        self.long: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.size)

    def _place(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (mix(mix(low + size.view(np.uint64)) ^ high) & np.uint64(self.slots - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each unit, or -1; bytes and length are compared, not hashes."""
        out = np.full(len(low), -1, np.int64)
        todo, at = np.arange(len(low)), self._place(low, high, size)
        while len(todo):
            entry = self.slot[at]
            taken = entry >= 0
            todo, at, entry = todo[taken], at[taken], entry[taken]
            same = (self.low[entry] == low[todo]) & (self.high[entry] == high[todo]) & (self.size[entry] == size[todo])
            out[todo[same]] = entry[same]
            todo, at = todo[~same], (at[~same] + 1) & (self.slots - 1)
        return out

    def add(self, names: list[bytes], low: np.ndarray, high: np.ndarray, size: np.ndarray, coded: list[list[int]]) -> None:
        """New distinct units with their ids."""
        entry = np.arange(len(self), len(self) + len(names))
        count = np.array([len(c) for c in coded], np.int64)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.ids = np.concatenate([self.ids, np.array([i for c in coded for i in c], "<u4")])
        self.low, self.high, self.size = np.concatenate([self.low, low]), np.concatenate([self.high, high]), np.concatenate([self.size, size])
        self.count = np.concatenate([self.count, count])
        self.again = np.concatenate([self.again, np.zeros(len(names), bool)])
        for k in np.flatnonzero(size > 16).tolist():
            self.long[names[k]] = int(entry[k])
        self._insert(entry)

    def _insert(self, entry: np.ndarray) -> None:
        """Slots for the short ones of new entries."""
        entry = entry[self.size[entry] <= 16]
        at = self._place(self.low[entry], self.high[entry], self.size[entry])
        while len(entry):  # one of those that want a free slot gets it, the others go on
            free = np.flatnonzero(self.slot[at] < 0)
            self.slot[at[free]] = entry[free]
            left = self.slot[at] != entry
            entry, at = entry[left], (at[left] + 1) & (self.slots - 1)

    def keep(self, chosen: np.ndarray) -> None:
        """Forget all entries but the chosen ones."""
        number = np.full(len(self), -1, np.int64)
        number[chosen] = np.arange(len(chosen))
        self.ids = self.joined(chosen)
        self.low, self.high, self.size, self.count = self.low[chosen], self.high[chosen], self.size[chosen], self.count[chosen]
        self.first = np.cumsum(self.count) - self.count
        self.again = np.zeros(len(chosen), bool)
        self.long = {name: int(number[e]) for name, e in self.long.items() if number[e] >= 0}
        self.slot[:] = -1
        self._insert(np.arange(len(chosen)))

    def joined(self, entries: np.ndarray) -> np.ndarray:
        """The ids of entries in a row."""
        count = self.count[entries]
        ends = np.cumsum(count)
        return self.ids[np.repeat(self.first[entries] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]

    def entries(self, raw: np.ndarray, start: np.ndarray, learn: Callable[[list[bytes]], list[list[int]]]) -> np.ndarray:
        """The entry of each unit of raw, which begins at start and ends where the next one begins; learn gives the ids of new ones."""
        end = np.append(start[1:], len(raw))[: len(start)]
        size = end - start
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
        short = np.minimum(size, 16)
        low, high = eight[start] & _MASKS[np.minimum(short, 8)], eight[start + 8] & _MASKS[np.maximum(short - 8, 0)]
        if len(self) > self.limit:  # keep what more than one block needed
            again = np.flatnonzero(self.again)
            self.keep(again if len(again) < self.limit // 2 else again[:0])
        data, wide = raw.tobytes(), np.flatnonzero(size > 16)
        entry = np.full(len(start), -1, np.int64)
        entry[size <= 16] = self.find(*(x[size <= 16] for x in (low, high, size)))
        entry[wide] = [self.long.get(data[a:b], -1) for a, b in zip(start[wide].tolist(), end[wide].tolist())]
        self.again[entry[entry >= 0]] = True
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new: dict[bytes, int] = {}
            own = np.array([new.setdefault(data[a:b], len(new)) for a, b in zip(start[missing].tolist(), end[missing].tolist())])
            of = np.zeros(len(new), np.int64)
            of[own] = missing
            entry[missing] = len(self) + own
            self.add(list(new), low[of], high[of], size[of], learn(list(new)))
        return entry
