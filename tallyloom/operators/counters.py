"""A bounded map of weighted counters: what one pass with fixed memory keeps of its heaviest keys."""

from __future__ import annotations

import heapq

from tallyloom.errors import NegativeWeightError, SketchOverflowError

LARGEST = (1 << 63) - 1


class Counters:
    """At most ``size`` keys, each with an estimate that is too large by ``error`` at most.

    A key that finds no room lowers all others by as much as the least of them has, or as itself has.  The estimates
    stay as they are and ``error`` rises instead.  A heap has one entry for each key, with an estimate that the key
    had once; an increment leaves it there, and only when such an entry comes to the top is it put back with
    what the key has by then.  So every entry that is moved was paid for by an increment, and an addition costs
    a step of the heap on average, however many keys are held.
    """

    def __init__(self, size: int) -> None:
        self.size, self.error, self.total = size, 0, 0
        self.estimates: dict[int, int] = {}
        self._heap: list[tuple[int, int]] = []

    def items(self) -> list[tuple[int, int]]:
        return list(self.estimates.items())

    def add(self, key: int, weight: int) -> None:
        if weight < 0:
            raise NegativeWeightError("a weight is negative")
        self._raise_total(weight)
        self._insert(key, weight)

    def absorb(self, entries: list[tuple[int, int]], total: int, error: int) -> None:
        """Merge another map: its residuals are added, and both errors."""
        self._raise_total(total)
        self._shift(error)
        for key, estimate in sorted(entries):
            self._insert(key, estimate - error)

    def _raise_total(self, weight: int) -> None:
        if self.total + weight > LARGEST:
            raise SketchOverflowError("the total weight is beyond 64 bits")
        self.total += weight

    def _shift(self, by: int) -> None:
        """A larger error for the same residuals."""
        if by:
            self.error += by
            self.estimates = {k: v + by for k, v in self.estimates.items()}
            self._heap = [(v + by, k) for v, k in self._heap]  # keeps its order

    def _least(self) -> int:
        """The least estimate; the top of the heap is its entry."""
        while True:
            then, key = self._heap[0]
            now = self.estimates[key]
            if then == now:
                return now
            heapq.heapreplace(self._heap, (now, key))

    def _insert(self, key: int, weight: int) -> None:
        if key in self.estimates:
            self.estimates[key] += weight
            return
        if weight and len(self.estimates) >= self.size:
            gone = min(self._least() - self.error, weight)
            self.error += gone
            weight -= gone
            while self._heap and self._least() <= self.error:
                del self.estimates[heapq.heappop(self._heap)[1]]
        if weight:
            self.estimates[key] = self.error + weight
            heapq.heappush(self._heap, (self.error + weight, key))
