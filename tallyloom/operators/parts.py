"""The part of a sketch that one task or one key's state holds, updated by arrays of hashes.

What Spark aggregates as rows of registers is here one small array: table functions fill it from their rows, stateful
operators keep it between batches, and Arrow batches are cut down to it before a shuffle.  A part never grows
beyond its sketch, whatever is added, and parts of equal specification merge in any order (``HeavyPart``: with
the same guarantees, not the same bytes).
"""

from __future__ import annotations

import numpy as np

from tallyloom.errors import NegativeWeightError, SketchOverflowError
from tallyloom.functions import u64
from tallyloom.operators.counters import Counters
from tallyloom.profiles import BloomSpec, HeavySpec, HllSpec, MinHashSpec, Spec
from tallyloom.sources import wire

U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """``u64.mix64_int`` of every number."""
    for shift, factor in u64.FINALIZER:
        x = x ^ (x >> U(shift))
        x = x * U(factor) if factor else x
    return x


def family(hashes: np.ndarray, seed: int, i: int) -> np.ndarray:
    return mix64(hashes ^ U(u64.mix64_int(seed ^ i)))


def bit_lengths(x: np.ndarray) -> np.ndarray:
    high, low = (x >> U(32)).astype(float), (x & U(0xFFFFFFFF)).astype(float)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])


class HllPart:
    """Sparse registers are a dict while they are few; with ``keep_sparse`` an array of all holds more, else dense ones do."""

    def __init__(self, spec: HllSpec, keep_sparse: bool = False) -> None:
        self.spec, self.keep_sparse = spec, keep_sparse
        self.sparse: dict[int, int] = {}
        self.wide: np.ndarray | None = None
        self.dense: np.ndarray | None = None

    def _registers(self, idx: np.ndarray, rank: np.ndarray) -> None:
        """Ranks at the precision that the part has."""
        held = self.wide if self.dense is None else self.dense
        if held is not None:
            np.maximum.at(held, idx, rank.astype(np.uint8))
            return
        order = np.lexsort((rank, idx))
        idx, rank = idx[order], rank[order]
        last = np.r_[idx[1:] != idx[:-1], True][: len(idx)]
        for i, r in zip(idx[last].tolist(), rank[last].tolist(), strict=True):
            if r > self.sparse.get(i, 0):
                self.sparse[i] = r
        if len(self.sparse) > self.spec.promotion:
            if self.keep_sparse:
                own = np.array(list(self.sparse.items()), np.int64)
                self.wide, self.sparse = np.zeros(1 << self.spec.sp, np.uint8), {}
                self.wide[own[:, 0]] = own[:, 1]
            else:
                self.force_dense()

    def _sparse_rows(self) -> np.ndarray:
        """Indices and ranks of the sparse registers, in their order."""
        if self.wide is not None:
            at = np.flatnonzero(self.wide)
            return np.column_stack([at, self.wide[at].astype(np.int64)])
        return np.array(sorted(self.sparse.items()), np.int64).reshape(-1, 2)

    def _to_dense(self, idx: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = self.spec.sp - self.spec.p
        low = idx & ((1 << extra) - 1)
        return idx >> extra, np.where(low != 0, extra + 1 - bit_lengths(low.astype(U)), rank + extra)

    def force_dense(self) -> None:
        if self.dense is None:
            own = self._sparse_rows()
            self.dense, self.sparse, self.wide = np.zeros(self.spec.dense_bytes, np.uint8), {}, None
            self._registers(*self._to_dense(own[:, 0], own[:, 1]))

    def add(self, hashes: np.ndarray) -> None:
        precision = self.spec.sp if self.dense is None else self.spec.p
        width = 64 - precision
        rank = width + 1 - bit_lengths(hashes & U((1 << width) - 1))
        self._registers((hashes >> U(width)).astype(np.int64), rank)

    def absorb(self, state: wire.HllState) -> None:
        own = np.array(state.registers, np.int64).reshape(-1, 2)
        if state.dense:
            self.force_dense()
        if self.dense is not None and not state.dense:
            self._registers(*self._to_dense(own[:, 0], own[:, 1]))
        else:
            self._registers(own[:, 0], own[:, 1])

    def state(self) -> wire.HllState:
        if self.dense is None:
            return wire.HllState(False, [(i, r) for i, r in self._sparse_rows().tolist()])
        at = np.flatnonzero(self.dense)
        return wire.HllState(True, list(zip(at.tolist(), self.dense[at].tolist(), strict=True)))

    def states(self) -> list[wire.HllState]:
        """The state, in as many as the wire format needs for sparse registers."""
        whole, n = self.state(), self.spec.promotion
        if whole.dense or len(whole.registers) <= n:
            return [whole]
        return [wire.HllState(False, whole.registers[a : a + n]) for a in range(0, len(whole.registers), n)]


class BloomPart:
    def __init__(self, spec: BloomSpec) -> None:
        self.spec, self.count = spec, 0
        self.bits = np.zeros((spec.bits + 7) // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        self.count = checked_count(self.count + len(hashes))
        for position in positions(np.unique(hashes), self.spec):
            np.bitwise_or.at(self.bits, position >> 3, (1 << (position & 7)).astype(np.uint8))

    def absorb(self, state: wire.BloomState) -> None:
        self.count = checked_count(self.count + state.inserted_count)
        self.bits |= np.frombuffer(state.bitset, np.uint8)

    def state(self) -> wire.BloomState:
        return wire.BloomState(self.bits.tobytes(), self.count)


def positions(hashes: np.ndarray, spec: BloomSpec) -> list[np.ndarray]:
    """The bit of every hash under each function."""
    return [(family(hashes, u64.BLOOM_SEED, i) % U(spec.bits)).astype(np.int64) for i in range(spec.hashes)]


def may_contain(bits: np.ndarray, hashes: np.ndarray, spec: BloomSpec) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for position in positions(hashes, spec):
        found &= (bits[position >> 3] >> (position & 7) & 1).astype(bool)
    return found


class MinHashPart:
    def __init__(self, spec: MinHashSpec) -> None:
        self.spec, self.count = spec, 0
        self.low = np.full(spec.k, u64.MASK, U)

    def add(self, hashes: np.ndarray) -> None:
        self.count = checked_count(self.count + len(hashes))
        if len(hashes):
            own = np.unique(hashes)
            self.low = np.minimum(self.low, np.array([family(own, u64.MINHASH_SEED, i).min() for i in range(self.spec.k)], U))

    def absorb(self, state: wire.MinHashState) -> None:
        self.count = checked_count(self.count + state.populated_count)
        self.low = np.minimum(self.low, np.array([v & u64.MASK for v in state.signature], U))

    def state(self) -> wire.MinHashState:
        return wire.MinHashState(self.low.tolist(), self.count)


class HeavyPart:
    def __init__(self, spec: HeavySpec) -> None:
        self.spec, self.counters = spec, Counters(spec.map_size)

    def add(self, hashes: np.ndarray, weights: np.ndarray) -> None:
        if len(weights) and weights.min() < 0:
            raise NegativeWeightError("a weight is negative")
        keys, at = np.unique(hashes, return_inverse=True)
        sums = np.zeros(len(keys), object)  # Python's integers: an overflow is told, not wrapped
        np.add.at(sums, at, weights.astype(object))
        for key, weight in zip(keys.tolist(), sums.tolist(), strict=True):
            self.counters.add(key, weight)

    def absorb(self, state: wire.HeavyState) -> None:
        self.counters.absorb([(h & u64.MASK, e) for h, e in state.entries], state.total_weight, state.max_error)

    def state(self) -> wire.HeavyState:
        return wire.HeavyState(sorted(self.counters.items()), self.counters.total, self.counters.error)


Part = HllPart | BloomPart | MinHashPart | HeavyPart


def new_part(spec: Spec) -> Part:
    return {HllSpec: HllPart, BloomSpec: BloomPart, MinHashSpec: MinHashPart, HeavySpec: HeavyPart}[type(spec)](spec)


def checked_count(value: int) -> int:
    """A count of updates, as long as a BIGINT has room for it."""
    if value >= 1 << 63:
        raise SketchOverflowError("a count is beyond 64 bits")
    return value
