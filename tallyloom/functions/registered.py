"""``sketch_*`` functions of a session, for queries written as SQL.

Table functions build and merge packed sketches::

    SELECT * FROM sketch_hll(TABLE(SELECT day, hash FROM e) PARTITION BY day, profile => 'small', domain => 'user:v1')

All columns of the table but ``hash`` (and ``weight``) are keys.  Without ``PARTITION BY`` every task makes the
sketches of its own rows, so nothing is shuffled but sketches: a hot key, which ``PARTITION BY`` would put in
one task, is split that way, and ``sketch_merge(TABLE(...) PARTITION BY key)`` puts the parts together.  A
task holds ``HELD`` sketches at most and hands on what it has when there are more keys.

``sketch_hll`` and ``sketch_merge`` take ``keep_sparse => true``: distinct counts then keep sparse registers however many, in
several cells a key, which ``sketch_estimate_all(collect_list(sketch))`` counts together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tallyloom.errors import SketchError
from tallyloom.functions import u64
from tallyloom.functions.canonical import canonical_text
from tallyloom.functions.keyed import EnvSecret, digest64
from tallyloom.operators import hll
from tallyloom.operators.parts import HllPart, Part, may_contain, new_part
from tallyloom.profiles import KIND_NAMES, BloomSpec, HeavySpec, HllSpec, MinHashSpec, Spec
from tallyloom.sources import wire

#: Sketches that a task of a table function holds at once, and rows that it gathers before it adds them.
HELD, GATHERED = 256, 8192
ITEM_NAMES = ("hash", "estimate", "lower_bound", "upper_bound", "error")
ITEMS = pa.list_(pa.struct([(name, pa.int64()) for name in ITEM_NAMES]))
SPARK_NAMES = {pa.string(): "string", pa.int64(): "long", pa.float64(): "double", ITEMS: f"array<struct<{','.join(f'{n}:bigint' for n in ITEM_NAMES)}>>"}


def _columns(table: AnalyzeArgument, needed: dict[str, type]) -> list[StructField]:
    """The key columns of a table argument, which must have those needed as well."""
    if not table.isTable:
        raise SketchError("the first argument is a TABLE(...)")
    fields = {f.name: f for f in table.dataType.fields}
    for name, kind in needed.items():
        if name not in fields or not isinstance(fields[name].dataType, kind):
            raise SketchError(f"the table needs a column {name} of type {kind.__name__.removesuffix('Type').lower()}")
    return [f for f in table.dataType.fields if f.name not in needed]


def _spec(kind: type[Spec], profile: AnalyzeArgument | None, domain: AnalyzeArgument | None) -> Spec:
    for name, own in (("profile", profile), ("domain", domain)):
        _constant(name, own)
    return kind(**{name: own.value for name, own in (("profile", profile), ("domain", domain)) if own is not None})


class _Groups:
    """Parts by key, with the rows that wait to be added to them."""

    def __init__(self) -> None:
        self.keep_sparse = False
        self.parts: dict[tuple, tuple[Spec, Part]] = {}
        self.waiting: dict[tuple, list[tuple[int, int]]] = {}
        self.gathered = 0

    def gather(self, key: tuple, value: int, weight: int) -> None:
        self.waiting.setdefault(key, []).append((value, weight))
        self.gathered += 1

    def settle(self, spec: Spec) -> None:
        for key, rows in self.waiting.items():
            part = self._held(key, spec)[1]
            values = np.array([v for v, _ in rows], np.int64).view(np.uint64)
            part.add(*((values, np.array([w for _, w in rows], object)) if isinstance(spec, HeavySpec) else (values,)))
        self.waiting, self.gathered = {}, 0

    def _held(self, key: tuple, spec: Spec) -> tuple[Spec, Part]:
        if key not in self.parts:
            self.parts[key] = (spec, HllPart(spec, self.keep_sparse) if isinstance(spec, HllSpec) else new_part(spec))
        return self.parts[key]

    def absorb(self, key: tuple, cell: bytes) -> None:
        spec, state = wire.decode_any(cell)
        held, part = self._held((*key, type(spec).__name__), spec)
        held.require_same(spec)
        part.absorb(state)

    def packed(self, keys: int) -> Iterator[tuple]:
        for key, (spec, part) in self.parts.items():
            for state in part.states() if isinstance(part, HllPart) else [part.state()]:
                yield (*key[:keys], wire.encode(spec, state))
        self.parts = {}


def _builder(kind: type[Spec]) -> type:
    needed = {"hash": LongType} | ({"weight": LongType} if kind is HeavySpec else {})

    class Build:
        def __init__(self) -> None:
            self.groups, self.spec, self.names = _Groups(), None, None

        @staticmethod
        def analyze(rows: AnalyzeArgument, profile: AnalyzeArgument | None = None, domain: AnalyzeArgument | None = None) -> AnalyzeResult:
            _spec(kind, profile, domain)
            return AnalyzeResult(StructType([*_columns(rows, needed), StructField("sketch", BinaryType())]))

        def eval(self, rows: Row, profile: str | None = None, domain: str | None = None) -> Iterator[tuple]:
            if self.spec is None:
                self.spec = kind(**{k: v for k, v in (("profile", profile), ("domain", domain)) if v is not None})
                self.names = [n for n in rows.__fields__ if n not in needed]
            value, weight = rows["hash"], rows["weight"] if kind is HeavySpec else 1
            if value is None or weight is None:
                return
            self.groups.gather(tuple(rows[n] for n in self.names), value, weight)
            if self.groups.gathered >= GATHERED:
                self.groups.settle(self.spec)
                if len(self.groups.parts) > HELD:
                    yield from self.groups.packed(len(self.names))

        def terminate(self) -> Iterator[tuple]:
            if self.spec is not None:
                self.groups.settle(self.spec)
                yield from self.groups.packed(len(self.names))

    class BuildHll(Build):
        @staticmethod
        def analyze(rows: AnalyzeArgument, profile: AnalyzeArgument | None = None, domain: AnalyzeArgument | None = None, keep_sparse: AnalyzeArgument | None = None) -> AnalyzeResult:
            _constant("keep_sparse", keep_sparse)
            return Build.analyze(rows, profile, domain)

        def eval(self, rows: Row, profile: str | None = None, domain: str | None = None, keep_sparse: bool = False) -> Iterator[tuple]:
            self.groups.keep_sparse = bool(keep_sparse)
            yield from Build.eval(self, rows, profile, domain)

    return BuildHll if kind is HllSpec else Build


class Merge:
    """Merges the packed sketches of equal keys, each kind by itself; others that can't be merged fail the query."""

    def __init__(self) -> None:
        self.groups, self.names = _Groups(), []

    @staticmethod
    def analyze(rows: AnalyzeArgument, keep_sparse: AnalyzeArgument | None = None) -> AnalyzeResult:
        _constant("keep_sparse", keep_sparse)
        return AnalyzeResult(StructType([*_columns(rows, {"sketch": BinaryType}), StructField("sketch", BinaryType())]))

    def eval(self, rows: Row, keep_sparse: bool = False) -> Iterator[tuple]:
        self.groups.keep_sparse = bool(keep_sparse)
        self.names = [n for n in rows.__fields__ if n != "sketch"]
        if rows["sketch"] is not None:
            self.groups.absorb(tuple(rows[n] for n in self.names), bytes(rows["sketch"]))
            if len(self.groups.parts) > HELD:
                yield from self.groups.packed(len(self.names))

    def terminate(self) -> Iterator[tuple]:
        yield from self.groups.packed(len(self.names))


def _constant(name: str, own: AnalyzeArgument | None) -> None:
    if own is not None and not own.isConstantExpression:
        raise SketchError(f"{name} is a constant")


def _estimate(spec: HllSpec, state: wire.HllState) -> float:
    ranks = np.array([r for _, r in state.registers], float)
    return hll.estimate_of(spec, state.dense, len(ranks), float(np.exp2(-ranks).sum()))


def register(spark: SparkSession) -> None:
    """Register the functions in ``spark``: table functions, and scalar ones over packed sketches.

    ``sketch_canonical(text)``, ``sketch_hash64(text, domain, variable)`` with the secret in the executors'
    environment; ``sketch_kind, sketch_profile, sketch_domain``; ``sketch_estimate`` of a distinct count, and
    ``sketch_estimate_all`` of one in an array of cells,
    ``sketch_items`` of heavy hitters, ``sketch_may_contain(sketch, hash)``, ``sketch_jaccard(sketch, sketch)``;
    ``sketch_error`` tells why bytes are no sketch.  All give null for null; bytes that are no sketch of the kind
    fail the query.
    """
    for kind, name in KIND_NAMES.items():
        spark.udtf.register(f"sketch_{name}", F.udtf(_builder(kind)))
    spark.udtf.register("sketch_merge", F.udtf(Merge))

    def over(kind: pa.DataType, function: Callable) -> Callable:
        """A function of single values, null where any of them is, over Arrow arrays: integers beside nulls stay exact."""

        def run(*columns: pa.Array) -> pa.Array:
            return pa.array([None if None in row else function(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], kind)

        def one(a: pa.Array) -> pa.Array:
            return run(a)

        def two(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)

        def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return run(a, b, c)

        return F.arrow_udf({1: one, 2: two, 3: three}[function.__code__.co_argcount], SPARK_NAMES[kind])

    def hash64(text, domain, variable):
        return int.from_bytes(digest64(EnvSecret(variable).read(), domain, canonical_text(text)), "big", signed=True)

    def estimate(cell):
        return _estimate(*wire.decode(cell, HllSpec))

    def estimate_all(cells):
        part = None
        for cell in cells:
            spec, state = wire.decode(cell, HllSpec)
            part = HllPart(spec, True) if part is None else part
            part.spec.require_same(spec)
            part.absorb(state)
        return None if part is None else _estimate(part.spec, part.state())

    def items(cell):
        _, state = wire.decode(cell, HeavySpec)
        ordered = sorted(state.entries, key=lambda e: (-e[1], e[0]))
        return [dict(zip(ITEM_NAMES, (u64.signed(h), e, e - state.max_error, e, state.max_error), strict=True)) for h, e in ordered]

    def jaccard(a, b):
        (left, x), (right, y) = wire.decode(a, MinHashSpec), wire.decode(b, MinHashSpec)
        left.require_same(right)
        if not x.populated_count or not y.populated_count:
            return float(x.populated_count == y.populated_count)
        return sum(p == q for p, q in zip(x.signature, y.signature, strict=True)) / left.k

    def error(cell):
        try:
            wire.decode_any(cell)
        except SketchError as e:
            return f"{type(e).__name__}: {e}"
        return None

    def contains(cells: pa.Array, hashes: pa.Array) -> pa.Array:
        rows: dict[bytes, list[int]] = {}
        values, found = hashes.to_pylist(), [None] * len(hashes)
        for k, cell in enumerate(cells.to_pylist()):
            if cell is not None and values[k] is not None:
                rows.setdefault(cell, []).append(k)
        for cell, at in rows.items():
            spec, state = wire.decode(cell, BloomSpec)
            own = np.array([values[k] for k in at], np.int64).view(np.uint64)
            for k, v in zip(at, may_contain(np.frombuffer(state.bitset, np.uint8), own, spec).tolist(), strict=True):
                found[k] = v
        return pa.array(found, pa.bool_())

    put = spark.udf.register
    put("sketch_canonical", over(pa.string(), lambda text: canonical_text(text).decode()))
    put("sketch_hash64", over(pa.int64(), hash64))
    put("sketch_kind", over(pa.string(), lambda cell: KIND_NAMES[type(wire.specification(cell))]))
    put("sketch_profile", over(pa.string(), lambda cell: wire.specification(cell).profile))
    put("sketch_domain", over(pa.string(), lambda cell: wire.specification(cell).domain))
    put("sketch_estimate", over(pa.float64(), estimate))
    put("sketch_estimate_all", over(pa.float64(), estimate_all))
    put("sketch_items", over(ITEMS, items))
    put("sketch_jaccard", over(pa.float64(), jaccard))
    put("sketch_error", over(pa.string(), error))
    put("sketch_may_contain", F.arrow_udf(contains, "boolean"))
