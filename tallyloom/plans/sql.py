"""The same computations as text that DuckDB runs, to hold the Spark queries against."""

from __future__ import annotations

import hashlib

from tallyloom.functions import u64
from tallyloom.operators.hll import NEIGHBOURS, alpha, bias_points
from tallyloom.profiles import LINEAR_LIMITS, BloomSpec, HeavySpec, HllSpec, MinHashSpec

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || " + " || ".join(f"chr({c})" for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def canonical(x: str) -> str:
    return f"trim(replace(replace(nfc_normalize({x}), chr(13) || chr(10), chr(10)), chr(13), chr(10)), {SPACES})"


def hashed(x: str, domain: str, secret: bytes) -> str:
    """UBIGINT of canonical text."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key) + domain.encode() + b"\0", bytes(b ^ 0x5C for b in key)
    return f"('0x' || substr(sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || encode({x})))), 1, 16))::UBIGINT"


def hex16(x: str) -> str:
    return f"lpad(lower(hex({x})), 16, '0')"


def mix64(x: str) -> str:
    for shift, factor in u64.FINALIZER:
        x = f"xor({x}, {x} >> {shift})" if len(x) < 40 else f"list_transform([{x}], lambda v: xor(v, v >> {shift}))[1]"
        if factor:
            x = f"((({x})::UHUGEINT * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return x


def family(x: str, seed: int, n: int) -> str:
    """A list of the values of the first ``n`` functions."""
    constants = ", ".join(f"{u64.mix64_int(seed ^ i)}::UBIGINT" for i in range(n))
    return f"list_transform([{constants}], lambda s: {mix64(f'xor({x}, s)')})"


def register(h: str, precision: int) -> str:
    width = 64 - precision
    low = f"({h} & {(1 << width) - 1}::UBIGINT)"
    return f"({h} >> {width})::INT AS idx, ({width + 1} - CASE WHEN {low} = 0 THEN 0 ELSE length(ltrim(bin({low}), '0')) END)::INT AS rank"


def sparse_registers(source: str, keys: str, h: str, spec: HllSpec) -> str:
    return f"SELECT {keys}, idx, max(rank) AS rank FROM (SELECT {keys}, {register(h, spec.sp)} FROM {source}) GROUP BY ALL"


def dense_registers(source: str, keys: str, h: str, spec: HllSpec) -> str:
    return f"SELECT {keys}, idx, max(rank) AS rank FROM (SELECT {keys}, {register(h, spec.p)} FROM {source}) GROUP BY ALL"


def linear(m: int, n: str) -> str:
    return f"({m}.0 * ln({m}.0 / ({m}.0 - {n})))"


def sparse_estimates(source: str, keys: str, h: str, spec: HllSpec) -> str:
    return f"SELECT {keys}, round({linear(1 << spec.sp, 'count(*)')}, 6) AS estimate FROM ({sparse_registers(source, keys, h, spec)}) GROUP BY ALL"


def raw_estimate(spec: HllSpec) -> str:
    m = 1 << spec.p
    return f"{alpha(m) * m * m!r} / (sum(pow(2.0, -rank)) + {m} - count(*))"


def dense_estimates(source: str, keys: str, h: str, spec: HllSpec) -> str:
    """CTEs and a query: estimates of dense sketches, by linear counting or less the bias of the nearest points."""
    m, (points, biases) = 1 << spec.p, bias_points(spec.p)
    return f"""r AS ({dense_registers(source, keys, h, spec)}),
e AS (SELECT {keys}, count(*) AS n, {raw_estimate(spec)} AS raw FROM r GROUP BY ALL),
points AS (SELECT unnest({points}) AS x, unnest({biases}) AS y),
near AS (SELECT {keys}, y, row_number() OVER (PARTITION BY {keys} ORDER BY (x - raw) * (x - raw), y) AS rn FROM e, points),
b AS (SELECT {keys}, avg(y) AS bias FROM near WHERE rn <= {NEIGHBOURS} GROUP BY ALL)
SELECT {keys}, round(CASE WHEN n < {m} AND {linear(m, 'n')} <= {LINEAR_LIMITS[spec.p]} THEN {linear(m, 'n')} WHEN raw <= {5 * m} THEN raw - bias ELSE raw END, 6) AS estimate FROM e JOIN b USING ({keys})"""


def heavy(source: str, h: str, weight: str, spec: HeavySpec) -> str:
    """CTEs: ``w`` sums by key, ``d`` the cut, ``held`` the items."""
    return f"""w AS (SELECT {h} AS hash, sum({weight})::BIGINT AS weight FROM {source} GROUP BY 1 HAVING sum({weight}) > 0),
d AS (SELECT coalesce((SELECT weight FROM w ORDER BY weight DESC, hash LIMIT 1 OFFSET {spec.map_size}), 0)::BIGINT AS max_error, (SELECT sum(weight)::BIGINT FROM w) AS total_weight),
held AS (SELECT hash, weight AS estimate, weight - max_error AS lower_bound, weight AS upper_bound, max_error AS error, total_weight FROM w, d WHERE weight > max_error)"""


def bloom_positions(source: str, keys: str, h: str, spec: BloomSpec) -> str:
    return f"SELECT DISTINCT {keys}, (v % {spec.bits})::BIGINT AS position FROM (SELECT {keys}, unnest({family(h, u64.BLOOM_SEED, spec.hashes)}) AS v FROM {source})"


def minhash_minima(source: str, keys: str, h: str, spec: MinHashSpec) -> str:
    return f"SELECT {keys}, i, min(v) AS low FROM (SELECT {keys}, unnest(range({spec.k}))::INT AS i, unnest({family(h, u64.MINHASH_SEED, spec.k)}) AS v FROM (SELECT DISTINCT {keys}, {h} AS {h} FROM {source})) GROUP BY ALL"
