"""Domain-separated keyed hashes: the first eight bytes of an HMAC-SHA256, as a BIGINT with those bits."""

from __future__ import annotations

import hashlib
import hmac
import os
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.errors import EmptySecretError, InvalidTextError, UnregisteredDomainError, WeakSecretError
from tallyloom.functions import u64
from tallyloom.functions.canonical import canonical
from tallyloom.profiles import is_registered_domain

SHORTEST_SECRET = 16
#: Placeholders that are no secrets.
PLACEHOLDERS = (b"demo-secret-change-me", b"dev-secret-change-me")


def _checked(value: bytes) -> bytes:
    if len(value) < SHORTEST_SECRET or value in PLACEHOLDERS:
        raise WeakSecretError("a secret has 16 bytes at least and is no placeholder")
    return value


@dataclass(frozen=True)
class Secret:
    """A secret in the driver's hands.  It never shows in ``repr``; ``hash64`` puts it in no plan unasked."""

    value: bytes = field(repr=False)

    def __post_init__(self) -> None:
        _checked(self.value)

    def __str__(self) -> str:
        return "Secret(***)"


@dataclass(frozen=True)
class EnvSecret:
    """A secret that executors read from an environment variable; only its name travels."""

    variable: str

    def read(self) -> Secret:
        if not self.variable:
            raise EmptySecretError("the variable has no name")
        value = os.environ.get(self.variable, "")
        if not value:
            raise EmptySecretError(f"{self.variable} is not set")
        return Secret(value.encode("utf-8"))


def secret_from_env(variable: str) -> Secret:
    return EnvSecret(variable).read()


def _domain(domain: str) -> str:
    if not is_registered_domain(domain):
        raise UnregisteredDomainError(f"no registered domain {domain!r}")
    return domain


def digest64(secret: Secret, domain: str, canonical_bytes: bytes) -> bytes:
    """One digest, outside Spark."""
    return hmac.digest(_checked(secret.value), _domain(domain).encode() + b"\0" + canonical_bytes, "sha256")[:8]


def hash64(value: Column | str, domain: str, secret: Secret | EnvSecret, *, allow_plan_literals: bool = False) -> Column:
    """Keyed hash of canonical text or bytes; null stays null.

    With an ``EnvSecret`` (the default way) an Arrow UDF reads the secret on the executor.  A ``Secret``
    needs ``allow_plan_literals``: the hash is then built from ``sha2`` and stays in the JVM, but the padded
    key shows in plans and event logs, which only suits secrets that are public.
    """
    prefix = _domain(domain).encode() + b"\0"
    message = (F.col(value) if isinstance(value, str) else value).cast("binary")
    if isinstance(secret, EnvSecret):

        @F.pandas_udf("long")
        def keyed(messages: pd.Series) -> pd.Series:
            start = hmac.new(secret.read().value, prefix, hashlib.sha256)

            def one(m: bytes) -> int:
                own = start.copy()
                own.update(m)
                return int.from_bytes(own.digest()[:8], "big", signed=True)

            return pd.Series(np.array([None if m is None else one(m) for m in messages], object)).astype("Int64")

        return keyed(message)
    if not allow_plan_literals:
        raise WeakSecretError("a secret must not be put in a plan; use EnvSecret, or allow it for a public one")
    key = _checked(secret.value)
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key) + prefix, bytes(b ^ 0x5C for b in key)
    literal = lambda b: F.unhex(F.lit(b.hex()))
    inside = F.unhex(F.sha2(F.concat(literal(inner), message), 256))
    return u64.from_hex16(F.substring(F.sha2(F.concat(literal(outer), inside), 256), 1, 16))


def digest64_hex(value: Column | str, domain: str, secret: Secret | EnvSecret, **options) -> Column:
    return u64.hex16(hash64(value, domain, secret, **options))


def tool_error_key(tool: Column | str, error: Column | str) -> Column:
    """Both parts canonical, joined by one NUL; a NUL within a part would be ambiguous and fails."""
    parts = [canonical(x) for x in (tool, error)]
    bad = F.lit(False)
    for p in parts:
        bad = bad | F.coalesce(F.contains(p, F.lit("\0")), F.lit(False))
    joined = F.concat(parts[0], F.lit("\0"), parts[1])
    return F.when(bad, F.raise_error(F.lit("a tool or error name holds NUL"))).otherwise(joined)


def tool_error_bytes(tool: bytes, error: bytes) -> bytes:
    if b"\0" in tool or b"\0" in error:
        raise InvalidTextError("a tool or error name holds NUL")
    return tool + b"\0" + error
