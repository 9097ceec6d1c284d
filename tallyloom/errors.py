"""What can go wrong, as exception classes; most are raised while a plan is built, before any job runs.

What only the rows can tell is raised by columns while a query runs, and reaches the driver as an error of Spark's; within
``typed_errors()`` it is raised again as the class it stands for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F


class SketchError(ValueError):
    """Base of all errors of this library."""


class InvalidTextError(SketchError):
    """The text is no valid UTF-8, or not a string at all."""


class UnsupportedProfileError(SketchError):
    """No profile has this name."""


class UnregisteredDomainError(SketchError):
    """The hash domain is not registered."""


class UnsupportedAlgorithmError(SketchError):
    """The hash algorithm is not supported."""


class EmptySecretError(SketchError):
    """The secret's variable has no name, or is not set."""


class WeakSecretError(SketchError):
    """The secret is too short, or a known placeholder."""


class IncompatibleMergeError(SketchError):
    """The metadata of two sketches differ."""


class PrecisionMismatchError(IncompatibleMergeError):
    """The precisions of two distinct-count sketches differ."""


class NegativeWeightError(SketchError):
    """Weights are not negative."""


class SketchOverflowError(SketchError):
    """A count or a sum of weights is beyond 64 bits."""


class InvalidQueryModeError(SketchError):
    """Heavy hitters are asked for without false positives, or without false negatives."""


class WireError(SketchError):
    """The bytes are no canonical sketch."""


def raised(kind: type[SketchError], text: str) -> Column:
    """A column that fails the query with an error of this kind."""
    return F.raise_error(F.lit(f"[{kind.__name__}] {text}"))


def checked_sum(column: str) -> Column:
    """The sum of a BIGINT column, which fails the query beyond 64 bits; 0 of no rows."""
    total = F.try_sum(column)
    return F.when(total.isNotNull(), total).when(F.count(column) > 0, raised(SketchOverflowError, f"the sum of {column.strip('_')}").cast("long")).otherwise(F.lit(0))


def _classes(kind: type[SketchError] = SketchError) -> dict[str, type[SketchError]]:
    found = {kind.__name__: kind}
    for own in kind.__subclasses__():
        found |= _classes(own)
    return found


@contextmanager
def typed_errors() -> Iterator[None]:
    """Errors that this library's columns and tasks raise inside a query come out as the classes above."""
    try:
        yield
    except (PySparkException, Py4JJavaError) as e:
        # As columns raise them, or as the last line of a worker's traceback.
        for name, text in re.findall(r"(?:\[|\btallyloom\.errors\.)(\w+Error)(?:\]|:) ?([^\n]*)", str(e)):
            if name in _classes():
                raise _classes()[name](text) from e
        raise
