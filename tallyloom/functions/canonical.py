"""Canonical text: one byte form for texts that mean the same key."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyloom.errors import InvalidTextError, UnsupportedProfileError

TEXT_V1 = "text_v1"
#: The characters of Unicode's White_Space property.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def canonical_text(value: str | bytes) -> bytes:
    """The same for a single value, outside Spark."""
    try:
        text = value.decode("utf-8") if isinstance(value, bytes) else value
        text.encode("utf-8")
    except UnicodeError as e:
        raise InvalidTextError("not valid UTF-8") from e
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n").strip(SPACES)
    return unicodedata.normalize("NFC", text).encode("utf-8")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def canonical(value: Column | str, profile: str = TEXT_V1) -> Column:
    """Canonical form of a string column, or of a binary one that must hold UTF-8; null stays null.

    Composed form, line ends as line feeds, white space trimmed.  Texts of ASCII alone are composed
    already and never leave the JVM.  Bytes that are no UTF-8 fail the query; they are not replaced.  A value
    of any other type has no one text: the query fails, and the caller is to cast it.
    """
    if profile != TEXT_V1:
        raise UnsupportedProfileError(f"no canonicalization {profile!r}")
    given = F.col(value) if isinstance(value, str) else value
    kind = F.typeof(given)
    refused = F.raise_error(F.concat(F.lit("no text but "), kind)).cast("string")
    text = F.validate_utf8(F.when(kind.isin("string", "binary"), given.cast("string")).otherwise(refused))

    def composed(x: Column) -> Column:
        return F.coalesce(_nfc(F.when(x.rlike("[^\\x00-\\x7F]"), x)), x)

    lines = F.replace(F.replace(composed(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.btrim(lines, F.lit(SPACES))  # trimming composed text leaves it composed
