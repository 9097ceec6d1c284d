"""Words as 64-bit hashes, and arrays of numbers as compressible bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash

CACHE_WORDS = 400_000


class WordHashes(dict):
    """64-bit hashes of words, remembered for frequent reuse and forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def pack(values: np.ndarray) -> bytes:
    """Byte plane by byte plane, high planes first: those of sorted or small numbers compress well."""
    size = values.dtype.itemsize
    return values.astype(values.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, size).T.tobytes()


def unpack(blob: bytes, kind: type[np.unsignedinteger]) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(blob, np.uint8).reshape(size, -1)
    return planes.T.copy().view(np.dtype(kind).newbyteorder(">")).ravel().astype(kind)


def in_ranges(hashes: np.ndarray, ranges: int) -> tuple[list[int], np.ndarray]:
    """Which of ``ranges`` even ranges sorted 64-bit hashes lie in, and where to cut them between two.

    Only ranges that have a hash are told, so the work follows the hashes however many ranges there are.
    """
    if not 0 < ranges < 1 << 31:
        raise ValueError("ranges are counted in 31 bits")
    own = (hashes >> np.uint64(33)) * np.uint64(ranges) >> np.uint64(31)
    cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
    return own[np.r_[0, cuts]].tolist() if len(own) else [], cuts


def split_words(texts: pd.Series, lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts one after the other, and how many each text has; null has none."""
    words: list[bytes] = []
    lengths = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            raw = text.encode("utf-8")
            own = (raw.lower() if lower else raw).split()
            lengths[k] = len(own)
            words += own
    return words, lengths
