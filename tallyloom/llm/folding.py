"""Texts as folded words: look-alike letters and digit substitutions undone, everything else a blank."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

#: Cyrillic and Greek letters that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w",
}
#: Digits and signs written for letters, undone where a letter follows.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_SUBSTITUTED = re.compile(r"[0134578@$!]+(?=[^\W\d_])")
_SIGNS = str.maketrans(SUBSTITUTES)
BLANK, NOTHING = 0x20, 0


@cache
def _letters(look_alikes: bool) -> np.ndarray:
    """For every code point what stands for it: a lower-case letter, a blank, or nothing."""
    table = np.array([k if chr(k).isalpha() or unicodedata.combining(chr(k)) else BLANK for k in range(0x110000)], np.uint32)
    for k in range(0x2C00):
        if table[k] != BLANK:
            table[k] = ord(chr(k).lower()[0])
    if look_alikes:
        for k in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:
            base = unicodedata.normalize("NFKD", chr(k))[0].lower()
            if base.isascii() and base.isalpha():
                table[k] = ord(base)
        for letter, base in HOMOGLYPHS.items():
            table[[ord(letter), ord(letter.upper()[0])]] = ord(base)
        table[[ord("ı"), ord("I")]] = ord("i")
        table[0x300:0x370] = NOTHING
        table[[0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF]] = NOTHING
    return table


def letters_only(text: str, look_alikes: bool = False) -> str:
    """Lower-cased letters; a blank for each run of anything else."""
    codes = _letters(look_alikes)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = codes != NOTHING
    if not keep.all():
        codes = codes[keep]
    blank = codes == BLANK
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return codes[keep].tobytes().decode("utf-32-le", "surrogatepass")


def folded(text: str | None) -> str:
    """The words of a text, each with one blank before it and one after the last; " " if it has none."""
    plain = _SUBSTITUTED.sub(lambda m: m[0].translate(_SIGNS), text or "")
    return letters_only(f" {plain} ", look_alikes=True)
