"""One visual form for characters: look-alikes, width forms, invisible characters, spaces."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts drawn like a Latin letter, by that letter.
LOOKALIKES = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СᏟϹ", "D": "Ꭰᗞ", "E": "ΕЕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "ΗНᎻ",
    "I": "ΙІӀ", "J": "ЈᎫͿ", "K": "ΚКᏦK", "L": "Ꮮ", "M": "ΜМᎷϺ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ",
    "R": "Ꭱ", "S": "ЅᏚՏ", "T": "ΤТᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ΧХ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "αаɑ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳ", "l": "ӏ", "n": "ո",
    "o": "οоօ", "p": "ρр", "q": "ԛզ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝա", "x": "х", "y": "уүγ",
}

# Small Cyrillic letters whose capital is drawn like a Latin capital though they themselves are not.
CASE_ONLY = {"b": "в", "h": "н", "k": "к", "m": "м", "t": "т"}

_TO_LATIN = {ord(c): latin for latin, others in LOOKALIKES.items() for c in others}
_CASE_TO_LATIN = {ord(c): latin for latin, others in CASE_ONLY.items() for c in others}
JOINER = "\u200d"
_PICTURE = re.compile("[←-⯿\U0001f000-\U0001faff\ufe0f]")


@lru_cache(maxsize=None)
def fold_char(c: str) -> str:
    """What one character of a decomposed text becomes; '' for an invisible one."""
    if c < "\x80":
        return c
    if c == JOINER:
        return c  # decided by its neighbours in fold()
    kind = unicodedata.category(c)
    if kind == "Cf" or "\ufe00" <= c <= "\ufe0f" or c in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0":
        return ""
    if kind == "Zs":
        return " "
    if c in "\u2010\u2011":
        return "-"
    shape = unicodedata.decomposition(c)
    if shape.startswith(("<wide>", "<narrow>", "<font>", "<noBreak>")) or "\ufb00" <= c <= "\ufb06":
        return "".join(map(fold_char, unicodedata.normalize("NFKD", c)))
    return _TO_LATIN.get(ord(c), c)


class _Folds(dict):
    """Code point to folded character, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        out = self[code] = fold_char(chr(code))
        return out


_FOLDS = _Folds()


def fold(text: str) -> str:
    """The table form of a text: equal for texts that look the same.

    Full-width and font variants become ordinary letters, special spaces a space, invisible
    characters vanish, letters drawn like a Latin one become it, accents are composed.
    Spaces, case, punctuation and visible accents stay.  A zero-width joiner between two
    pictures changes the picture and stays.
    """
    if text.isascii():
        return text
    out = joined(unicodedata.normalize("NFD", text)).replace(JOINER, "\ufdd0")
    return unicodedata.normalize("NFC", out.translate(_FOLDS)).replace("\ufdd0", JOINER)


def joined(text: str) -> str:
    """The text without zero-width joiners, except between two pictures, where one changes the picture."""
    if JOINER not in text:
        return text
    first, *rest = text.split(JOINER)
    kept, left = first, first
    for right in rest:
        tight = left and right and _PICTURE.match(left[-1]) and _PICTURE.match(right[0])
        kept += (JOINER if tight else "") + right
        left = right
    return kept


def content_fold(folded: str) -> str:
    """Case-blind form of folded text; letters that are alike only as capitals fall together too."""
    low = folded.casefold()
    return low if low.isascii() else low.translate(_CASE_TO_LATIN)


def script_of(c: str) -> str:
    """Script of a letter, by the first word of its Unicode name; '' for anything else."""
    if c < "\x80":
        return "LATIN" if c.isalpha() else ""
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""
