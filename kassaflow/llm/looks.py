"""What characters look like: ignorable ones, spaces, and look-alikes."""

from __future__ import annotations

import unicodedata

# Letters of other scripts and the Latin letters that look the same.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I",
}
GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J"}
LATIN = {"ɑ": "a", "ɡ": "g"}
MARKS = {"\u02bc": "\u2019", "\u2010": "-", "\u2011": "-"}

#: Spaces drawn as a gap between words, like the plain one.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Drawn as nothing, beside the format characters (category Cf): joiners, fillers and variation selectors.
UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0" + "".join(map(chr, range(0xFE00, 0xFE10)))

_FORMS = ("<wide>", "<narrow>", "<font>")


def ignorable(ch: str) -> bool:
    """Whether a character is drawn as nothing."""
    return unicodedata.category(ch) == "Cf" or ch in UNSEEN


def shape(ch: str) -> str:
    """The plain spelling of one character: what it looks like, decomposed; empty if it is drawn as nothing.

    Width and font variants and the Latin ligatures become their letters.
    Raised and lowered figures, circled and other visibly different forms stay.
    """
    if ignorable(ch):
        return ""
    if ch in SPACES:
        return " "
    kind = unicodedata.decomposition(ch).partition(" ")[0]
    if kind in _FORMS or 0xFB00 <= ord(ch) <= 0xFB06:
        ch = unicodedata.normalize("NFKC", ch)
    out = unicodedata.normalize("NFD", ch)
    return "".join(CYRILLIC.get(c) or GREEK.get(c) or LATIN.get(c) or MARKS.get(c) or c for c in out)


class _Shapes(dict):
    def __missing__(self, code: int) -> str:
        got = self[code] = shape(chr(code))
        return got


class _Letters(dict):
    """For loose comparison of words: shape without accents, in lower case."""

    def __missing__(self, code: int) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", shape(chr(code))) if not unicodedata.combining(c))
        got = self[code] = plain.casefold()
        return got


_shapes, _letters = _Shapes(), _Letters()


def skeleton(text: str) -> str:
    """The shapes of a text in composed form: equal for texts that look the same."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_shapes))


def loose(text: str) -> str:
    """A text without accents, case, look-alikes and unseen characters, for matching words."""
    return text.casefold() if text.isascii() else text.translate(_letters)
