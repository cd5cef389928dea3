"""Character classes of the public tokenizers' patterns, pinned to the tokenizers library's tables.

Patterns are written for the `regex` module. Its tables are newer than the library's: the code points of `NEWER` are letters
or numbers there and neither here. Texts that hold none of them, which is nearly all, take a plain class.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import regex

#: White space of the library's `\\s`.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Ranges of code points (hexadecimal) that the library counts neither as letters nor as numbers, whatever later tables say.
NEWER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
#: Capital letters newer than Python's tables, as first, last (hexadecimal) and the first one's small letter.
NEWER_CAPITALS = """
1C89 1C89 1C8A, A7CB A7CB 264, A7CC A7CC A7CD, A7CE A7CE A7CF, A7D2 A7D2 A7D3, A7D4 A7D4 A7D5, A7DA A7DA A7DB, A7DC A7DC 19B,
10D50 10D65 10D70, 16EA0 16EB8 16EBB
"""

_RANGES = [tuple(int(x, 16) for x in r.split("-")) for r in NEWER.split()]
_CLASS = "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in _RANGES)
_NEWER = re.compile(f"[{_CLASS}]")
_SMALL = {a + i: c + i for a, b, c in (tuple(int(x, 16) for x in r.split()) for r in NEWER_CAPITALS.split(",")) for i in range(b - a + 1)}
_CAPITALS = re.compile("[" + "".join(map(chr, _SMALL)) + "]")


def finder(pattern: str) -> Callable[[str], list[str]]:
    """findall of a pattern in which WHITE, \\p{L} and \\p{N} stand for the classes here."""
    plain = regex.compile(pattern)
    letter, number = (rf"(?:(?![{_CLASS}])\p{{{c}}})" for c in "LN")
    rest = rf"(?:[{_CLASS}]|[^\1\p{{L}}\p{{N}}])"
    exact = regex.compile(re.sub(r"\[\^(.*?)\\p\{L\}\\p\{N\}\]", lambda m: rest.replace(r"\1", m[1]), pattern).replace(r" ?\p{L}", f" ?{letter}").replace(r" ?\p{N}", f" ?{number}").replace(r"|\p{L}", f"|{letter}").replace(r"|\p{N}", f"|{number}"))

    def find(text: str) -> list[str]:
        return (plain if text.isascii() or not _NEWER.search(text) else exact).findall(text)

    return find


def lowered(text: str) -> str:
    """NFC, then lower case letter by letter (no rule for a sigma at a word's end)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return text.translate(_SMALL) if _CAPITALS.search(text) else text
