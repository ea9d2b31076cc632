"""Pre-splitting of texts into the pieces that a byte-pair tokenizer encodes one by one.

Two families of tokenizers.json are known: byte-level pieces that keep a leading space, and lower-cased words without
white space. A text whose characters lie in SAFE is split here by Python's re, whose classes agree there with the
library's; any other text is left to the library.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: Characters outside which Python's \w, \d and \s are known to agree with \p{L}, \p{N} and \s: ASCII without the
#: separators 1C-1F, Latin up to 024F without the numerals that are no decimal digits, general punctuation 2010-2027.
UNSAFE = re.compile(f"[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe{chr(0x250)}-{chr(0x200F)}{chr(0x2028)}-{chr(0x10FFFF)}]")

_L, _OTHER = r"[^\W\d_]", r"(?:[^\w\s]|_)"
_SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
#: Fixed pattern of the byte-level family (see the library's file), and of the word family after lower-casing.
BYTE_PIECES = re.compile(rf"{_SUFFIX}| ?{_L}+| ?\d+| ?{_OTHER}+|\s+(?!\S)|\s+")
WORD_PIECES = re.compile(rf"{_SUFFIX}|{_L}+|\d|{_OTHER}+")


@lru_cache(maxsize=8)
def layout(path: str) -> dict:
    """What the file says of its family ('byte', 'word' or None) and its special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = json.dumps(spec.get("pre_tokenizer")), spec.get("normalizer")
    special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
    plain = not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens") or [])
    family = None
    if plain and norm is None and '"ByteLevel"' in pre and '"use_regex": true' in pre and '"add_prefix_space": false' in pre:
        family = "byte"
    elif plain and norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and '"Removed"' in pre and r"[\\p{L}]+|[\\p{N}]|" in pre:
        family = "word"
    return {"family": family, "special": special, "splitter": re.compile("(" + "|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None}


def pieces(text: str, family: str) -> list[str] | None:
    """The pieces of a text without special strings, or None where only the library can tell."""
    if UNSAFE.search(text):
        return None
    return BYTE_PIECES.findall(text) if family == "byte" else WORD_PIECES.findall(text.lower())


def stable_cut(text: str, p: int, special: list[str]) -> bool:
    """Whether encode(text) is encode(text[:p]) + encode(text[p:]) whatever else the text holds, in both families.

    Proof: both characters are ASCII, so normalisation joins nothing across p. The left one is no white space, and the
    right one is of another class (letter, digit, white space, other). Every alternative of both patterns that takes
    the left character ends before a character of another class, but for an apostrophe that opens a suffix such as
    's, which is therefore excluded on the left. A match never looks behind where it starts. No special string may
    lie across p.
    """
    if not 0 < p < len(text):
        return False
    a, b = text[p - 1], text[p]
    if a > "\x7f" or b > "\x7f" or "\x1c" <= a <= "\x1f" or "\x1c" <= b <= "\x1f" or a == "'" or a.isspace() or _kind(a) == _kind(b):
        return False
    return not any(text.find(s, max(0, p - len(s) + 1), p + len(s) - 1) >= 0 for s in special)


def _kind(c: str) -> int:
    return 0 if c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3
