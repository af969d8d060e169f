"""Pre-tokens of the public tokenizers, as regular expressions that mean the same in Python."""

from __future__ import annotations

import base64
import re
import unicodedata
from functools import lru_cache

import public_tokenizers
import regex

#: The white space that the tokenizers' libraries mean by \s.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def portable(pattern: str) -> str:
    r"""The pattern with \s and \S spelled out: Python's \s also holds U+001C to U+001F."""
    return pattern.replace(r"[^\s", rf"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")


@lru_cache(maxsize=4)
def splitter(pattern: str) -> regex.Pattern:
    return regex.compile(portable(pattern))


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


#: Fixed value: how the lower-casing vocabulary parts its words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=4)
def latin_splitter(pattern: str) -> re.Pattern:
    r"""The same pattern for Latin-1 texts: \p{L} and \p{N} as lists, for the faster standard engine."""
    listed = {kind: "".join(chr(c) for c in range(256) if unicodedata.category(chr(c))[0] == kind) for kind in "LN"}
    spelled = portable(pattern)
    for kind, chars in listed.items():
        spelled = spelled.replace(rf"[\p{{{kind}}}]", f"[{chars}]").replace(rf"\p{{{kind}}}+", f"[{chars}]+").replace(rf"\p{{{kind}}}", chars)
    return re.compile(spelled)


def is_latin(text: str) -> bool:
    """Whether every character is in Latin-1, where lower-casing and composing are alike in every library."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pieces(pattern: str):
    """A function from a text to its pre-tokens."""
    fast, slow = latin_splitter(pattern).findall, splitter(pattern).findall
    return lambda text: (fast if is_latin(text) else slow)(text)
