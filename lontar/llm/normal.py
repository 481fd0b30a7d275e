"""Text forms that ignore markup, entities, invisible signs, Unicode form, letter case and punctuation."""

from __future__ import annotations

import html
import re
import unicodedata

#: A tag begins with a letter, a stroke or a mark, however long it is; ``<`` before a blank or a number is a sign.
_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
_CF = "".join(chr(c) for c in [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10)])
_INVISIBLE = str.maketrans("", "", _CF)
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower-cased text without tags, entities and invisible signs, in composed compatibility form."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
    return text.lower()


def plain_words(text: str) -> list[str]:
    return _WORD.findall(plain(text))
