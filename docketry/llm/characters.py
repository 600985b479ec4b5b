"""One form of characters: invisible ones go, wide ones become plain, every single space is a space, accents are composed."""

from __future__ import annotations

import unicodedata

# Characters without a glyph, and spaces of any width.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]

PLAIN = dict.fromkeys(map(chr, INVISIBLE), "") | dict.fromkeys(map(chr, SPACES), " ") | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}


def plain(text: str) -> str:
    for c in PLAIN.keys() & set(text):  # one fast pass for each such character that the text has
        text = text.replace(c, PLAIN[c])
    return text.replace("\r\n", "\n")


def compose(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def fold(text: str) -> str:
    return text if text.isascii() else compose(plain(text))
