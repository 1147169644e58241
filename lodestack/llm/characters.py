"""Characters that show nothing, and blanks, by their properties."""

from __future__ import annotations

import sys
import unicodedata

# Format characters that do show something (signs written before numbers or letters).
SHOWN = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
# Characters that show nothing though they are neither format nor control characters.
UNSHOWN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
# Control characters that are white space.
WHITE = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85}

BLANK = {c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp")} | WHITE
INVISIBLE = ({c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Cf", "Cc")} - SHOWN - WHITE) | UNSHOWN


def as_class(codes: set[int]) -> str:
    """The inside of a regular expression's character class."""
    ranges: list[list[int]] = []
    for c in sorted(codes):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
