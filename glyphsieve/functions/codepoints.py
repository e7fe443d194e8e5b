"""The flagged code points: pinned ranges, regular-expression classes and lookups by character.

The set is pinned, so it does not move with the Unicode tables of Python or Java.  No property class is used in
any expression, as the engines disagree about them.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points of each category, first to last, in the order in which categories are tested.
CATEGORIES: dict[str, tuple[tuple[int, int], ...]] = {
    "zero_width": ((0x180E, 0x180E), (0x200B, 0x200D), (0x2060, 0x2064), (0xFEFF, 0xFEFF)),
    "bidi_control": ((0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069)),
    "unicode_space": ((0x00A0, 0x00A0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)),
    "blank_glyph": ((0x2800, 0x2800), (0x3164, 0x3164), (0xFFA0, 0xFFA0)),
    "variation_selector": ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF)),
    "tag_character": ((0xE0000, 0xE007F),),
    "control": ((0x0000, 0x0008), (0x000B, 0x000C), (0x000E, 0x001F), (0x007F, 0x009F)),
    "other_format": (
        (0x00AD, 0x00AD), (0x0600, 0x0605), (0x061C, 0x061C), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x206A, 0x206F),
        (0xFFF9, 0xFFFB), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A),
    ),
}
#: The white space of Python's str.strip() and \s.
WHITE_SPACE: tuple[tuple[int, int], ...] = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))

#: Categories with a switch of their own; hidden covers the others.
OWN_SWITCH = ("bidi_control", "unicode_space")


def ranges(*categories: str) -> list[tuple[int, int]]:
    """The ranges of some categories, joined where they touch; of all by default."""
    out: list[list[int]] = []
    for a, b in sorted(r for c in categories or CATEGORIES for r in CATEGORIES[c]):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def char_class(pairs, negated: bool = False) -> str:
    """A class for Java's and RE2's regular expressions."""
    body = "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in pairs)
    return f"[{'^' * negated}{body}]"


def quick_class(*categories: str) -> str:
    """The class of some categories (all by default) for Java, which tries the ranges of a class one by one: the
    printable ASCII characters, of which none is flagged, are turned away by the first test."""
    return f"[[^\\x{{20}}-\\x{{7E}}]&&{char_class(ranges(*categories))}]"


FLAGGED = char_class(ranges())
QUICK_FLAGGED = quick_class()
WS = char_class(WHITE_SPACE)
NOT_WS = char_class(WHITE_SPACE, negated=True)


def stripped_categories(hidden: bool = True, bidi: bool = True, spaces: bool = True) -> tuple[str, ...]:
    """The categories that a choice of the three switches removes."""
    on = {"bidi_control": bidi, "unicode_space": spaces}
    return tuple(c for c in CATEGORIES if on.get(c, hidden))


@lru_cache
def table() -> list[tuple[int, str, str]]:
    """(code point, category, name) of every flagged code point, in order; unnamed ones get a stand-in."""
    rows = sorted((cp, c) for c, pairs in CATEGORIES.items() for a, b in pairs for cp in range(a, b + 1))
    return [(cp, c, unicodedata.name(chr(cp), f"UNNAMED CONTROL (U+{cp:04X})")) for cp, c in rows]


def place_of(char: Column) -> Column:
    """The index of a flagged character in table(), -1 for any other: a byte search in one literal, no join."""
    return F.instr(F.lit("".join(chr(cp) for cp, _, _ in table())), char) - 1


def category_at(place: Column) -> Column:
    order = list(CATEGORIES)
    kinds = F.lit("".join(str(order.index(c)) for _, c, _ in table()))
    return F.when(place >= 0, F.get(F.array(*map(F.lit, order)), F.substring(kinds, place + 1, F.lit(1)).cast("int")))


def name_at(place: Column) -> Column:
    names = F.split(F.lit("\n".join(n for _, _, n in table())), "\n")
    return F.when(place >= 0, F.get(names, place))


def category_of(char: Column) -> Column:
    return category_at(place_of(char))


def name_of(char: Column) -> Column:
    return name_at(place_of(char))


def codepoint_of(char: Column) -> Column:
    return F.format_string("U+%04X", F.ascii(char))


def dimension(spark):
    """The table as a DataFrame: code point, category, name (538 rows)."""
    return spark.createDataFrame([(f"U+{cp:04X}", c, n) for cp, c, n in table()], "codepoint string, category string, name string")
