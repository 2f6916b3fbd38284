"""Character references of HTML, all of them, as column expressions.

Texts are cut at references; each is replaced once, so what a replacement yields is never decoded again. The names come from
the standard library's table. A name needs its semicolon unless the standard allows it without; then the longest name counts
that the text begins with. Numbers are code points, decimal or hexadecimal: 128 to 159 stand for the characters that
Windows-1252 has there, zero, surrogates and what lies beyond Unicode become U+FFFD, other control characters and
noncharacters vanish. Whatever is no reference stays as it is, and null stays null.
"""

from __future__ import annotations

from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOST = "�"


def _longest_first(names: list[str]) -> str:
    return "|".join(sorted(names, key=lambda n: (-len(n), n)))


@cache
def _pattern() -> str:
    closed = _longest_first([n for n in html5 if n.endswith(";")])
    open_ = _longest_first([n for n in html5 if not n.endswith(";")])
    return f"(?s)&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|{closed}|{open_})|[^&]+|&"


def _windows(code: int) -> str:
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _character(code: Column) -> Column:
    """The character of a code point; null counts as too large to be one."""
    named = F.create_map(*[F.lit(x) for c in range(128, 160) for x in (c, _windows(c))])
    last_two = code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE
    unheard = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | last_two
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    lost = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(lost, _LOST).when(code == 13, "\r").when(code.between(128, 159), F.element_at(named, code.cast("int"))).when(unheard, "").otherwise(plain)


def _number(digits: Column, base: int) -> Column:
    """A code point; null where the digits, leading zeros aside, are too many for one."""
    digits = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(digits) <= 8, F.conv(digits, base, 10).cast("long"))


def decode(text: Column) -> Column:
    named = F.create_map(*[F.lit(x) for name, plain in html5.items() for x in ("&" + name, plain)])

    def one(part: Column) -> Column:
        digits = F.regexp_replace(part, "[^0-9a-fA-F]", "")
        return (F.when(~part.startswith("&") | (part == "&"), part)
                .when(F.lower(F.substring(part, 1, 3)) == "&#x", _character(_number(digits, 16)))
                .when(part.startswith("&#"), _character(_number(digits, 10)))
                .otherwise(F.element_at(named, part)))

    parts = F.regexp_extract_all(text, F.lit(_pattern()), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)
