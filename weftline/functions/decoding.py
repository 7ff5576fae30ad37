"""Bytes as text: UTF-8, else GB18030, else UTF-16, by expressions that need no setting of the session.

Bytes read as ISO-8859-1 are a text of the same length, so that an encoding's well-formed texts are a regular language over it. What
an encoding accepts is therefore known before anything is decoded, and no decoder ever meets wrong bytes.
"""

from __future__ import annotations

import json
from functools import cache

from pyspark.sql import Column, functions as F

#: The byte sequences of GB18030, and pairs and quadruples of UTF-16 with the low byte first and last.
_GB_TOKEN = r"[\x00-\x7F]+|[\x81-\xFE][\x30-\x39][\x81-\xFE][\x30-\x39]|[\x81-\xFE][\x40-\x7E\x80-\xFE]"
_LOW_FIRST = r"[\x00-\xFF][\x00-\xD7\xE0-\xFF]|[\x00-\xFF][\xD8-\xDB][\x00-\xFF][\xDC-\xDF]"
_LOW_LAST = r"[\x00-\xD7\xE0-\xFF][\x00-\xFF]|[\xD8-\xDB][\x00-\xFF][\xDC-\xDF][\x00-\xFF]"
#: Numbers of the four-byte sequences below U+10000, and that of U+10000.
_BELOW, _ASTRAL = 39_420, 189_000


@cache
def _gb_tables() -> tuple[str, str]:
    """The characters of all two-byte sequences in order (190 to a first byte), and of the four-byte ones below U+10000; an empty text
    for a sequence that stands for nothing. By rule, from the codec."""

    def char(raw: bytes) -> str:
        try:
            return raw.decode("gb18030")
        except UnicodeDecodeError:
            return ""

    two = [char(bytes([a, b])) for a in range(0x81, 0xFF) for b in [*range(0x40, 0x7F), *range(0x80, 0xFF)]]
    four = [char(bytes([0x81 + n // 12600, 0x30 + n // 1260 % 10, 0x81 + n // 10 % 126, 0x30 + n % 10])) for n in range(_BELOW)]
    return json.dumps(two), json.dumps(four)


def _all_of(latin: Column, tokens: str) -> Column:
    """Whether a text is a row of such tokens; possessive, so that long texts need no stack."""
    return latin.rlike(rf"\A(?:{tokens})*+\z")


def _gb18030(latin: Column) -> Column:
    """A text of GB18030 tokens decoded; null where a token stands for nothing."""
    two, four = (F.from_json(F.lit(t), "array<string>") for t in _gb_tables())

    def char(t: Column) -> Column:
        byte = lambda i: F.ascii(F.substring(t, i, 1))
        pair = (byte(1) - 0x81) * 190 + byte(2) - 0x40 - (byte(2) > 0x7F).cast("int")
        number = (((byte(1) - 0x81) * 10 + byte(2) - 0x30) * 126 + byte(3) - 0x81) * 10 + byte(4) - 0x30
        high = F.decode(F.unhex(F.lpad(F.hex((number - _ASTRAL + 0x10000).cast("long")), 8, "0")), "UTF-32")
        quad = F.when(number < _BELOW, F.get(four, number)).when(number.between(_ASTRAL, _ASTRAL + 0xFFFFF), high).otherwise("")
        return F.when(byte(1) < 0x80, t).when(F.length(t) == 2, F.get(two, pair)).otherwise(quad)

    parts = F.transform(F.regexp_extract_all(latin, F.lit(_GB_TOKEN), F.lit(0)), char)
    return F.when(~F.exists(parts, lambda p: p == ""), F.array_join(parts, ""))


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8, else GB18030, else UTF-16 (low byte first unless a mark says otherwise), without a byte order mark; null if none
    fits."""
    latin = F.decode(content, "ISO-8859-1")
    marked = lambda mark: F.startswith(content, F.unhex(F.lit(mark)))
    rest, latin_rest = F.substring(content, 3, 2_000_000_000), F.substring(latin, 3, 2_000_000_000)
    sixteen = (
        F.when(marked("FFFE"), F.when(_all_of(latin_rest, _LOW_FIRST), F.decode(rest, "UTF-16LE")))
        .when(marked("FEFF"), F.when(_all_of(latin_rest, _LOW_LAST), F.decode(rest, "UTF-16BE")))
        .otherwise(F.when(_all_of(latin, _LOW_FIRST), F.decode(content, "UTF-16LE")))
    )
    text = content.cast("string")
    utf8 = F.when(marked("EFBBBF"), F.substring(text, 2, 2_000_000_000)).otherwise(text)
    return F.when(F.is_valid_utf8(text), utf8).otherwise(F.coalesce(F.when(_all_of(latin, _GB_TOKEN), _gb18030(latin)), sixteen))
