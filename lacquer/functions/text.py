"""Column expressions that the normalizers share. All are built-in functions, so they run in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import SEPARATORS, TRIMMED

#: What counts as white space, for a character class; Java's own class knows ASCII only.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
DIGIT = r"\p{Nd}"
FULL_WIDTH = "０１２３４５６７８９"


def any_of(words, longest_first: bool = True) -> str:
    """A pattern for one of the words."""
    return "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w)) if longest_first else words) + ")"


def char_class(chars) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


def replace_chars(s: Column, table: dict[str, str]) -> Column:
    return F.translate(s, "".join(table), "".join(table.values()))


def strip_noise(s: Column, titles=()) -> Column:
    """Drop a leading label, a trailing title, a trailing note in brackets and outer punctuation, three times over.

    A round that changes nothing is followed by rounds that change nothing, so there is no early exit.
    """
    for _ in range(3):
        s = F.regexp_replace(s, "^[一-鿿]{1,4}[：:]", "")
        if titles:
            s = F.regexp_replace(s, any_of(titles) + r"\z", "")
        s = F.regexp_replace(s, rf"[（(][^）)]{{1,10}}[）)][{SPACE}]*\z", "")
        s = F.btrim(s, F.lit(TRIMMED))
    return s


def strip_spaces(s: Column) -> Column:
    return F.regexp_replace(s, f"[{SPACE}]+", "")


def strip_separators(s: Column) -> Column:
    """Drop white space and separators wherever they stand."""
    return F.regexp_replace(s, "[" + SPACE + "".join("\\" + c if c in "-|\\" else c for c in SEPARATORS) + "]+", "")


def ascii_digits(s: Column) -> Column:
    return F.translate(s, FULL_WIDTH, "0123456789")
