"""Typo repair by known words, compiled to regular expressions.

Replacing characters by a table is a function, so the strings that a word is repaired from are exactly
those with a character of the word's preimage at each place. So "the leftmost longest window that a
repair turns into a known word" is a search for one pattern per word length, longest first. Single
characters are repaired only where no window is, under guards that become look-arounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, char_class, replace_chars


def window_patterns(typos: dict[str, str], words, constrained=frozenset(), after: str = "") -> list[str]:
    """A pattern for each word length of 2 and more, longest first."""
    sources: dict[str, list[str]] = {}
    for wrong, right in typos.items():
        sources.setdefault(right, []).append(wrong)
    by_length: dict[int, list[str]] = {}
    for word in sorted(words):
        places = [sources.get(c, []) + ([] if c in typos else [c]) for c in word]
        if len(word) > 1 and all(places) and any(p != [c] for p, c in zip(places, word, strict=True)):
            tail = f"(?={char_class(after)})" if word in constrained else ""
            by_length.setdefault(len(word), []).append(f"(?!{word})" + "".join(char_class(p) for p in places) + tail)
    return ["|".join(by_length[n]) for n in sorted(by_length, reverse=True)]


def single_pattern(typos: dict[str, str], allowed, words=frozenset(), guarded=frozenset(), after_digit=frozenset(), before_digit=frozenset(), constrained=frozenset(), after: str = "") -> str:
    """A pattern for one character whose repair is allowed and that no guard protects."""
    longest = max(map(len, words), default=1)
    names = [w for w in {*words, *guarded} if 1 < len(w) <= longest]
    out = []
    for wrong, right in typos.items():
        if right not in allowed:
            continue
        one = rf"(?<=\p{{Nd}}){wrong}" if right in after_digit else wrong
        starts = sorted(w[1:] for w in names if w[0] == wrong)
        if starts:
            one += f"(?!{any_of(starts)})"
        if wrong in before_digit:
            one += r"(?=\p{Nd})"
        for word in sorted(constrained):
            for k, c in enumerate(word):
                if c == right:  # a word that the repair would make has to be followed by one of `after`
                    made = f"{wrong}{word[k + 1:]}(?!{char_class(after)})"
                    one = (f"(?:(?<!{word[:k]})|(?!{made}))" if k else f"(?!{made})") + one
        out.append(one)
    return "|".join(out)


def replace_first(s: Column, pattern: str, table: dict[str, str]) -> Column:
    """Replace characters by the table in the leftmost match; s has to have one."""
    whole = f"(?s)^(.*?)({pattern})"
    head, found = F.regexp_extract(s, whole, 1), F.regexp_extract(s, whole, 2)
    return F.concat(head, replace_chars(found, table), F.substr(s, F.length(head) + F.length(found) + 1))


def repair(s: Column, typos: dict[str, str], windows: list[str], single: str = "") -> Column:
    """s with at most one repair: that of the longest window, or else that of the first single character."""
    out = F.when(F.lit(False), s)
    for pattern in [*windows, single] if single else windows:
        out = out.when(s.rlike(pattern), replace_first(s, pattern, typos))
    return F.when(s.rlike(char_class(typos)), out.otherwise(s)).otherwise(s)
