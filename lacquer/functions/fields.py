"""The eight normalizers: a column of text to a struct (value, confidence).

A normalizer has a structural part, inferences and a gate. What the structural part changes counts if
it passes the gate, at a higher tier than an inference that does; a value that passes as it is, is
clean. Anything else stays as it is, at the lowest tier. SQL NULL stands for values that are not text:
null with confidence 0. The parts can be worked out in columns of their own, one after the other, which
keeps plans small; as a callable, a normalizer is one expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dictionaries as d
from .repair import repair, single_pattern, window_patterns
from .text import DIGIT, SPACE, any_of, ascii_digits, char_class, replace_chars, strip_noise, strip_separators, strip_spaces

RESULT = "struct<value:string,confidence:double>"


def outcome(value: Column, *cases: tuple[Column, Column, float]) -> Column:
    """The first case (condition, result, confidence) that holds; else the value itself at the lowest tier."""

    def pair(v: Column, confidence: float) -> Column:
        return F.struct(v.alias("value"), F.lit(float(confidence)).alias("confidence"))

    out = F.when(value.isNull(), pair(value, d.NOT_TEXT))
    for condition, result, confidence in cases:
        out = out.when(F.coalesce(condition, F.lit(False)), pair(result, confidence))
    return out.otherwise(pair(value, d.NONE))


@dataclass(frozen=True)
class Normalizer:
    """core(value without noise), inferences(core) in their order, and the gate that any result has to pass.

    stops: a value that the structural part changes is not inferred from. noise: what is dropped first.
    """

    core: Callable[[Column], Column]
    inferences: Callable[[Column], tuple[Column, ...]]
    gate: Callable[[Column], Column]
    stops: bool = False
    noise: Callable[[Column], Column] = strip_noise

    def decide(self, value: Column, core: Column, inferred: tuple[Column, ...]) -> Column:
        kept = [(core != value, value, d.NONE)] if self.stops else []
        return outcome(
            value,
            ((core != value) & self.gate(core), core, d.STRUCTURAL),
            *kept,
            *[((x != core) & self.gate(x), x, d.INFERRED) for x in inferred],
            (self.gate(value), value, d.CLEAN),
        )

    def __call__(self, value: Column) -> Column:
        core = self.core(self.noise(value))
        return self.decide(value, core, self.inferences(core))


# --- person ---


def is_name(s: Column) -> Column:
    compound = any_of(d.COMPOUND_SURNAMES)
    return s.rlike(rf"^[一-鿿]{{2,6}}\n?\z") & s.rlike(f"(?s)^(?:{compound}.|(?!{compound}){char_class(sorted(d.SURNAMES))}.)")


def person_inferences(core: Column) -> tuple[Column, ...]:
    """Typos repaired in the given name; a surname is never repaired."""
    surname = F.regexp_extract(core, f"^(?:{any_of(d.COMPOUND_SURNAMES)}|{char_class(sorted(d.SURNAMES))})", 0)
    return (F.concat(surname, replace_chars(F.substr(core, F.length(surname) + 1), d.PERSON_TYPOS)),)


PERSON = Normalizer(strip_separators, person_inferences, is_name, stops=True, noise=lambda v: strip_noise(v, d.TITLES))


# --- address ---


def is_address(s: Column) -> Column:
    return s.rlike(DIGIT) & s.rlike(char_class(d.ADDRESS_MARKS))


@cache
def address_patterns(cities: frozenset[str]) -> tuple[list[str], str]:
    words = d.ADDRESS_WORDS | d.DIRECTION_WORDS | cities | set(d.PROVINCES) | set(d.PROVINCES.values())
    return (
        window_patterns(d.ADDRESS_TYPOS, words, d.DIRECTION_WORDS, d.AFTER_DIRECTION),
        single_pattern(d.ADDRESS_TYPOS, d.SINGLE_OK, words, d.ADDRESS_GUARDS, d.AFTER_DIGIT, d.BEFORE_DIGIT, d.DIRECTION_WORDS, d.AFTER_DIRECTION),
    )


def repair_address(s: Column, cities: frozenset[str] = d.CITIES) -> Column:
    """One typo repaired. At the end, after a digit, the ambiguous character is a room; elsewhere a city."""
    room = r"(?<=\p{Nd})式\z"
    return F.when(s.rlike(room), F.regexp_replace(s, room, "室")).otherwise(repair(s, d.ADDRESS_TYPOS, *address_patterns(cities)))


def complete_regions(s: Column, cities: frozenset[str] = d.CITIES) -> Column:
    """Add the endings that a leading province and city lack; a region that is not written is not guessed."""
    short = rf"(?s)^({any_of(d.PROVINCES)})(?!市|{any_of(d.PROVINCE_ENDINGS)})"
    full = F.create_map(*[F.lit(x) for item in d.PROVINCES.items() for x in item])
    name = F.regexp_extract(s, short, 1)
    s = F.when(name != "", F.concat(F.element_at(full, name), F.substr(s, F.length(name) + 1))).otherwise(s)
    province = F.regexp_extract(s, f"^{any_of(d.PROVINCES.values())}", 0)
    rest = F.substr(s, F.length(province) + 1)
    return F.concat(province, F.regexp_replace(rest, f"(?s)^({any_of(cities)})(?![市区县])(?=.{{0,5}}[区县])", "$1市"))


def address_normalizer(cities: frozenset[str] = d.CITIES) -> Normalizer:
    """Typos are tried before regions, since a typo can hide that a region has its ending."""
    return Normalizer(strip_separators, lambda core: (repair_address(core, cities), complete_regions(core, cities)), is_address, stops=True)


# --- company ---


def is_company(s: Column) -> Column:
    return (F.length(s) >= 4) & s.rlike(any_of(d.ORGANISATIONS) + r"\z")


COMPANY_PATTERNS = window_patterns(d.COMPANY_TYPOS, d.ORGANISATIONS | d.INDUSTRIES)


def company_inferences(core: Column) -> tuple[Column, ...]:
    """The one unambiguous short form written out, or one typo repaired in a closed-set word."""
    return F.regexp_replace(core, d.SHORT_FORM + r"\z", d.FULL_FORM), repair(core, d.COMPANY_TYPOS, COMPANY_PATTERNS)


COMPANY = Normalizer(strip_separators, company_inferences, is_company, stops=True)


# --- phone ---


def is_phone(s: Column) -> Column:
    return s.rlike(rf"^1[3-9]{DIGIT}{{9}}\n?\z")


def phone_core(stripped: Column) -> Column:
    """Separators, plus signs and, where eleven digits follow, country codes dropped."""
    plain = F.regexp_replace(strip_separators(stripped), r"^\++", "")
    return F.regexp_replace(plain, r"(?s)^(?:0086|086|86)(?=.{11}\z)", "")


PHONE = Normalizer(phone_core, lambda core: (replace_chars(core, d.PHONE_DIGITS),), is_phone)


# --- amount ---


def is_amount(s: Column) -> Column:
    return s.rlike(rf"^{DIGIT}+(\.{DIGIT}+)?元\n?\z")


def amount_inferences(core: Column) -> tuple[Column, ...]:
    """Ten-thousands written out, with letters taken for digits after that; or ten-thousands alone."""
    number = F.regexp_extract(core, rf"^({DIGIT}+(?:\.{DIGIT}+)?)万元\z", 1)
    scaled = F.call_function("format_number", ascii_digits(number).try_cast("double") * 10000, F.lit("0.0000"))
    written = F.when(number != "", F.concat(F.regexp_replace(scaled, r"\.?0*\z", ""), F.lit("元"))).otherwise(core)
    return replace_chars(written, d.NUMBER_DIGITS), written


AMOUNT = Normalizer(lambda stripped: F.regexp_replace(strip_spaces(stripped), "[,，]", ""), amount_inferences, is_amount)


# --- date ---


def iso_date(s: Column, last_year: int = d.LAST_YEAR) -> Column:
    """YYYY-MM-DD with zeros filled in, null unless year, month and day are in range. Month lengths are not looked at."""
    pattern = rf"^({DIGIT}{{4}})-({DIGIT}{{1,2}})-({DIGIT}{{1,2}})\n?\z"
    y, m, day = (ascii_digits(F.regexp_extract(s, pattern, k)) for k in (1, 2, 3))
    ok = y.between(str(d.FIRST_YEAR), str(last_year)) & F.lpad(m, 2, "0").between("01", "12") & F.lpad(day, 2, "0").between("01", "31")
    return F.when(ok, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(day, 2, "0")))


def date_normalizer(last_year: int = d.LAST_YEAR) -> Normalizer:
    """Separators unified, spaces dropped and zeros filled in; then letters taken for digits."""

    def canonical(s: Column) -> Column:
        return F.coalesce(iso_date(s, last_year), s)

    def core(stripped: Column) -> Column:
        return canonical(strip_spaces(F.translate(stripped, d.DATE_SEPARATORS, "-" * len(d.DATE_SEPARATORS))))

    return Normalizer(core, lambda c: (canonical(replace_chars(c, d.NUMBER_DIGITS)),), lambda s: iso_date(s, last_year).isNotNull())


# --- identity number ---


def check_digit(first17: Column) -> Column:
    digits = F.split(F.substr(first17, F.lit(1), F.lit(17)), "")
    products = F.zip_with(digits, F.array(*map(F.lit, d.IDENTITY_WEIGHTS)), lambda digit, weight: digit.try_cast("int") * weight)
    total = F.aggregate(products, F.lit(0), lambda held, x: held + x)
    return F.substr(F.lit(d.IDENTITY_CHECKS), total % 11 + 1, F.lit(1))


def is_identity(s: Column) -> Column:
    return s.rlike(rf"(?s)^{DIGIT}{{17}}.\z") & (F.substr(s, F.lit(18), F.lit(1)) == check_digit(ascii_digits(s)))


def idcard_inferences(core: Column) -> tuple[Column, ...]:
    """Letters taken for digits; then, after that, 15-digit numbers of the last century."""
    fixed = replace_chars(core, d.IDENTITY_DIGITS)
    first17 = F.concat(F.substr(fixed, F.lit(1), F.lit(6)), F.lit(d.CENTURY), F.substr(fixed, F.lit(7)))
    return fixed, F.when(fixed.rlike(rf"^{DIGIT}{{15}}\z"), F.concat(first17, check_digit(ascii_digits(first17))))


IDCARD = Normalizer(strip_separators, idcard_inferences, is_identity)


# --- e-mail ---


def is_email(s: Column) -> Column:
    plain = f"[^{SPACE}@]"
    return s.rlike(rf"^{plain}+@{plain}+\.{plain}+\n?\z")


def drop_email_label(value: Column) -> Column:
    return F.regexp_replace(value, rf"(?i)^[{SPACE}]*(?:邮[{SPACE}]*箱|E-?mail)[{SPACE}]*[：:][{SPACE}]*", "")


def repair_email(s: Column) -> Column:
    """Repair only characters whose place tells what they must be: the first one, the ending, and the odd one out in the domain."""
    at = F.instr(s, "@")
    user, domain = F.substr(s, F.lit(1), at - 1), F.substr(s, at + 1)
    user = F.concat(replace_chars(F.substr(user, F.lit(1), F.lit(1)), d.EMAIL_LETTERS), F.substr(user, F.lit(2)))
    dotted = F.instr(domain, ".") > 0
    ending = F.substring_index(domain, ".", -1)
    body = F.when(dotted, F.substr(domain, F.lit(1), F.length(domain) - F.length(ending) - 1)).otherwise(domain)
    letters, digits = F.regexp_replace(body, r"[^\p{L}]", ""), F.regexp_replace(body, rf"[^{DIGIT}]", "")
    as_letter = replace_chars(body, d.EMAIL_LETTERS)
    as_digit = replace_chars(body, {v: k for k, v in d.EMAIL_LETTERS.items()})
    mixed = (letters != "") & (digits != "")
    body_fixed = F.when(mixed & (F.length(digits) == 1) & (as_letter != body), as_letter).when(mixed & (F.length(letters) == 1), as_digit).otherwise(body)
    fixed = F.when(dotted, F.concat_ws(".", body_fixed, replace_chars(ending, d.EMAIL_LETTERS))).otherwise(body_fixed)
    return F.when(at > 0, F.concat(user, F.lit("@"), fixed)).otherwise(s)


EMAIL = Normalizer(strip_spaces, lambda core: (repair_email(core),), is_email, noise=lambda v: strip_noise(drop_email_label(v)))

#: Normalizers by field name; a copy with other entries can be passed to the operators.
REGISTRY: dict[str, Normalizer | Callable[[Column], Column]] = {"person": PERSON, "address": address_normalizer(), "phone": PHONE, "company": COMPANY, "amount": AMOUNT, "date": date_normalizer(), "idcard": IDCARD, "email": EMAIL}
