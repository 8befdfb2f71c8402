"""Validators of personal identifiers as column expressions, and text normalisation. All stay in the JVM."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A longer value is free text, never an identifier.
MAX_LENGTH = 256

#: Decimal digits of all scripts but ASCII's own, from the character database.
_DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]


def ascii_digits(c: Column) -> Column:
    """Decimal digits of any script as ASCII ones; everything else stays, so places in the text do too."""
    return F.translate(c, "".join(_DIGITS), "".join(str(unicodedata.decimal(d)) for d in _DIGITS))


def _text(c: Column) -> Column:
    t = ascii_digits(F.trim(c.cast("string")))
    return F.when(F.char_length(c.cast("string")) <= MAX_LENGTH, t)


def _compact(c: Column) -> Column:
    return F.regexp_replace(_text(c), r"[\s\-]", "")


def _matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"^(?:{pattern})$"), F.lit(False))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; false for anything else."""
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def national_id(c: Column) -> Column:
    return _matches(_text(c), "1[0-9]{9}") & luhn(_text(c))


def iqama(c: Column) -> Column:
    return _matches(_text(c), "2[0-9]{9}") & luhn(_text(c))


def mobile(c: Column) -> Column:
    return _matches(F.regexp_replace(_text(c), r"[\s\-().]", ""), r"(?:0|(?:\+|00)?966)5[0-9]{8}")


def iban(c: Column) -> Column:
    """Saudi IBAN: format, and the rearranged number leaves 1 modulo 97, folded digit by digit."""
    t = F.upper(_compact(c))
    turned = F.concat(F.substring(t, 5, 30), F.substring(t, 1, 4))
    digits = F.transform(F.split(turned, ""), lambda ch: F.when(ch.rlike("[0-9]"), ch.cast("int")).when(ch.rlike("[A-Z]"), F.ascii(ch) - 55))
    left = F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda a, d: (F.when(d > 9, a * 100).otherwise(a * 10) + d) % 97)
    return F.when(_matches(t, "SA[0-9]{2}[0-9A-Z]{20}"), left == 1).otherwise(F.lit(False))


def email(c: Column) -> Column:
    part = r"[\p{L}\p{N}](?:[\p{L}\p{N}_\-]*[\p{L}\p{N}])?"
    shape = rf"[\p{{L}}\p{{N}}_.%+\-]+@{part}(?:\.{part})*\.\p{{L}}{{2,}}"
    return _matches(_text(c), shape) & (F.char_length(_text(c)) <= 254)


def card_number(c: Column) -> Column:
    t = _compact(c)
    return _matches(t, "[0-9]{13,19}") & luhn(t) & ~F.coalesce(t.rlike(r"^([0-9])\1*$"), F.lit(False))


def commercial_registration(c: Column) -> Column:
    return _matches(_text(c), "[1-57][0-9]{9}")


def birth_date(c: Column, today: Column) -> Column:
    """A date that is not in the future and no more than 120 years back."""
    t = F.trim(c.cast("string"))
    iso = F.try_to_timestamp(F.replace(F.regexp_extract(t, r"^([0-9]{4}[-/][0-9]{2}[-/][0-9]{2})(?:[T ].*)?$", 1), F.lit("/"), F.lit("-")), F.lit("yyyy-MM-dd"))
    day_first = F.try_to_timestamp(F.replace(F.regexp_extract(t, r"^([0-9]{2}[-/][0-9]{2}[-/][0-9]{4})$", 1), F.lit("/"), F.lit("-")), F.lit("dd-MM-yyyy"))
    day = F.coalesce(iso, day_first).cast("date")
    return F.coalesce((day <= today) & (F.add_months(day, 120 * 12) >= today), F.lit(False))


def ip_address(c: Column) -> Column:
    part = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    v6 = "(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:.*[0-9A-Fa-f:])$)(?!.*::.*::)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)"
    return _matches(_text(c), rf"{part}(?:\.{part}){{3}}|{v6}")


#: rule: (category, weight, validator), most specific first; ties are broken in this order.
VALIDATORS = {
    "national_id": ("direct_identifier", 1.0, national_id),
    "iqama": ("direct_identifier", 1.0, iqama),
    "phone": ("direct_identifier", 1.0, mobile),
    "iban": ("financial", 1.0, iban),
    "email": ("direct_identifier", 1.0, email),
    "card_number": ("financial", 1.0, card_number),
    "ip_address": ("direct_identifier", 1.0, ip_address),
    "commercial_registration": ("quasi_identifier", 0.4, commercial_registration),
    "birth_date": ("quasi_identifier", 0.3, lambda c: birth_date(c, F.current_date())),
}


def bound(value: Column, body) -> Column:
    """body(value) with value worked out once: where body names it several times, the plain expression would repeat it."""
    return F.transform(F.array(value), body)[0]


def normalised(c: Column) -> Column:
    """Lower case, without Arabic diacritics, Arabic letter forms unified."""
    plain = F.regexp_replace(c, "[ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۨ-ۭـ]", "")
    return F.lower(F.translate(plain, "أإآٱىة", "اااايه"))


def script_language(c: Column) -> Column:
    """ar or en by the script of most letters; null without letters of either."""
    arabic, latin = F.regexp_count(c, F.lit("[ء-يٱ-ۓ]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when((arabic == 0) & (latin == 0), None).when(arabic >= latin, "ar").otherwise("en")


def pseudonym(c: Column, salt: str) -> Column:
    """Salted SHA-256 in lower-case hex; null stays null. The salt is a run-time argument and is stored nowhere."""
    return F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)


def masked(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("[masked]"))
