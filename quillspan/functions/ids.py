"""Identifier checks from their published rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import once

CURP_ALPHABET = "0123456789ABCDEFGHIJKLMNÑOPQRSTUVWXYZ"
RFC_ALPHABET = "0123456789ABCDEFGHIJKLMN&OPQRSTUVWXYZ Ñ"


def _place(alphabet: str, text: Column, i: Column) -> Column:
    return F.instr(F.lit(alphabet), F.substr(text, i + 1, F.lit(1))) - 1


def valid_date6(text: Column) -> Column:
    """Six digits are a day of 19yy or 20yy."""
    return F.coalesce(F.try_to_date(F.concat(F.lit("19"), text), "yyyyMMdd"), F.try_to_date(F.concat(F.lit("20"), text), "yyyyMMdd")).isNotNull()


def curp_valid(value: Column) -> Column:
    """Structure, date and check digit of a CURP."""
    total = F.aggregate(F.sequence(F.lit(0), F.lit(16)), F.lit(0), lambda a, i: a + _place(CURP_ALPHABET, value, i) * (18 - i))
    digit = (10 - total % 10) % 10
    return F.coalesce(value.rlike(r"^[A-Z]{4}\d{6}[HMX][A-Z]{5}[0-9A-Z]\d$") & (F.substring(value, 18, 1) == digit.cast("string")) & valid_date6(F.substring(value, 5, 6)), F.lit(False))


def curp_birth(value: Column) -> Column:
    """The date of birth; the 17th character tells the century: a digit 19xx, a letter 20xx."""
    century = F.when(F.substring(value, 17, 1).rlike(r"^\d$"), "19").otherwise("20")
    return F.try_to_date(F.concat(century, F.substring(value, 5, 6)), "yyyyMMdd")


def rfc_structure(value: Column) -> Column:
    start = F.length(value) - 8
    return F.coalesce(value.rlike(r"^[A-ZÑ&]{3,4}\d{6}[0-9A-Z]{2}[0-9A]$") & valid_date6(F.substr(value, start, F.lit(6))), F.lit(False))


def rfc_check(value: Column) -> Column:
    """The check digit of a 12 or 13 character RFC is right (modulus 11)."""
    padded = F.lpad(value, 13, " ")
    total = F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), lambda a, i: a + _place(RFC_ALPHABET, padded, i) * (13 - i))
    digit = (11 - total % 11) % 11
    return F.substring(padded, 13, 1) == F.when(digit == 10, "A").otherwise(digit.cast("string"))


def ssn_valid(value: Column) -> Column:
    area, group, serial = (F.substring(value, *x) for x in ((1, 3), (5, 2), (8, 4)))
    return F.coalesce(
        value.rlike(r"^\d{3}-\d{2}-\d{4}$") & ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000") & ~value.isin("078-05-1120", "457-55-5462", "219-09-9999"),
        F.lit(False),
    )


def itin_valid(value: Column) -> Column:
    group = F.substring(value, 5, 2).cast("int")
    return F.coalesce(value.rlike(r"^9\d{2}-\d{2}-\d{4}$") & (group.between(70, 88) | group.between(90, 92) | group.between(94, 99)), F.lit(False))


def ein_valid(value: Column) -> Column:
    """dd-ddddddd with a prefix that has been given out."""
    prefix = F.substring(value, 1, 2).cast("int")
    given = prefix.between(1, 6) | prefix.between(10, 16) | prefix.between(20, 27) | prefix.between(30, 48) | prefix.between(50, 68)
    given = given | prefix.between(71, 77) | prefix.between(80, 88) | prefix.between(90, 95) | prefix.isin(98, 99)
    return F.coalesce(value.rlike(r"^\d{2}-\d{7}$") & given, F.lit(False))


def sin_valid(value: Column) -> Column:
    """Luhn, and no number that starts with 0 or 8."""
    digits = F.regexp_replace(value, r"[ \-]", "")
    return F.coalesce(digits.rlike(r"^[1-79]\d{8}$") & F.call_function("luhn_check", digits), F.lit(False))


def bn_valid(value: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", F.substring(F.regexp_replace(value, r"\s", ""), 1, 9)), F.lit(False))


def mrz_check(text: Column, weights: tuple[int, int, int] = (7, 3, 1)) -> Column:
    """The check digit of a machine-readable field: weights 7, 3, 1 over digits, letters from 10 and fillers."""
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cycle = F.array(*[F.lit(w) for w in weights])

    def by_character(values: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.length(values) - 1), F.lit(0), lambda a, i: a + _place(alphabet, values, i) * F.get(cycle, i % 3)) % 10

    def total(values: Column) -> Column:
        # Only the last digit of a value counts: characters become digits, and three go into each step.
        def by_three(digits: Column) -> Column:
            part = lambda i, k: F.substr(digits, i + k, F.lit(1)).cast("int") * weights[k - 1]
            return F.aggregate(F.sequence(F.lit(1), F.length(digits) - 2, F.lit(3)), F.lit(0), lambda a, i: a + part(i - 1, 1) + part(i - 1, 2) + part(i - 1, 3)) % 10

        digits = F.concat(F.translate(values, alphabet, "0123456789" * 3 + "012345"), F.lit("00"))
        return F.when(values.rlike(r"^[0-9A-Z]+\z"), once(digits, by_three)).otherwise(by_character(values))

    return once(F.translate(text, "<", "0"), total)
