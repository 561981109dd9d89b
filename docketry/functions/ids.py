"""Identifiers and their normal forms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñý"
PLAIN = "aaaaaaeeeeiiiiooooouuuucny"


def digits(c: Column) -> Column:
    """Only the digits 0-9 of a text."""
    return F.regexp_replace(c, "[^0-9]", "")


def case_no_norm(c: Column) -> Column:
    """Case numbers in one form, so that lists match whatever their punctuation."""
    return digits(c.cast("string"))


def name_norm(c: Column) -> Column:
    """Lower case, without accents, blanks squeezed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"\s+", " "))


def key_fingerprint(c: Column) -> Column:
    """The first 8 hexadecimal digits of the SHA-256 of a key."""
    return F.substring(F.sha2(c, 256), 1, 8)


def named(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(c) with c worked out once a row, however often fn names it and wherever the optimizer moves the whole."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def check_digit(number: Column, n: int, more: Column | None = None) -> Column:
    """The public modulus-11 digit over the first n digits, with weights n + 1 down to 2.

    The last of these may be given by itself; number has the others then.
    """
    known = [F.substring(number, i, 1).try_cast("int") for i in range(1, n + (more is None))] + ([] if more is None else [more])
    total = reduce(Column.__add__, [d * (n + 2 - i) for i, d in enumerate(known, 1)])
    return ((total * 10) % 11) % 10


def cpf_valid(c: Column) -> Column:
    """Whether a CPF, with or without punctuation, has 11 digits, not all alike, and right check digits.

    Null gives false.
    """

    def told(d: Column) -> Column:
        shaped = (F.length(d) == 11) & (d != F.repeat(F.substring(d, 1, 1), 11))
        right = (check_digit(d, 9) == F.substring(d, 10, 1).try_cast("int")) & (check_digit(d, 10) == F.substring(d, 11, 1).try_cast("int"))
        return F.coalesce(F.when(shaped, right).otherwise(False), F.lit(False))

    return named(digits(c), told)


def cpf_of(base: Column) -> Column:
    """A whole CPF from its first nine digits."""
    return named(base, lambda b: named(check_digit(b, 9), lambda tenth: F.concat(b, tenth.cast("string"), check_digit(b, 10, tenth).cast("string"))))
