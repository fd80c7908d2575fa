"""Check-digit rules as Column functions. Each takes a text column and gives a boolean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.spans import let
from veilframe.functions.textforms import WIDE_SPACE

# The weights of each number's check digit.
INN10_WEIGHTS = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_WEIGHTS_FIRST = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_WEIGHTS_SECOND = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
SNILS_WEIGHTS = (9, 8, 7, 6, 5, 4, 3, 2, 1)
SNILS_RESERVED_UP_TO = 1001998
ROUTING_WEIGHTS = (3, 7, 1, 3, 7, 1, 3, 7, 1)
ACCOUNT_WEIGHTS = (7, 1, 3)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def digit(text: Column, pos: int) -> Column:
    """Digit at a one-based position."""
    return F.ascii(F.substring(text, pos, 1)) - 48


def weighted(text: Column, weights: tuple[int, ...], each_mod: int | None = None) -> Column:
    """Weighted sum of the leading digits."""
    def term(c: Column, w: Column) -> Column:
        product = (F.ascii(c) - 48) * w
        return product % each_mod if each_mod else product

    chars = F.slice(F.split(text, ""), 1, len(weights))
    terms = F.zip_with(chars, F.expr(f"array({', '.join(map(str, weights))})"), term)
    return F.aggregate(terms, F.lit(0), lambda acc, x: acc + x)


def valid_luhn(text: Column) -> Column:
    return F.call_function("luhn_check", text)


def snils_control(body: Column) -> Column:
    """Two-digit control number of a nine-digit body."""
    return weighted(body, SNILS_WEIGHTS) % 101 % 100


def valid_snils(text: Column) -> Column:
    return let(digits_of(text), lambda d: F.when(
        F.length(d) == 11,
        (F.substring(d, 1, 9).try_cast("int") > SNILS_RESERVED_UP_TO)
        & (snils_control(d) == digit(d, 10) * 10 + digit(d, 11)),
    ).otherwise(False))


def inn_control(text: Column, weights: tuple[int, ...]) -> Column:
    return weighted(text, weights) % 11 % 10


def valid_inn(text: Column) -> Column:
    return let(digits_of(text), lambda d: F.when(
        F.length(d) == 10, inn_control(d, INN10_WEIGHTS) == digit(d, 10),
    ).when(
        F.length(d) == 12,
        (inn_control(d, INN12_WEIGHTS_FIRST) == digit(d, 11)) & (inn_control(d, INN12_WEIGHTS_SECOND) == digit(d, 12)),
    ).otherwise(False))


def ogrn_control(body: Column, modulus: int) -> Column:
    return body.try_cast("bigint") % modulus % 10


def valid_ogrn(text: Column) -> Column:
    return let(digits_of(text), lambda d: F.when(
        F.length(d) == 13, ogrn_control(F.substring(d, 1, 12), 11) == digit(d, 13),
    ).when(
        F.length(d) == 15, ogrn_control(F.substring(d, 1, 14), 13) == digit(d, 15),
    ).otherwise(False))


def valid_routing(text: Column) -> Column:
    return let(digits_of(text), lambda d: F.when(
        F.length(d) == 9,
        let(weighted(d, ROUTING_WEIGHTS), lambda s: (s > 0) & (s % 10 == 0)),
    ).otherwise(False))


def account_key_total(full: Column) -> Column:
    """Weighted total of the 23-digit string of bank prefix and account."""
    return weighted(full, tuple(ACCOUNT_WEIGHTS[i % 3] for i in range(23)), each_mod=10)


def valid_bank_account(account: Column, bik: Column) -> Column:
    pair = F.struct(digits_of(account).alias("acc"), digits_of(bik).alias("bik"))

    def check(p: Column) -> Column:
        acc, code = p["acc"], p["bik"]
        prefix = F.when(F.startswith(acc, F.lit("301")), F.concat(F.lit("0"), F.substring(code, 5, 2))) \
            .otherwise(F.substring(code, 7, 3))
        return F.when(
            (F.length(acc) == 20) & (F.length(code) == 9),
            account_key_total(F.concat(prefix, acc)) % 10 == 0,
        ).otherwise(False)

    return let(pair, check)


def mod97(text: Column) -> Column:
    """Remainder by 97 of a text of digits and capital letters, letters counting 10 to 35."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda acc, c: F.when(
        c >= "A", (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97))


def valid_iban(text: Column) -> Column:
    clean = F.upper(F.regexp_replace(text, f"[\\s{WIDE_SPACE}-]", ""))
    return let(clean, lambda c: F.when(
        (F.length(c) >= 15) & c.rlike("^[A-Z0-9]+$"),
        mod97(F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))) == 1,
    ).otherwise(False))
