"""Numbers as text, prefixes and sort keys."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOAT = r"^\s*[+-]?(?:[0-9]+(?:_?[0-9])*\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"
_INT = r"^\s*[+-]?[0-9]+\s*$"


def to_float(value: Column) -> Column:
    """The number that a text stands for as double; null where it stands for none. Suffixes such as 1d are no numbers."""
    return F.when(value.rlike(_FLOAT), F.trim(value).try_cast("double"))


def to_int(value: Column) -> Column:
    """The whole number that a text stands for as long; null where it stands for none."""
    return F.when(value.rlike(_INT), F.trim(value).try_cast("long"))


def numbers_in(text: Column, separators: str, whole: bool = False) -> Column | None:
    """The numbers (long if whole, else double) among the entries of a text, in order, as by to_int and to_float; None for separators that numbers can contain.

    One regular expression, so that it stays within generated code.
    """
    if not separators or re.search(r"[\sA-Za-z0-9_.+-]", separators):
        return None
    body = "[0-9]+" if whole else r"(?:(?:[0-9]+(?:_?[0-9])*\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))"
    ends = "[" + re.escape(separators) + "]"
    found = F.regexp_extract_all(text, F.lit(rf"(?:^|(?<={ends}))\s*[+-]?{body}\s*(?={ends}|\z)"), F.lit(0))
    return found.try_cast("array<long>" if whole else "array<double>")


def is_number(value: Column) -> Column:
    return F.coalesce(to_float(value).isNotNull(), F.lit(False))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body takes it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def apart(value: Column, kind: str) -> Column:
    """value (of the type `kind`) in a projection outside of whole-stage code, that later filters stay behind.

    In whole-stage code all expressions of a stage become one method, and the JVM does not compile methods of more than 8,000 bytes; a
    projection of its own is split. A filter that is moved before a projection takes a copy of each column for each place that uses it.
    The number of the partition, which always passes, and the function of the second branch, which is never evaluated, prevent both.
    """
    return F.when(F.spark_partition_id() >= 0, value).otherwise(F.transform(F.array(F.lit(None).cast(kind)), lambda x: x)[0])


def float_text(value: Column) -> Column:
    """A double as its shortest decimal text: 5.0, 0.0001, 1e-05, 12345678.0, 1e+16; exponents from 16 digits or below 0.0001. The digits are those of the JVM."""

    def layout(v: Column) -> Column:
        plain = v.cast("string")
        digits = F.regexp_replace(F.regexp_extract(plain, r"^-?([0-9.]+)", 1), r"\.", "")
        digits = F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "0+$", "")
        scientific = F.regexp_extract(plain, r"E(-?[0-9]+)$", 1)
        small = F.length(F.regexp_extract(plain, r"^-?0\.(0*)", 1))
        whole = F.length(F.regexp_extract(plain, r"^-?([0-9]+)", 1))
        # The power of ten of the first digit.
        power = F.when(scientific != "", scientific.try_cast("int")).when(F.abs(v) < 1, -small - 1).otherwise(whole - 1)
        parts = F.struct(v.alias("v"), digits.alias("digits"), power.alias("power"), F.length(digits).alias("n"), plain.startswith("-").alias("negative"))
        return bind(parts, render)

    def render(x: Column) -> Column:
        v, digits, power, n = x["v"], x["digits"], x["power"], x["n"]
        fixed = (
            F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
            .when(n <= power + 1, F.concat(digits, F.repeat(F.lit("0"), power + 1 - n), F.lit(".0")))
            .otherwise(F.concat(digits.substr(F.lit(1), power + 1), F.lit("."), digits.substr(power + 2, n)))
        )
        mantissa = F.when(n > 1, F.concat(digits.substr(F.lit(1), F.lit(1)), F.lit("."), digits.substr(F.lit(2), n))).otherwise(digits)
        size = F.abs(power).cast("string")
        exponent = F.concat(F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.when(F.length(size) < 2, F.lpad(size, 2, "0")).otherwise(size))
        text = F.when((power < -4) | (power >= 16), F.concat(mantissa, F.lit("e"), exponent)).otherwise(fixed)
        sign = F.when(x["negative"], F.lit("-")).otherwise(F.lit(""))
        return (
            F.when(v.isNull(), F.lit(None).cast("string")).when(F.isnan(v), F.lit("nan")).when(v == float("inf"), F.lit("inf")).when(v == float("-inf"), F.lit("-inf"))
            .when(v == 0, F.concat(sign, F.lit("0.0"))).otherwise(F.concat(sign, text))
        )

    v = value.cast("double")
    # In this range the JVM lays numbers out alike; the rest is evaluated row by row.
    return F.when((v == 0) | (F.abs(v) >= 1e-3) & (F.abs(v) < 1e7), v.cast("string")).otherwise(bind(v, layout))


def without_chr_letters(chrom: Column) -> Column:
    """chrom without any leading c, h and r."""
    return F.regexp_replace(chrom, "^[chr]+", "")


def without_chr(chrom: Column) -> Column:
    """chrom without a leading chr."""
    return F.regexp_replace(chrom, "^chr", "")


def annotation_chrom(chrom: Column) -> Column:
    """chrom as regions and lookups are keyed: without chr, Chr or CHR; if there is none of these, MT as M."""
    return F.when(chrom.rlike("^(chr|Chr|CHR)"), F.regexp_replace(chrom, "^(chr|Chr|CHR)", "")).when(chrom == "MT", F.lit("M")).otherwise(chrom)


def chromosome_priority(chrom: Column, custom: dict[str, str] | None = None) -> Column:
    """Place of a chromosome in the order of files, as text; custom: places by name, 0 for others."""
    name = without_chr_letters(chrom)
    if custom:
        out = F.lit("0")
        for key, place in custom.items():
            out = F.when(name == key, F.lit(place)).otherwise(out)
        return out
    number = to_int(name)
    return F.when(number < 23, name).when(number.isNotNull(), F.lit("0")).when(name == "X", F.lit("23")).when(name == "Y", F.lit("24")).when(name.isin("MT", "M"), F.lit("25")).otherwise(F.lit("26"))


def natural_key(value: Column) -> Column:
    """A sort key under which runs of digits compare as numbers: chr2 before chr10."""
    return F.transform(F.regexp_extract_all(value, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(x))
