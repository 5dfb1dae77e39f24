"""Probabilities and codes as column expressions, and tables of bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import MAX_ERATE

#: The coefficients of a published rational approximation of the normal integral (error below 7.5e-8).
NORMAL = (0.2316419, 0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
BASES, CODES = "ACGT", "0123"


def normal_cdf(z: Column) -> Column:
    """The share of a standard normal distribution below z."""
    a = F.abs(z)
    t = 1 / (1 + NORMAL[0] * a)
    poly = F.lit(0.0)
    for c in reversed(NORMAL[1:]):
        poly = (poly + c) * t
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def poisson(n: Column, mean: Column) -> Column:
    """The chance of n events (0 to 20) of a Poisson distribution of `mean` > 0; null beyond."""
    return F.when((n >= 0) & (n <= 20) & (mean > 0), F.exp(-mean) * F.pow(mean, n) / F.factorial(n.cast("int")).cast("double"))


def truncated_poisson_mean(mean: Column, steps: int = 60) -> Column:
    """The Poisson mean whose values above zero have this mean (> 1): the fixed point of m = mean * (1 - exp(-m))."""
    m = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), mean.cast("double"), lambda a, _: mean * (1 - F.exp(-a)))
    return F.when(mean > 1, m)


def binomial_bound(errors: int, rate: float, first: int = 1, limit: float = 1e-4, last: int = 10_000) -> int:
    """The least length from `first` on at which more than `errors` errors of `rate` a letter have a chance beyond `limit`.

    A driver's table: the chances of 0 to `errors` errors are carried on from length to length.
    """
    p = [math.comb(first, k) * rate**k * (1 - rate) ** (first - k) for k in range(errors + 1)]
    for n in range(first, last):
        if 1 - sum(p) > limit:
            return n
        p = [p[k] * (1 - rate) + (p[k - 1] * rate if k else 0.0) for k in range(errors + 1)]
    return last


def bound_table(rate: float, most: int, limit: float = 1e-4) -> list[int]:
    """binomial_bound of 0 to `most` errors, rising."""
    out: list[int] = []
    for e in range(most + 1):
        out.append(binomial_bound(e, rate, max(e, out[-1] if out else 1, 1), limit))
    return out


def erate(code: Column) -> Column:
    """The error rate of a 12-bit code."""
    return code / F.lit(10000.0)


def log_code(code: Column) -> Column:
    """A 12-bit error code on a logarithmic scale of 128 steps; 0 for codes up to 1."""
    return F.when(code <= 1, 0).otherwise(F.floor(128 * F.log(F.least(code, F.lit(MAX_ERATE)).cast("double")) / math.log(MAX_ERATE + 1))).cast("int")


def packed(seq: Column) -> Column:
    """Two bits a letter of ACGT, as hexadecimal text of four letters in two digits, with the length before it; other letters are taken as A."""
    plain = F.regexp_replace(F.upper(seq), "[^ACGT]", "A")
    whole = F.rpad(F.translate(plain, BASES, CODES), (F.ceil(F.length(seq) / 4) * 4).cast("int"), F.lit("0"))
    quads = F.when(F.length(seq) > 0, F.regexp_extract_all(whole, F.lit("([0-3]{4})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.length(seq).cast("string"), F.lit(":"), F.array_join(F.transform(quads, lambda q: F.lpad(F.conv(q, 4, 16), 2, "0")), ""))


def unpacked(code: Column) -> Column:
    """The letters that packed() was given."""
    n, body = F.split_part(code, F.lit(":"), F.lit(1)).cast("int"), F.split_part(code, F.lit(":"), F.lit(2))
    pairs = F.when(n > 0, F.regexp_extract_all(body, F.lit("([0-9A-F]{2})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.substring(F.translate(F.array_join(F.transform(pairs, lambda q: F.lpad(F.conv(q, 16, 4), 4, "0")), ""), CODES, BASES), F.lit(1), n)


def valid_fasta(seq: Column) -> Column:
    return seq.rlike("^[ACGTNacgtn]+$")


def feature(value: Column) -> Column:
    """A library feature's text as a boolean: 1, t, true, y, yes in any case; a number is true unless zero; null stays."""
    v = F.lower(F.trim(value))
    return F.when(value.isNull(), F.lit(None).cast("boolean")).otherwise(v.isin("t", "true", "y", "yes") | F.coalesce(F.try_to_number(v, F.lit("9999999999")) != 0, F.lit(False)))


def uid(text: Column) -> Column:
    """A uid's text cut at the first white space or comma; (number, name): digits alone are a number, others a name."""
    first = F.regexp_extract(F.ltrim(text), r"^[^\s,]*", 0)
    number = F.when(first.rlike(r"^\d{1,18}$"), first.cast("long"))
    return F.struct(number.alias("number"), F.when(number.isNull() & (first != ""), first).alias("name"))


def hangs(orient: Column, a_is_first: Column, ahg: Column, bhg: Column) -> tuple[Column, Column, Column]:
    """(flipped, a_hang, b_hang) of an overlap message whose orientation is normal, innie, outtie or anti.

    In the last two the first read is read backwards, so both hangs change place and sign.
    """
    back = orient.isin("outtie", "anti")
    a, b = F.when(back, -bhg).otherwise(ahg), F.when(back, -ahg).otherwise(bhg)
    flipped = orient.isin("innie", "outtie")
    return flipped, F.when(a_is_first, a).otherwise(F.when(flipped, b).otherwise(-a)), F.when(a_is_first, b).otherwise(F.when(flipped, a).otherwise(-b))
