"""Exact arithmetic on 18-decimal and 256-bit numbers, which no Spark decimal holds.

Numbers travel as text; each function is an Arrow-batched UDF over Python integers. Quotients are cut
toward zero. Null in, null out; a quotient by zero is null.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

PLACES = 18
ONE = 10**PLACES
_DECIMAL = re.compile(r"-?\d+(\.\d+)?")


def cut(a: int, b: int) -> int | None:
    """a / b toward zero."""
    if b == 0:
        return None
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def parse(text: str) -> int:
    text = text.strip()
    if not _DECIMAL.fullmatch(text):
        raise ValueError(f"not a decimal number: {text!r}")
    whole, _, part = text.lstrip("-").partition(".")
    value = int(whole) * ONE + int(part[:PLACES].ljust(PLACES, "0"))
    return -value if text[0] == "-" else value


def render(value: int) -> str:
    whole, part = divmod(abs(value), ONE)
    tail = f"{part:018d}".rstrip("0")
    return ("-" if value < 0 else "") + str(whole) + ("." + tail if tail else "")


def from_raw(raw: int, decimals: int) -> int:
    return raw * 10 ** (PLACES - decimals) if decimals <= PLACES else cut(raw, 10 ** (decimals - PLACES))


def fused_price(base: int, quote: int, base_decimals: int, quote_decimals: int, rate: int) -> int | None:
    """Price in dollars, multiplied first and divided once, so that small prices keep their digits."""
    b, q = abs(from_raw(base, base_decimals)), abs(from_raw(quote, quote_decimals))
    return cut(q * rate, b) or None


def reserves_price(r0: int, r1: int, d0: int, d1: int) -> int | None:
    if r0 <= 0 or r1 <= 0:
        return None
    return cut(from_raw(r1, d1) * ONE, from_raw(r0, d0)) or None


def sqrt_price(s: int, d0: int, d1: int) -> int | None:
    """Price from a square root with 96 fractional bits; the power of ten comes after the division where it raises."""
    ratio = s * s * ONE >> 192
    shift = d0 - d1
    return (ratio * 10**shift if shift >= 0 else cut(ratio, 10**-shift)) or None if s > 0 else None


def inverse(price: int) -> int | None:
    return cut(ONE * ONE, price) or None if price > 0 else None


def product(a: int, b: int) -> int | None:
    """Null instead of zero: below the resolution isn't worthless."""
    return cut(a * b, ONE) or None


def quoted_price(sqrt: int | None, r0: int, r1: int, first: bool, base: int, quote: int) -> int | None:
    """Price of the base token in the quote token; null if either side is empty, even where a square root is there."""
    if r0 <= 0 or r1 <= 0:
        return None
    d0, d1 = (base, quote) if first else (quote, base)
    price = reserves_price(r0, r1, d0, d1) if sqrt is None else sqrt_price(sqrt, d0, d1)
    return price if first or price is None else inverse(price)


def _each(f):
    def run(*columns):
        return pd.Series([None if any(x is None or x != x for x in row) else f(*row) for row in zip(*columns)], dtype=object)

    return run


def _text(x: int | None) -> str | None:
    return None if x is None else str(x)


@pandas_udf(StringType())
def scaled_mul(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(lambda x, y: render(cut(parse(x) * parse(y), ONE)))(a, b)


@pandas_udf(StringType())
def scaled_div(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(lambda x, y: None if parse(y) == 0 else render(cut(parse(x) * ONE, parse(y))))(a, b)


@pandas_udf(StringType())
def raw_to_decimal(raw: pd.Series, decimals: pd.Series) -> pd.Series:
    return _each(lambda x, d: render(from_raw(int(x), int(d))))(raw, decimals)


@pandas_udf(StringType())
def fused_usd(base: pd.Series, quote: pd.Series, base_decimals: pd.Series, quote_decimals: pd.Series, rate: pd.Series) -> pd.Series:
    def one(b, q, bd, qd, r):
        price = fused_price(int(b), int(q), int(bd), int(qd), parse(r))
        return None if price is None else render(price)

    return _each(one)(base, quote, base_decimals, quote_decimals, rate)


@pandas_udf(StringType())
def word_unsigned(word: pd.Series) -> pd.Series:
    return _each(lambda w: _text(int(w, 16)))(word)


@pandas_udf(StringType())
def word_signed(word: pd.Series) -> pd.Series:
    """Two's complement of 256 bits."""
    return _each(lambda w: _text(int(w, 16) - ((int(w, 16) >> 255) << 256)))(word)


@pandas_udf(StringType())
def difference(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(lambda x, y: _text(int(x) - int(y)))(a, b)


def _rendered(x: int | None) -> str | None:
    return None if x is None else render(x)


LIMB, LIMBS = 18, 5  # digits of a limb, limbs of a number: 90 digits, more than 256 bits need


def limb_sums(number: Column) -> list[Column]:
    """Exact sums of whole numbers (text of at most 90 digits), limb by limb: native aggregates, combined before they are shuffled."""
    size = F.lpad(F.ltrim(number, F.lit("-")), LIMB * LIMBS, "0")
    sign = F.when(number.startswith("-"), -1).otherwise(1)
    return [F.sum((F.substring(size, 1 + LIMB * i, LIMB).cast("long") * sign).cast("decimal(20,0)")).cast("string").alias(f"_limb{i}") for i in range(LIMBS)]


@pandas_udf(StringType())
def joined(limbs: pd.Series) -> pd.Series:
    """The number whose limb sums these are (array of text); null if any is."""
    return pd.Series([None if row is None or any(x is None for x in row) else str(sum(int(x) * 10 ** (LIMB * (LIMBS - 1 - i)) for i, x in enumerate(row))) for row in limbs], dtype=object)


@pandas_udf(StringType())
def price_of_reserves(r0: pd.Series, r1: pd.Series, d0: pd.Series, d1: pd.Series) -> pd.Series:
    return _each(lambda a, b, x, y: _rendered(reserves_price(int(a), int(b), int(x), int(y))))(r0, r1, d0, d1)


@pandas_udf(StringType())
def price_of_sqrt(s: pd.Series, d0: pd.Series, d1: pd.Series) -> pd.Series:
    return _each(lambda a, x, y: _rendered(sqrt_price(int(a), int(x), int(y))))(s, d0, d1)


@pandas_udf(StringType())
def inverted(price: pd.Series) -> pd.Series:
    """Null at zero; the sign stays."""
    return _each(lambda x: _rendered(cut(ONE * ONE, parse(x))))(price)


@pandas_udf(StringType())
def to_usd(price: pd.Series, rate: pd.Series) -> pd.Series:
    return _each(lambda x, y: _rendered(product(parse(x), parse(y))))(price, rate)


@pandas_udf(StringType())
def market_cap(supply: pd.Series, decimals: pd.Series, price: pd.Series) -> pd.Series:
    """Null without supply."""
    return _each(lambda s, d, p: _rendered(product(from_raw(int(s), int(d)), parse(p))) if int(s) > 0 else None)(supply, decimals, price)


@pandas_udf(StringType())
def liquidity(base: pd.Series, quote: pd.Series, base_decimals: pd.Series, quote_decimals: pd.Series, base_price: pd.Series, quote_price: pd.Series) -> pd.Series:
    """Dollars on both sides; null if either price is."""

    def one(b, q, bd, qd, x, y):
        return render(cut(from_raw(int(b), int(bd)) * parse(x), ONE) + cut(from_raw(int(q), int(qd)) * parse(y), ONE))

    return _each(one)(base, quote, base_decimals, quote_decimals, base_price, quote_price)


@pandas_udf(StringType())
def price_in_quote(sqrt: pd.Series, r0: pd.Series, r1: pd.Series, first: pd.Series, base_decimals: pd.Series, quote_decimals: pd.Series) -> pd.Series:
    """``quoted_price`` of a pool's state; sqrt is null for pools of reserves."""
    whole = _each(lambda s, a, b, f, x, y: _rendered(quoted_price(int(s) if s else None, int(a), int(b), bool(f), int(x), int(y))))
    return whole(sqrt.fillna(""), r0, r1, first, base_decimals, quote_decimals)
