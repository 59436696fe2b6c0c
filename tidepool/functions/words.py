"""256-bit chain words as column expressions.

A 64-digit hex word is held as 11 limbs of 24 bits (the first has 16), most significant first, in
an ARRAY<BIGINT>. Sums stay exact for 2^39 rows per group without any carry handling; ``carried``
brings a summed array back to canonical limbs when it has to be compared or printed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

LIMBS = 11
BASE = 1 << 24
ZERO_WORD = "0" * 64


def word(data: Column, index: int) -> Column:
    """The index-th 32-byte word of 0x-prefixed log data, or NULL when the data is too short."""
    return F.when(F.length(data) >= 2 + 64 * (index + 1), F.substring(data, 3 + 64 * index, 64))


def word_address(w: Column) -> Column:
    """Address in the low 20 bytes of a word (or of a 0x-prefixed topic)."""
    return F.concat(F.lit("0x"), F.lower(F.right(w, F.lit(40))))


def u256_limbs(w: Column) -> Column:
    """Limbs of a word. ``conv`` is the costly part, so it reads two limbs (12 digits) at a time."""
    return limbs_of_chunks(word_chunks(w))


def word_chunks(w: Column) -> list[Column]:
    """The word as one 16-bit and five 48-bit integers."""
    starts = [(1, 4)] + [(5 + 12 * i, 12) for i in range(5)]
    return [F.conv(F.substring(w, at, size), 16, 10).cast("long") for at, size in starts]


def limbs_of_chunks(chunks: list[Column]) -> Column:
    low = F.lit(BASE - 1).cast("long")
    pairs = [part for chunk in chunks[1:] for part in (F.shiftright(chunk, 24), chunk.bitwiseAND(low))]
    return F.array(chunks[0], *pairs)


def is_negative(w: Column) -> Column:
    return F.substring(w, 1, 1) >= F.lit("8")


def magnitude_word(w: Column, negative: Column) -> Column:
    """The word itself, or its one's complement when negative (one short of the absolute value)."""
    return F.when(negative, F.translate(w, "0123456789abcdefABCDEF", "fedcba9876543210543210")).otherwise(w)


def magnitude_limbs(chunks: list[Column], negative: Column) -> Column:
    """Limbs of the absolute value from the chunks of ``magnitude_word``; the missing one goes uncarried to the end."""
    limbs = limbs_of_chunks(chunks)
    one = F.when(negative, 1).otherwise(0).cast("long")
    return F.array(*[limbs[i] for i in range(LIMBS - 1)], limbs[LIMBS - 1] + one)


def i256_abs(w: Column) -> Column:
    """Limbs of the absolute value of a two's-complement word."""
    return magnitude_limbs(word_chunks(magnitude_word(w, is_negative(w))), is_negative(w))


def sum_u256(limbs: Column) -> Column:
    """Aggregate: limb-wise exact sum."""
    return F.array(*[F.sum(limbs[i]) for i in range(LIMBS)])


def carried(limbs: Column) -> Column:
    """Canonical limbs of a summed array; one extra leading limb takes the overflow."""
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("digits"))

    def step(state: Column, limb: Column) -> Column:
        total = state["carry"] + limb
        rest = total.bitwiseAND(F.lit(BASE - 1).cast("long"))
        return F.struct(
            F.shiftright(total, 24).alias("carry"),
            F.concat(F.array(rest), state["digits"]).alias("digits"),
        )

    return F.aggregate(F.reverse(limbs), start, step, lambda s: F.concat(F.array(s["carry"]), s["digits"]))


def limbs_hex(limbs: Column) -> Column:
    """Fixed-width lower-case hex (no prefix): equal-length, so string order is numeric order."""
    digits = F.transform(carried(limbs), lambda d: F.lpad(F.lower(F.hex(d)), 6, "0"))
    return F.array_join(digits, "")


def limbs_double(limbs: Column) -> Column:
    value = limbs[0].cast("double")
    for i in range(1, LIMBS):
        value = value * F.lit(float(BASE)) + limbs[i].cast("double")
    return value


def limbs_number(limbs: Column) -> Column:
    """The double next to a summed array's exact value (halves to even), which ``limbs_double`` may miss by some bits.

    The four leading limbs hold 73 bits or more, and a last bit set for anything below them decides a half.
    """

    def value(d: Column) -> Column:
        first = F.greatest(F.coalesce(F.array_position(F.transform(d, lambda x: x != 0), F.lit(True)).cast("int"), F.lit(0)), F.lit(1))
        at = F.least(first, F.size(d) - 3)
        part = lambda i: F.element_at(d, at + i)
        below = F.slice(d, at + 4, F.greatest(F.size(d) - at - 3, F.lit(0)))
        sticky = F.when(F.exists(below, lambda x: x != 0), 1).otherwise(0).cast("long")
        high, low = part(0) * BASE + part(1), (part(2) * BASE + part(3)).bitwiseOR(sticky)
        scale = F.pow(F.lit(2.0), (24 * (F.size(d) - at - 3)).cast("double"))
        return (high.cast("double") * F.lit(float(BASE * BASE)) + low.cast("double")) * scale

    # A one-element transform, so that the carried digits are made once.
    return F.transform(F.array(carried(limbs)), value)[0]


def exact_total(df: DataFrame, raw: str, when: Column | None = None) -> Column:
    """Aggregate: correctly rounded double of the exact sum of ``raw`` (limbs or BIGINT) over the rows ``when`` holds."""
    kept = F.col(raw) if when is None else F.when(when, F.col(raw))
    if isinstance(df.schema[raw].dataType, ArrayType):
        return limbs_number(F.array(*[F.coalesce(F.sum(kept[i]), F.lit(0)) for i in range(LIMBS)]))
    return F.coalesce(F.sum(kept.cast("decimal(38,0)")), F.lit(0)).cast("double")


def format_units(raw: Column, decimals: Column) -> Column:
    """Raw integer amount over 10^decimals as double."""
    return raw.cast("double") / F.pow(F.lit(10.0), decimals.cast("double"))


def format_units_limbs(limbs: Column, decimals: Column) -> Column:
    return format_units(limbs_double(limbs), decimals)


@F.pandas_udf(StringType())
def units_text(hex_digits: pd.Series, decimals: pd.Series) -> pd.Series:
    """Exact decimal text of a hex amount, at least one fractional digit; for printed rows only."""

    def one(digits: str | None, places: int | None) -> str | None:
        if digits is None or places is None or pd.isna(places):
            return None
        whole, part = divmod(int(digits, 16), 10 ** int(places))
        fraction = str(part).zfill(int(places)).rstrip("0") if places else ""
        return f"{whole}.{fraction or '0'}" if places else str(whole)

    return pd.Series([one(h, d) for h, d in zip(hex_digits, decimals)], dtype=object)
