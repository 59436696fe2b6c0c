"""Small value rules: parameters, addresses, labels, cursors."""

from __future__ import annotations

import base64
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: accepted wallet address pattern.
ADDRESS_PATTERN = "^0x[0-9a-fA-F]{40}$"


def clamp_param(value, default, lo, hi):
    """Number clamped to [lo, hi]; zero, blanks and anything that is no number give the default."""
    try:
        number = float(value) if str(value).strip() else math.nan
    except (TypeError, ValueError):
        number = math.nan
    if math.isnan(number) or number == 0:
        number = default
    number = min(max(number, lo), hi)
    return int(number) if float(number).is_integer() else number


def optional_number(value) -> float | None:
    """Threshold parameter: a finite number >= 0, otherwise no threshold."""
    try:
        number = float(value) if str(value).strip() else math.nan
    except (TypeError, ValueError):
        return None
    return number if math.isfinite(number) and number >= 0 else None


def choice_param(value, allowed: list[str], default: str) -> str:
    return value if value in allowed else default


def valid_address(address: Column) -> Column:
    return F.coalesce(address.rlike(ADDRESS_PATTERN), F.lit(False))


def fee_label(fee: Column) -> Column:
    """Fee in hundredths of a basis point as a percentage with two decimals.

    Ties (fee ending in 50) round by the binary double nearest to fee/10000, as a two-decimal
    rendering of that double does; its error against the true quotient is found exactly by
    splitting the double into two halves.
    """
    quotient = fee.cast("double") / F.lit(10000.0)
    spread = quotient * F.lit(134217729.0)
    high = spread - (spread - quotient)
    error = (high * F.lit(10000.0) - fee) + (quotient - high) * F.lit(10000.0)
    rest = F.pmod(fee.cast("long"), F.lit(100))
    up = (rest > 50) | ((rest == 50) & (error >= 0))
    cents = F.floor(fee.cast("long") / F.lit(100)) + F.when(up, 1).otherwise(0)
    return F.concat(
        F.floor(cents / F.lit(100)).cast("string"), F.lit("."),
        F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"), F.lit("%"),
    )


def insider_tag(ratio: Column, analysed: Column) -> Column:
    """'pending' before analysis, '' below 5 %, otherwise the rounded share, marked high from 40 %."""
    share = F.floor(ratio * 100 + F.lit(0.5)).cast("long").cast("string")
    return (
        F.when(~analysed, F.lit("pending"))
        .when(ratio >= 0.4, F.concat(share, F.lit("% insider high")))
        .when(ratio >= 0.05, F.concat(share, F.lit("% insider")))
        .otherwise(F.lit(""))
    )


def token_age_hours(created: Column, token_created: Column) -> Column:
    return (epoch_micros(created) - epoch_micros(token_created)) / F.lit(3.6e9)


def secs_after_launch(first: Column, launch: Column) -> Column:
    seconds = (epoch_micros(first) - epoch_micros(launch)) / F.lit(1e6)
    return F.greatest(F.lit(0), F.floor(seconds + F.lit(0.5))).cast("long")


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def encode_cursor(value, row_id: str, id_field: str = "id") -> str:
    """Opaque page cursor; a NULL metric is written as -1."""
    body = json.dumps({"value": -1 if value is None else value, id_field: row_id}, separators=(",", ":"), ensure_ascii=False)
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode_cursor(cursor: str, id_field: str = "id", text_values: bool = False) -> tuple:
    """(value, id) of a cursor; ValueError when it is malformed."""
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        value, row_id = body["value"], body[id_field]
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError("invalid cursor") from error
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if not (number or (text_values and isinstance(value, str))) or not row_id:
        raise ValueError("invalid cursor")
    return value, row_id
