"""Scalar functions: safe ratios, formats, hashes, escapes, checks of parameters."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model

DASH, MINUS = "—", "−"


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def net(positive: str = "positive", negative: str = "negative", total: str = "total") -> Column:
    """(positive - negative) / total."""
    return ratio(F.col(positive) - F.col(negative), F.col(total))


def net_bucket(value: Column) -> Column:
    """positive above 0.1, negative below -0.1, else neutral; null and NaN are neutral."""
    usual = value.isNotNull() & ~F.isnan(value)
    return F.when(usual & (value > model.BUCKET_ABOVE), "positive").when(usual & (value < -model.BUCKET_ABOVE), "negative").otherwise("neutral")


def dominant(positive: str = "positive", neutral: str = "neutral", negative: str = "negative") -> Column:
    """The label with the most posts; ties go to positive, then neutral."""
    p, u, n = F.col(positive), F.col(neutral), F.col(negative)
    return F.when((p >= u) & (p >= n), "positive").when(u >= n, "neutral").otherwise("negative")


def region(lng: Column) -> Column:
    return F.when(lng < -30, "Americas").when(lng < 60, "Europe-Africa").otherwise("Asia-Pacific")


def fixed(value: Column, digits: int) -> Column:
    """A number's absolute value with so many decimals; ties go up, and a value short of the tie goes down."""
    scale = 10.0**digits
    size = F.abs(value.cast("double"))
    up = F.floor(size * scale + 0.5)
    nearest = F.when((up - 0.5) / scale > size, up - 1).otherwise(up)
    return F.format_string(f"%.{digits}f", nearest / scale)


def percent_text(share: Column) -> Column:
    """One decimal and a percent sign; a dash for null and NaN."""
    return _finite(share, F.concat(F.when(share < 0, "-").otherwise(""), fixed(share * 100, 1), F.lit("%")))


def count_text(n: Column) -> Column:
    """Truncated, with thousands separated; a dash for null and NaN."""
    return _finite(n, F.format_number(F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)), 0))


def net_text(value: Column) -> Column:
    """Two decimals with a sign (a true minus); a dash for null and NaN."""
    return _finite(value, F.concat(F.when(value < 0, MINUS).otherwise("+"), fixed(value, 2)))


def _finite(value: Column, text: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value.cast("double")), DASH).otherwise(text)


def escaped(text: Column) -> Column:
    """Five characters of HTML as references; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(reference))
    return out


def rendered(template: str, values: dict[str, str]) -> str:
    """A template's {tokens} replaced; an unknown token is an error."""

    def value(match: re.Match) -> str:
        if match[1] not in values:
            raise KeyError(f"unknown token {match[1]}")
        return values[match[1]]

    return re.sub(r"\{(\w+)\}", value, template)


def hmac_sha256(key: str, message: Column) -> Column:
    """Keyed hash as a hex string, from two nested digests over the padded key."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


# Parameters are checked on the driver before a plan is built.


def clamped(value: int | str | None, low: int, high: int, default: int) -> int:
    """An integer parameter moved into its range; text that isn't an integer is refused."""
    if value is None:
        return default
    if not re.fullmatch(r"-?\d+", str(value)):
        raise ValueError(f"not an integer: {value!r}")
    return min(high, max(low, int(value)))


def in_range(value: int | str | None, low: int, high: int, default: int) -> int:
    """An integer parameter that must be in its range."""
    if value is None:
        return default
    if not re.fullmatch(r"-?\d+", str(value)) or not low <= int(value) <= high:
        raise ValueError(f"not an integer from {low} to {high}: {value!r}")
    return int(value)


def moment(value: str | None) -> str | None:
    """An ISO date or time, checked."""
    if value is None:
        return None
    datetime.fromisoformat(value)
    return value


def non_blank(value: str | None, name: str) -> str | None:
    if value is not None and (not isinstance(value, str) or not value.strip()):
        raise ValueError(f"{name} must not be blank")
    return value


UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))
