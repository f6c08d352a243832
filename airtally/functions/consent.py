"""Consent strings, jurisdictions and legal deadlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airtally.functions.hashes import _c

# Jurisdictions, purposes by bit position, special features.
JURISDICTIONS = ("US", "EU", "CA")
PURPOSES = (
    "storage_access",
    "personalization",
    "ad_selection",
    "ad_reporting",
    "content_reporting",
    "personalized_content",
    "market_research",
    "product_improvement",
    "non_essential_cookies",
    "cross_site_tracking",
    "analytics",
    "map_ip_addresses",
    "profile_inferred",
    "content_delivery_network",
)
SPECIAL_FEATURES = ("geo_location", "device_fingerprinting")

PURPOSE_BYTE = 12
MIN_CONSENT_BYTES = 20
US_HOURS = 24
OTHER_HOURS = 72


def decode_consent(text: Column | str) -> Column:
    """Bytes of a URL-safe base64 consent string, null when it cannot be decoded.

    Characters outside the alphabet are skipped, while the padding owed follows
    from the length as received.
    """
    z = _c(text)
    body = F.regexp_replace(F.translate(z, "-_", "+/"), "[^A-Za-z0-9+/]", "")
    owed = (F.lit(4) - F.length(body) % 4) % 4
    present = (F.lit(4) - F.length(z) % 4) % 4 + (
        F.length(z) - F.length(F.replace(z, F.lit("="), F.lit("")))
    )
    padded = F.concat(body, F.repeat(F.lit("="), owed))
    decodable = (F.length(body) % 4 != 1) & (present >= owed)
    return F.when(decodable, F.try_to_binary(padded, F.lit("base64")))


def consent_purposes(data: Column | str) -> Column:
    """Names of the purposes whose bit is set; null when there are no bytes.

    The purpose bytes are read once as a number, missing ones as zero.
    """
    d = _c(data)
    digits = F.rpad(F.hex(F.substring(d, PURPOSE_BYTE + 1, 2)), 4, "0")
    bits = F.conv(digits, 16, 10).cast("bigint")
    named = [
        F.when(F.getbit(bits, F.lit(15 - i)) == 1, F.lit(name)) for i, name in enumerate(PURPOSES)
    ]
    return F.when(F.length(d) > 0, F.array_compact(F.array(*named)))


def consent_vendors() -> Column:
    return F.array().cast("array<string>")


def consent_special_features() -> Column:
    return F.array(*[F.lit(x) for x in SPECIAL_FEATURES])


def is_valid_consent(text: Column | str) -> Column:
    return F.coalesce(F.length(decode_consent(text)) >= MIN_CONSENT_BYTES, F.lit(False))


def has_purpose(purposes: Column | str, name: str) -> Column:
    return F.coalesce(F.array_contains(_c(purposes), name), F.lit(False))


def has_purpose_count(purposes: Column | str, purpose_id: int) -> Column:
    """The literal rule: the id is below the number of purposes granted."""
    return F.coalesce(F.size(_c(purposes)) > purpose_id, F.lit(False))


def has_vendor(vendors: Column | str, vendor_id: int) -> Column:
    return F.coalesce(F.array_contains(_c(vendors), str(vendor_id)), F.lit(False))


def is_jurisdiction(col: Column | str) -> Column:
    return F.coalesce(_c(col).isin(*JURISDICTIONS), F.lit(False))


def deadline(requested: Column | str, jurisdiction: Column | str) -> Column:
    """24 hours for US requests, 72 hours for all others."""
    hours = F.when(_c(jurisdiction) == "US", US_HOURS).otherwise(OTHER_HOURS)
    return _c(requested) + F.make_dt_interval(hours=hours)


def export_expiry(requested: Column | str) -> Column:
    return _c(requested) + F.make_dt_interval(hours=F.lit(OTHER_HOURS))
