"""Matched viewership made ready for the lake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airtally.functions import identity, times

UNKNOWN_AREA = "00000"
LAKE_COLUMNS = (
    "device_id", "household_id", "content_id", "title", "network", "genre", "watch_date",
    "watch_hour", "duration_minutes", "dma_code", "zip_code", "manufacturer", "model",
    "match_confidence", "watch_start_utc", "duration_sec", "ip_address",
)


def enrich(matched: DataFrame, profiles: DataFrame | None = None,
           household: str = "device") -> DataFrame:
    """Adds household, UTC date and hour, minutes, and area.

    Stateless, so it serves batch and streaming frames alike. `profiles` is an
    optional table (device_id, dma_code, zip_code); devices without one get the
    unknown area. `household` selects the id: 'device' or 'subnet'.
    """
    ids = {
        "device": lambda: identity.household_id_device("device_id", "ip_address"),
        "subnet": lambda: identity.household_id_subnet("ip_address"),
    }
    out = matched.withColumns(
        {
            "household_id": F.coalesce(
                ids[household](), identity.fallback_household_id("device_id")
            ),
            "watch_date": times.utc_date("watch_start_utc"),
            "watch_hour": times.utc_hour("watch_start_utc"),
            "duration_minutes": times.whole_minutes("duration_sec"),
        }
    )
    if profiles is not None:
        out = out.join(profiles.select("device_id", "dma_code", "zip_code"), "device_id", "left")
    else:
        out = out.withColumns(
            {"dma_code": F.lit(None).cast("string"), "zip_code": F.lit(None).cast("string")}
        )
    out = out.withColumns(
        {
            "dma_code": F.coalesce("dma_code", F.lit(UNKNOWN_AREA)),
            "zip_code": F.coalesce("zip_code", F.lit(UNKNOWN_AREA)),
        }
    )
    return out.select(*LAKE_COLUMNS)


def for_segments(viewership: DataFrame, incomes: DataFrame | None = None) -> DataFrame:
    """The columns that segment rules speak of: viewing_date, daypart, income."""
    out = viewership.withColumns(
        {
            "viewing_date": F.to_date("watch_date"),
            "daypart": times.daypart("watch_hour"),
            "genre": F.lower("genre"),
        }
    )
    if incomes is not None:
        out = out.join(incomes.select("device_id", "household_income"), "device_id", "left")
    elif "household_income" not in out.columns:
        out = out.withColumn("household_income", F.lit(None).cast("bigint"))
    return out
