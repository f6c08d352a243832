"""Confidence, price, reach and share formulas."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from airtally.functions.hashes import _c

# Audience model.
DEFAULT_CONFIDENCE = 0.95
BASE_CPM = 0.10
TOTAL_HOUSEHOLDS = 120_000_000
TOTAL_DEVICES = 50_000_000
IMPRESSIONS_PER_DEVICE = 5
UNFILTERED_CPM = 0.05


def match_confidence(col: Column | str) -> Column:
    return F.least(F.coalesce(_c(col), F.lit(DEFAULT_CONFIDENCE)), F.lit(1.0))


def or_unknown(col: Column | str, word: str = "unknown") -> Column:
    return F.coalesce(_c(col), F.lit(word))


def price(confidence, demand, rarity, base: float = BASE_CPM) -> Column:
    return F.lit(base) * _c(confidence) * _c(demand) * _c(rarity)


def confidence_tier(col: Column | str) -> Column:
    c = _c(col)
    return F.when(c > 0.95, "exact").when(c >= 0.85, "fuzzy").otherwise("none")


def percent_int(part: Column, total: Column, least: int = 1) -> Column:
    """Whole percent, truncated, with a denominator of `least` at least.

    Both numbers are whole, so the result does not hang on the order of a sum.
    """
    return (part * 100 / F.greatest(total, F.lit(least))).cast("int")


def expected_impressions(devices: Column | str) -> Column:
    return _c(devices) * IMPRESSIONS_PER_DEVICE


def reach_percent(devices: Column | str) -> Column:
    return F.least(F.lit(100.0), _c(devices) / F.lit(float(TOTAL_DEVICES)) * 100)


def rule_factor(field: Column | str, values: Column | str) -> Column:
    """Share of the base audience that one rule keeps; `values` is an array.

    A rule with one `dma` value given as plain text keeps the flat share; the
    caller passes a null array for that case.
    """
    f, v = _c(field), _c(values)
    first = F.get(v, F.lit(0))
    return (
        F.when((f == "genre") & (first == "sports"), 0.18)
        .when((f == "genre") & (first == "news"), 0.32)
        .when(f == "genre", 0.22)
        .when((f == "dma") & v.isNotNull(), F.least(F.lit(1.0), F.size(v) * F.lit(0.06)))
        .when(f == "dma", 0.1)
        .when(f == "income", 0.45)
        .when(f == "behavior", 0.09)
        .when(f == "device_type", 0.3)
        .otherwise(0.5)
    )


def combined_factor(factors: Column | str, logic: Column | str) -> Column:
    """All rules: the product. Any rule: one minus the product of complements."""
    f = _c(factors)
    one = F.lit(1.0)
    every = F.aggregate(f, one, lambda acc, x: acc * x)
    some = one - F.aggregate(f, one, lambda acc, x: acc * (one - x))
    return F.when(F.upper(_c(logic)) == "AND", every).otherwise(some)


def modelled_reach(combined: Column | str) -> Column:
    return F.round(F.lit(float(TOTAL_HOUSEHOLDS)) * _c(combined)).cast("bigint")


def modelled_cpm(combined: Column | str) -> Column:
    return F.round(F.least(F.lit(0.95), F.lit(0.05) + (F.lit(1.0) - _c(combined)) * 0.6), 2)


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
