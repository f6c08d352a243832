"""Device, household and network identity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from airtally.functions.hashes import _c

NO_SUBNET = "0.0.0"


def subnet_prefix(ip: Column | str) -> Column:
    """`a.b.c` of a dotted quad; anything else is `0.0.0`."""
    parts = F.split(_c(ip), r"\.", -1)
    prefix = F.concat_ws(".", F.slice(parts, 1, 3))
    return F.when(F.size(parts) == 4, prefix).otherwise(F.lit(NO_SUBNET))


def subnet_network(ip: Column | str) -> Column:
    """`a.b.c.0` when there are three or more parts, else the text unchanged."""
    parts = F.split(_c(ip), r"\.", -1)
    network = F.concat(F.concat_ws(".", F.slice(parts, 1, 3)), F.lit(".0"))
    return F.when(F.size(parts) >= 3, network).otherwise(_c(ip))


def _tag(text: Column) -> Column:
    return F.concat(F.lit("hh_"), F.substring(F.sha2(text, 256), 1, 16))


def household_id_device(device: Column | str, ip: Column | str) -> Column:
    """Household of a device at a subnet. A null device gives null."""
    return _tag(F.concat(_c(device), F.lit("|"), subnet_prefix(ip)))


def household_id_subnet(ip: Column | str) -> Column:
    """Household shared by all devices of a subnet."""
    return _tag(subnet_prefix(ip))


def fallback_household_id(device: Column | str) -> Column:
    return F.substring(F.replace(_c(device), F.lit("-"), F.lit("")), 1, 16)


def stable_device_id(mac, manufacturer, model, salt) -> Column:
    return F.sha2(F.concat_ws("|", _c(mac), _c(manufacturer), _c(model), salt), 256)


def monthly_device_id(device: Column | str, ts: Column | str, prefix: str) -> Column:
    """Identity that rotates with the UTC month of `ts`."""
    salt = F.concat(F.lit(prefix + "-"), F.date_format(_c(ts), "yyyy-MM"))
    return F.sha2(F.concat(_c(device), F.lit(":"), salt), 256)


def pseudonym(device: Column | str) -> Column:
    return F.sha2(_c(device), 256)


def ip_number(ip: Column | str) -> Column:
    """Dotted quad as a number; null when it is not a valid address."""
    parts = F.split(_c(ip), r"\.", -1)
    octets = [F.try_element_at(parts, F.lit(i)).try_cast("bigint") for i in (1, 2, 3, 4)]
    number = (
        octets[0] * (1 << 24) + octets[1] * (1 << 16) + octets[2] * (1 << 8) + octets[3]
    )
    valid = F.size(parts) == 4
    for octet in octets:
        valid = valid & octet.between(0, 255)
    return F.when(valid, number)


def device_and_ip(device_id, ifa, ip_address, device_ip) -> tuple[Column, Column]:
    """A request's own fields come before those of its nested device."""
    return F.coalesce(_c(device_id), _c(ifa)), F.coalesce(_c(ip_address), _c(device_ip))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ip_hex(ip: Column | str) -> Column:
    """An address of either family as 128 bits in 32 hex digits; null when it is not valid.

    Dotted quads are the addresses below ::ffff:0:0, so both spellings of one are equal. `::` stands for one
    group of zeros or more; a dotted quad may stand for the last two groups.
    """

    def digits(number: Column, width: int) -> Column:
        return F.lpad(F.lower(F.hex(number)), width, "0")

    def groups(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":", -1))

    def all_groups(halves: Column) -> Column:
        left = groups(halves[0])
        right = F.when(F.size(halves) == 2, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        return _with(left, lambda x: _with(right, lambda y: F.when(
            F.when(F.size(halves) == 1, F.size(x) == 8).otherwise((F.size(halves) == 2) & (F.size(x) + F.size(y) <= 7)),
            F.concat(x, F.array_repeat(F.lit("0"), 8 - F.size(x) - F.size(y)), y))))

    def joined(parts: Column) -> Column:
        good = F.forall(parts, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(parts, lambda g: F.lpad(g, 4, "0")), ""))

    def six(text: Column) -> Column:
        quad = F.regexp_extract(text, r"([^:]*\.[^:]*)$", 1)
        spelled = _with(quad, lambda q: F.when(q == "", text).otherwise(_with(ip_number(q), lambda n: F.concat(
            F.substring(text, F.lit(1), F.length(text) - F.length(q)),
            F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(65535))))))))
        return _with(F.split(spelled, "::", -1), lambda halves: _with(all_groups(halves), joined))

    def four(text: Column) -> Column:
        return F.concat(F.lit("0" * 20 + "ffff"), digits(ip_number(text), 8))

    return _with(F.lower(_c(ip)), lambda t: F.when(F.instr(t, ":") == 0, four(t)).otherwise(six(t)))
