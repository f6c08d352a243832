"""Fingerprint hashes: hex text, 64-bit lanes, Hamming distance, bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LANE_BITS = 64
HASH_BITS = 256
HEX64 = "^[a-fA-F0-9]{64}$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_hash(col: Column | str) -> Column:
    """64 hex digits; null counts as malformed."""
    return F.coalesce(_c(col).rlike(HEX64), F.lit(False))


def hex_encode(col: Column | str) -> Column:
    return F.lower(F.hex(_c(col)))


def hex_decode(col: Column | str) -> Column:
    """Bytes of a hex text in either case; null when it is not hex."""
    return F.try_to_binary(_c(col), F.lit("hex"))


def lane(col: Column | str, index: int) -> Column:
    """The index-th group of 16 hex digits as a signed 64-bit number."""
    digits = F.substring(_c(col), 1 + 16 * index, 16)
    return F.conv(digits, 16, -10).cast("bigint")


def lanes(col: Column | str, bits: int = HASH_BITS) -> list[Column]:
    return [lane(col, i) for i in range(bits // LANE_BITS)]


def lanes_to_hex(columns: list[Column]) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in columns]))


def lane_distance(left: list[Column], right: list[Column]) -> Column:
    return reduce(
        lambda a, b: a + b, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(left, right)]
    )


def hamming(left: Column | str, right: Column | str, bits: int = HASH_BITS) -> Column:
    """Differing bits of two hex hashes; hashes of unequal length raise."""
    a, b = _c(left), _c(right)
    distance = lane_distance(lanes(a, bits), lanes(b, bits))
    problem = F.concat(
        F.lit("hash lengths differ: "), F.length(a).cast("string"), F.lit(" and "),
        F.length(b).cast("string"),
    )
    return F.when(F.length(a) != F.length(b), F.raise_error(problem).cast("int")).otherwise(
        distance
    )


def bands(col: Column | str, band_bytes: int = 1, bits: int = HASH_BITS) -> Column:
    """All bands of a hash as an array of (band_index, band_hash)."""
    width = 2 * band_bytes
    text = F.lower(_c(col))
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("band_index"),
                F.substring(text, 1 + width * i, width).alias("band_hash"),
            )
            for i in range(bits // (8 * band_bytes))
        ]
    )


def pieces(lane_columns: list[Column], width: int) -> Column:
    """Every aligned run of `width` bits, keyed by (value, position) in one long.

    A lane gives `64 div width` runs; bits left over at its end are unused. One
    numeric key keeps the join on the fast long-keyed hash table.
    """
    per_lane = LANE_BITS // width
    mask = (1 << width) - 1
    total = per_lane * len(lane_columns)
    keys = []
    for position in range(total):
        shift = LANE_BITS - width * (position % per_lane + 1)
        value = F.shiftrightunsigned(lane_columns[position // per_lane], shift)
        keys.append(value.bitwiseAND(F.lit(mask)) * F.lit(total) + F.lit(position))
    return F.array(*keys)


def first_shared_piece(left: list[Column], right: list[Column], width: int) -> Column:
    """Position of the first piece that two hashes share, null when there is none."""
    per_lane = LANE_BITS // width
    mask = (1 << width) - 1
    apart = [x.bitwiseXOR(y) for x, y in zip(left, right)]
    found = None
    for position in range(per_lane * len(left)):
        shift = LANE_BITS - width * (position % per_lane + 1)
        piece = F.shiftrightunsigned(apart[position // per_lane], shift)
        same = piece.bitwiseAND(F.lit(mask)) == 0
        found = F.when(same, position) if found is None else found.when(same, position)
    return found


def sign_fingerprint(values: Column | str) -> Column:
    """Hex hash whose bit i says whether value i exceeds value i+1.

    The bits run from the most significant down; the last byte is filled up
    with zeros.
    """
    v = _c(values)
    count = F.size(v) - 1
    nibbles = 2 * F.ceil(count / F.lit(8)).cast("int")

    def digit(n: Column) -> Column:
        def bit(offset: int, weight: int) -> Column:
            at = n * 4 + offset
            rises = F.get(v, at) > F.get(v, at + 1)
            return F.when((at < count) & rises, F.lit(weight)).otherwise(F.lit(0))

        number = bit(0, 8) + bit(1, 4) + bit(2, 2) + bit(3, 1)
        return F.lower(F.hex(number.cast("bigint")))

    return F.concat_ws("", F.transform(F.sequence(F.lit(0), nibbles - 1), digit))
