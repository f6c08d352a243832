"""Small JSON and key encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airtally.functions.hashes import _c


def list_to_json(col: Column | str) -> Column:
    return F.to_json(_c(col))


def json_to_list(col: Column | str) -> Column:
    return F.from_json(_c(col), "array<string>")


def row_to_json(*columns: Column | str) -> Column:
    """A JSON object without its null fields."""
    return F.to_json(F.struct(*columns))


def clip_key(content_id: Column | str, start_ms: Column | str) -> Column:
    return F.concat(_c(content_id), F.lit(":"), _c(start_ms).cast("string"))


def clip_parts(key: Column | str) -> tuple[Column, Column]:
    """Content and start of a clip key; the start follows the last colon."""
    parts = F.split(_c(key), ":")
    content = F.concat_ws(":", F.slice(parts, 1, F.size(parts) - 1))
    return content, F.try_element_at(parts, F.lit(-1)).try_cast("bigint")
