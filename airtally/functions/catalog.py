"""The same functions by name, for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFINITIONS = (
    """CREATE OR REPLACE TEMPORARY FUNCTION hash_lane(h STRING, k INT) RETURNS BIGINT
       RETURN cast(conv(substr(h, 1 + 16 * k, 16), 16, -10) AS BIGINT)""",
    """CREATE OR REPLACE TEMPORARY FUNCTION hamming(a STRING, b STRING) RETURNS INT
       RETURN bit_count(hash_lane(a, 0) ^ hash_lane(b, 0)) + bit_count(hash_lane(a, 1) ^ hash_lane(b, 1))
            + bit_count(hash_lane(a, 2) ^ hash_lane(b, 2)) + bit_count(hash_lane(a, 3) ^ hash_lane(b, 3))""",
    """CREATE OR REPLACE TEMPORARY FUNCTION subnet_prefix(ip STRING) RETURNS STRING
       RETURN CASE WHEN size(split(ip, '\\\\.', -1)) = 4
                   THEN concat_ws('.', slice(split(ip, '\\\\.', -1), 1, 3)) ELSE '0.0.0' END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION household_id(device STRING, ip STRING) RETURNS STRING
       RETURN concat('hh_', substr(sha2(concat(device, '|', subnet_prefix(ip)), 256), 1, 16))""",
    """CREATE OR REPLACE TEMPORARY FUNCTION daypart(hour INT) RETURNS STRING
       RETURN CASE WHEN hour BETWEEN 6 AND 11 THEN 'morning' WHEN hour BETWEEN 12 AND 17 THEN 'afternoon'
                   WHEN hour BETWEEN 18 AND 22 THEN 'primetime' WHEN hour IS NOT NULL THEN 'latenight' END""",
)


def register(spark: SparkSession) -> None:
    for statement in DEFINITIONS:
        spark.sql(statement)
