"""Queries over audience segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from airtally.functions import codec, scoring
from airtally.operators import segments as sg
from airtally.plans import domain as d
from airtally.plans.registry import query
from airtally.session import saved

AS_OF = "2024-01-31"

SEGMENTS = (
    sg.Segment("seg_and", "Economy in primetime", (
        sg.Rule("watched_genre", ("economy",), "eq"), sg.Rule("daypart", ("primetime",), "eq"))),
    sg.Segment("seg_or", "Promo or early brands", (
        sg.Rule("watched_genre", ("promo", "small")), sg.Rule("watched_network", ("Brand#1", "Brand#2"))),
        "OR", 10),
    sg.Segment("seg_income", "High income mornings", (
        sg.Rule("household_income", ("60000",), "gte"), sg.Rule("daypart", ("morning", "afternoon"))),
        "AND", 20),
    sg.Segment("seg_area", "Some areas", (
        sg.Rule("dma", ("100", "101", "102", "103", "104")),), "AND", 7),
    sg.Segment("seg_night", "Late night or low income", (
        sg.Rule("daypart", ("latenight",), "eq"), sg.Rule("household_income", ("20000",), "lte")),
        "OR", 14),
)

# The same five definitions as SQL conditions.
_CONDITIONS = {
    "seg_and": ("genre = 'economy' AND daypart = 'primetime'", 30),
    "seg_or": ("genre IN ('promo', 'small') OR network IN ('Brand#1', 'Brand#2')", 10),
    "seg_income": ("household_income >= 60000 AND daypart IN ('morning', 'afternoon')", 20),
    "seg_area": ("dma_code IN ('100', '101', '102', '103', '104')", 7),
    "seg_night": ("daypart = 'latenight' OR household_income <= 20000", 14),
}


def _where(name: str, as_of: str = AS_OF) -> str:
    condition, days = _CONDITIONS[name]
    return f"({condition}) AND viewing_date >= DATE '{as_of}' - INTERVAL {days} DAY"


def _members_cte(name: str = "members", as_of: str = AS_OF) -> str:
    parts = "\nUNION ALL ".join(
        f"SELECT DISTINCT '{s}' AS segment_id, household_id, device_id FROM viewership_enriched "
        f"WHERE viewing_date <= DATE '{as_of}' AND {_where(s, as_of)}"
        for s in _CONDITIONS
    )
    return f", {name} AS ({parts})"


_M = d.views("viewership_enriched") + _members_cte()


def as_of(text: str = AS_OF):
    return F.lit(text).cast("date")


def members(spark, sf, day: str = AS_OF):
    known = d.viewership_enriched(spark, sf).filter(F.col("viewing_date") <= as_of(day))
    return sg.populations(known, SEGMENTS, as_of(day))


@query("segment_and_rules", d.views("viewership_enriched") + f"""
SELECT DISTINCT household_id, device_id, 'seg_and' AS segment_id FROM viewership_enriched WHERE {_where('seg_and')}""")
def segment_and_rules(spark, sf):
    return sg.population(d.viewership_enriched(spark, sf), SEGMENTS[0], as_of())


@query("segment_or_rules", d.views("viewership_enriched") + f"""
SELECT DISTINCT household_id, device_id, 'seg_or' AS segment_id FROM viewership_enriched WHERE {_where('seg_or')}""")
def segment_or_rules(spark, sf):
    return sg.population(d.viewership_enriched(spark, sf), SEGMENTS[1], as_of())


@query("segment_or_literal", d.views("viewership_enriched") + f"""
SELECT DISTINCT household_id, device_id FROM viewership_enriched
WHERE genre IN ('promo', 'small') OR network IN ('Brand#1', 'Brand#2') AND viewing_date >= DATE '{AS_OF}' - INTERVAL 10 DAY""")
def segment_or_literal(spark, sf):
    v = d.viewership_enriched(spark, sf)
    rows = v.filter(sg.literal_condition(SEGMENTS[1], as_of()))
    return rows.select("household_id", "device_id").distinct()


@query("segment_extended_rules", d.views("viewership_enriched") + f"""
SELECT DISTINCT household_id, device_id FROM viewership_enriched
WHERE household_income BETWEEN 30000 AND 80000 AND genre IN ('economy', 'standard')
  AND viewing_date >= DATE '{AS_OF}' - INTERVAL 30 DAY""")
def segment_extended_rules(spark, sf):
    rules = (
        sg.rule_from({"field": "income", "op": "between", "value": ["30000", "80000"]}),
        sg.rule_from({"field": "genre", "op": "in", "value": ["Economy", "Standard"]}),
    )
    segment = sg.Segment("seg_x", "Middle income", rules, extended=True)
    members_ = sg.population(d.viewership_enriched(spark, sf), segment, as_of())
    return members_.drop("segment_id")


@query("segments_one_pass", _M + " SELECT * FROM members")
def segments_one_pass(spark, sf):
    return members(spark, sf)


@query("segment_sizes", _M + """
SELECT segment_id, count(DISTINCT device_id) AS device_count, count(DISTINCT household_id) AS household_count FROM members GROUP BY 1""")
def segment_sizes(spark, sf):
    return sg.sizes(members(spark, sf))


@query("segment_sizes_sampled", _M + """, sample AS (SELECT DISTINCT segment_id, device_id FROM members
    WHERE CAST('0x' || substr(sha256(device_id), 1, 8) AS BIGINT) % 8 = 0),
c AS (SELECT segment_id, count(*) AS sample_size FROM sample GROUP BY 1)
SELECT segment_id, sample_size, sample_size * 8 AS estimated_size,
       greatest(0.0, floor(sample_size * 8 - 1.96 * sqrt(sample_size * 0.875) * 8)) AS low,
       ceil(sample_size * 8 + 1.96 * sqrt(sample_size * 0.875) * 8) AS high FROM c""")
def segment_sizes_sampled(spark, sf):
    return sg.sampled_sizes(members(spark, sf), 8)


@query("segment_engaged_devices", d.views("viewership_enriched") + """, weekly AS (
  SELECT device_id, date_trunc('week', viewing_date) AS week, sum(duration_minutes) / 60.0 AS h FROM viewership_enriched GROUP BY 1, 2)
SELECT device_id, count(*) AS weeks FROM weekly WHERE h >= 1.5 GROUP BY 1""")
def segment_engaged_devices(spark, sf):
    return sg.engaged(d.viewership_enriched(spark, sf), 1.5)


HOURS_SEGMENTS = (
    sg.Segment("seg_hours_and", "Hours of economy and any promo", (
        sg.Rule("watched_genre", ("economy",), "eq", 0.5), sg.Rule("watched_genre", ("promo",), "eq")),
        "AND", 60),
    sg.Segment("seg_hours_or", "Hours of areas or night owls", (
        sg.Rule("dma", ("99", "400"), "between", 1.0), sg.Rule("daypart", ("latenight",), "eq")), "OR", 25),
    sg.Segment("seg_plain", "Just promo", (sg.Rule("watched_genre", ("promo",), "eq"),), "AND", 5),
)


@query("segment_hours_rules", d.views("viewership_enriched") + f""", weekly AS (
  SELECT household_id, device_id, date_trunc('week', viewing_date) AS week,
    coalesce(sum(duration_minutes) FILTER (genre = 'economy' AND viewing_date >= DATE '{AS_OF}' - INTERVAL 60 DAY), 0) >= 30 AS economy,
    bool_or(genre = 'promo' AND viewing_date >= DATE '{AS_OF}' - INTERVAL 60 DAY) AS promo,
    coalesce(sum(duration_minutes) FILTER (CAST(dma_code AS INT) BETWEEN 99 AND 400 AND viewing_date >= DATE '{AS_OF}' - INTERVAL 25 DAY), 0) >= 60 AS area,
    bool_or(daypart = 'latenight' AND viewing_date >= DATE '{AS_OF}' - INTERVAL 25 DAY) AS night
  FROM viewership_enriched WHERE viewing_date <= DATE '{AS_OF}' GROUP BY 1, 2, 3),
truths AS (SELECT household_id, device_id, bool_or(economy) AS economy, bool_or(promo) AS promo, bool_or(area) AS area, bool_or(night) AS night
  FROM weekly GROUP BY 1, 2)
SELECT 'seg_hours_and' AS segment_id, household_id, device_id FROM truths WHERE economy AND promo
UNION ALL SELECT 'seg_hours_or', household_id, device_id FROM truths WHERE area OR night
UNION ALL SELECT DISTINCT 'seg_plain', household_id, device_id FROM viewership_enriched
  WHERE genre = 'promo' AND viewing_date BETWEEN DATE '{AS_OF}' - INTERVAL 5 DAY AND DATE '{AS_OF}'""")
def segment_hours_rules(spark, sf):
    """Rules with hours per week, with AND and with OR, beside one without."""
    views = d.viewership_enriched(spark, sf).filter(F.col("viewing_date") <= as_of())
    return sg.populations(views, HOURS_SEGMENTS, as_of()).select("segment_id", "household_id", "device_id")


@query("device_segment_index", _M + """
SELECT device_id, string_agg(segment_id, ',' ORDER BY segment_id) AS segment_ids
FROM (SELECT DISTINCT device_id, segment_id FROM members) GROUP BY 1""")
def device_segment_index(spark, sf):
    index = sg.device_index(members(spark, sf))
    return index.select("device_id", F.concat_ws(",", "segment_ids").alias("segment_ids"))


@query("device_segment_json", _M + """
SELECT device_id, '["' || string_agg(segment_id, '","' ORDER BY segment_id) || '"]' AS segments, count(*) AS n
FROM (SELECT DISTINCT device_id, segment_id FROM members) GROUP BY 1""")
def device_segment_json(spark, sf):
    index = sg.device_index(members(spark, sf)).withColumn(
        "segments", codec.list_to_json("segment_ids")
    )
    return index.select(
        "device_id", "segments", F.size(codec.json_to_list("segments")).cast("bigint").alias("n")
    )


_OVERLAP_IDS = ("seg_or", "seg_income", "seg_night")


@query("segment_intersection", _M + """
SELECT count(*) AS members FROM (SELECT device_id FROM members WHERE segment_id IN ('seg_or', 'seg_income', 'seg_night')
  GROUP BY 1 HAVING count(DISTINCT segment_id) = 3)""")
def segment_intersection(spark, sf):
    return sg.intersection_size(members(spark, sf), _OVERLAP_IDS)


@query("segment_overlap_report", _M + """, flags AS (SELECT device_id, max(CASE WHEN segment_id = 'seg_or' THEN 1 ELSE 0 END) AS a,
    max(CASE WHEN segment_id = 'seg_income' THEN 1 ELSE 0 END) AS b, max(CASE WHEN segment_id = 'seg_night' THEN 1 ELSE 0 END) AS c
  FROM members WHERE segment_id IN ('seg_or', 'seg_income', 'seg_night') GROUP BY 1),
t AS (SELECT count(*) FILTER (a + b + c = 3) AS overlap_size, count(*) AS union_size, CAST(sum(a) AS BIGINT) AS sa, CAST(sum(b) AS BIGINT) AS sb,
    CAST(sum(c) AS BIGINT) AS sc, count(*) FILTER (a = 1 AND a + b + c = 1) AS ua, count(*) FILTER (b = 1 AND a + b + c = 1) AS ub,
    count(*) FILTER (c = 1 AND a + b + c = 1) AS uc FROM flags),
p AS (SELECT *, round(overlap_size * 100.0 / least(sa, sb, sc)::DOUBLE, 4) AS overlap_percentage FROM t)
SELECT overlap_size, union_size, overlap_percentage, 'seg_or' AS segment_id, sa AS size, ua AS unique_size FROM p
UNION ALL SELECT overlap_size, union_size, overlap_percentage, 'seg_income', sb, ub FROM p
UNION ALL SELECT overlap_size, union_size, overlap_percentage, 'seg_night', sc, uc FROM p""")
def segment_overlap_report(spark, sf):
    report = sg.overlap(members(spark, sf), _OVERLAP_IDS)
    return report.withColumn("overlap_percentage", F.round("overlap_percentage", 4))


@query("segment_set_operations", _M + """, a AS (SELECT DISTINCT device_id FROM members WHERE segment_id = 'seg_or'),
b AS (SELECT DISTINCT device_id FROM members WHERE segment_id = 'seg_income')
SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS union_size,
       (SELECT count(*) FROM a WHERE device_id IN (SELECT device_id FROM b)) AS common_size,
       (SELECT count(*) FROM a WHERE device_id NOT IN (SELECT device_id FROM b)) AS only_first,
       (SELECT count(*) FROM b WHERE device_id NOT IN (SELECT device_id FROM a)) AS only_second""")
def segment_set_operations(spark, sf):
    return sg.set_sizes(members(spark, sf), "seg_or", "seg_income")


@query("segment_set_members", _M + """, a AS (SELECT DISTINCT device_id FROM members WHERE segment_id = 'seg_or'),
b AS (SELECT DISTINCT device_id FROM members WHERE segment_id = 'seg_income')
SELECT device_id, 'either' AS kind FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT device_id, 'both' FROM a WHERE device_id IN (SELECT device_id FROM b)
UNION ALL SELECT device_id, 'only_first' FROM a WHERE device_id NOT IN (SELECT device_id FROM b)
UNION ALL SELECT device_id, 'only_second' FROM b WHERE device_id NOT IN (SELECT device_id FROM a)""")
def segment_set_members(spark, sf):
    """The same four sets as lists of members."""
    both = saved(members(spark, sf).filter(F.col("segment_id").isin("seg_or", "seg_income")).select(
        "segment_id", "device_id").distinct(), "sets")
    a = both.filter(F.col("segment_id") == "seg_or").select("device_id")
    b = both.filter(F.col("segment_id") == "seg_income").select("device_id")
    sets = {
        "either": sg.add_members(a, b), "both": sg.contains(a, b, ["device_id"]),
        "only_first": sg.only_in(a, b), "only_second": sg.remove_members(b, a, ["device_id"]),
    }
    named = [f.select("device_id", F.lit(kind).alias("kind")) for kind, f in sets.items()]
    return reduce(lambda x, y: x.unionByName(y), named)


_NOW = "1998-09-01"


@query("definitions_on_date", f"""WITH c AS (SELECT 'seg-' || (o_custkey % 60) AS segment_id, CAST(o_orderdate AS DATE) AS d, o_orderkey AS v,
  o_orderkey % 1009 = 0 AS gone FROM orders),
ends AS (SELECT segment_id, min(d) AS archived_on FROM c WHERE gone GROUP BY 1),
ver AS (SELECT segment_id, d, max(v) AS v FROM c LEFT JOIN ends USING (segment_id)
  WHERE archived_on IS NULL OR (d < archived_on AND archived_on + INTERVAL 90 DAY >= DATE '{_NOW}') GROUP BY 1, 2),
asked AS (SELECT 'seg-' || (l_suppkey % 60) AS segment_id, CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1, 2),
found AS (SELECT k.segment_id, k.d, k.n, ver.v FROM asked k ASOF LEFT JOIN ver ON k.segment_id = ver.segment_id AND k.d >= ver.d)
SELECT f.segment_id, CASE WHEN e.archived_on <= f.d THEN NULL ELSE f.v END AS version, CAST(sum(f.n) AS BIGINT) AS views
FROM found f LEFT JOIN ends e ON f.segment_id = e.segment_id GROUP BY 1, 2""")
def definitions_on_date(spark, sf):
    """Views by the version of the segment's definition that held on their day; some segments were
    archived, some of these longer ago than history is kept."""
    changes = d.table(spark, sf, "orders").select(
        F.concat(F.lit("seg-"), F.col("o_custkey") % 60).alias("segment_id"),
        F.col("o_orderdate").cast("date").alias("changed_on"), F.col("o_orderkey").alias("version"),
        F.when(F.col("o_orderkey") % 1009 == 0, "archived").otherwise("active").alias("status"))
    views = d.table(spark, sf, "lineitem").select(
        F.concat(F.lit("seg-"), F.col("l_suppkey") % 60).alias("segment_id"),
        F.col("l_shipdate").cast("date").alias("day"))
    versions = sg.definition_versions(changes, as_of(_NOW))
    return sg.version_on(views, versions, "day").groupBy("segment_id", "version").agg(
        F.count(F.lit(1)).alias("views"))


@query("segment_transitions", d.views("viewership_enriched") + _members_cte("today") + _members_cte("earlier", "2024-01-04") + """,
t AS (SELECT DISTINCT segment_id, device_id FROM today), e AS (SELECT DISTINCT segment_id, device_id FROM earlier)
SELECT coalesce(t.segment_id, e.segment_id) AS segment_id, coalesce(t.device_id, e.device_id) AS device_id,
       CASE WHEN e.device_id IS NULL THEN 'segment_entry' ELSE 'segment_exit' END AS event_type
FROM t FULL JOIN e ON t.segment_id = e.segment_id AND t.device_id = e.device_id WHERE t.device_id IS NULL OR e.device_id IS NULL""")
def segment_transitions(spark, sf):
    return sg.transitions(members(spark, sf, "2024-01-04"), members(spark, sf))


_LOOKUP = _M + """, by_device AS (SELECT device_id, list(segment_id ORDER BY segment_id) AS ids
    FROM (SELECT DISTINCT device_id, segment_id FROM members WHERE segment_id <> 'seg_or') GROUP BY 1),
ip_households AS (SELECT DISTINCT regexp_extract(ip_address, '^([0-9]+[.][0-9]+[.][0-9]+)[.]', 1) || '.0' AS subnet, household_id FROM viewership),
by_subnet AS (SELECT subnet, list(segment_id ORDER BY segment_id)[1:2] AS ids FROM
    (SELECT DISTINCT subnet, segment_id FROM ip_households JOIN members USING (household_id)) GROUP BY 1),
requests AS (SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'x' || device_id END AS device_id,
    CASE WHEN event_id % 2 = 0 THEN device_id END AS ifa, ip_address FROM fingerprints),
asked AS (SELECT request_id, coalesce(device_id, ifa) AS device_id, regexp_extract(ip_address, '^([0-9]+[.][0-9]+[.][0-9]+)[.]', 1) || '.0' AS subnet FROM requests),
found AS (SELECT a.*, d.ids AS own, s.ids AS other FROM asked a LEFT JOIN by_device d USING (device_id) LEFT JOIN by_subnet s USING (subnet))"""


def lookup(spark, sf):
    m = members(spark, sf)
    v = d.viewership_enriched(spark, sf)
    from airtally.functions.identity import subnet_network

    subnets = v.select(subnet_network("ip_address").alias("subnet"), "household_id")
    f = d.fingerprints(spark, sf)
    eid = F.col("event_id")
    requests = f.select(
        eid.alias("request_id"),
        F.when(eid % 3 != 0, F.concat(F.lit("x"), F.col("device_id"))).alias("device_id"),
        F.when(eid % 2 == 0, F.col("device_id")).alias("ifa"),
        F.lit(None).cast("string").alias("ip_address"),
        F.col("ip_address").alias("device_ip"),
    )
    by_device = sg.device_index(m.filter(F.col("segment_id") != "seg_or"))
    return sg.lookup(requests, by_device, sg.subnet_index(m, subnets, 2))


@query("rtb_lookup_fallback", _LOOKUP + """
SELECT request_id, coalesce(device_id, 'unknown') AS device_id,
       CASE WHEN len(own) > 0 THEN 'device_hash' WHEN len(other) > 0 THEN 'ip_household' ELSE '' END AS source,
       CASE WHEN len(own) > 0 THEN array_to_string(own, ',') WHEN len(other) > 0 THEN array_to_string(other, ',') ELSE '' END AS segments,
       coalesce(len(own) > 0, false) OR coalesce(len(other) > 0, false) AS cache_hit FROM found""")
def rtb_lookup_fallback(spark, sf):
    return lookup(spark, sf).select(
        "request_id", "device_id",
        F.coalesce(F.get("matched_segments", F.lit(0))["source"], F.lit("")).alias("source"),
        F.concat_ws(",", F.transform("matched_segments", lambda s: s["segment_id"])).alias("segments"),
        "cache_hit",
    )


@query("reach_estimate", _M + """, s AS (SELECT segment_id, count(DISTINCT device_id) AS device_count FROM members GROUP BY 1)
SELECT segment_id, device_count, device_count * 5 AS impressions,
       round(least(100.0::DOUBLE, device_count / 50000000.0::DOUBLE * 100), 8) AS reach_percent FROM s""")
def reach_estimate(spark, sf):
    estimate = sg.reach_estimate(sg.sizes(members(spark, sf)))
    return estimate.withColumn("reach_percent", F.round("reach_percent", 8))


def _definitions(spark, sf):
    """One definition per part: its type, size and brand serve as rules."""
    p = d.table(spark, sf, "part")
    genre = F.when(F.col("p_partkey") % 3 == 0, "sports").when(F.col("p_partkey") % 3 == 1, "news").otherwise(F.lower("p_type"))
    dmas = F.transform(F.sequence(F.lit(1), F.col("p_size") % 20 + 1), lambda i: i.cast("string"))
    third = F.element_at(
        F.array(*[F.lit(x) for x in ("income", "behavior", "device_type", "other")]),
        (F.col("p_partkey") % 4 + 1).cast("int"),
    )
    rule = lambda f, v: F.struct(f.alias("field"), v.alias("values"))
    return p.select(
        F.concat(F.lit("def-"), F.col("p_partkey")).alias("segment_id"),
        F.when(F.col("p_partkey") % 2 == 0, "and").otherwise("or").alias("logic"),
        F.array(
            rule(F.lit("genre"), F.array(genre)), rule(F.lit("dma"), dmas),
            rule(third, F.array(F.lit("any"))),
        ).alias("rules"),
    )


@query("reach_cpm_model", """WITH f AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0.18 WHEN 1 THEN 0.32 ELSE 0.22 END::DOUBLE AS a,
    least(1.0::DOUBLE, (p_size % 20 + 1) * 0.06::DOUBLE) AS b,
    CASE p_partkey % 4 WHEN 0 THEN 0.45 WHEN 1 THEN 0.09 WHEN 2 THEN 0.3 ELSE 0.5 END::DOUBLE AS c FROM part),
g AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1.0::DOUBLE * a * b * c
    ELSE 1.0::DOUBLE - 1.0::DOUBLE * (1.0::DOUBLE - a) * (1.0::DOUBLE - b) * (1.0::DOUBLE - c) END AS combined FROM f)
SELECT 'def-' || p_partkey AS segment_id, CAST(round(120000000.0::DOUBLE * combined) AS BIGINT) AS reach,
       round(least(0.95::DOUBLE, 0.05::DOUBLE + (1.0::DOUBLE - combined) * 0.6::DOUBLE), 2) AS cpm FROM g""")
def reach_cpm_model(spark, sf):
    return sg.reach_model(_definitions(spark, sf)).drop("combined")


@query("reach_by_daypart", _M + """, seen AS (SELECT DISTINCT device_id, daypart FROM viewership_enriched),
who AS (SELECT DISTINCT segment_id, device_id FROM members)
SELECT segment_id, count(*) FILTER (daypart = 'morning') AS morning, count(*) FILTER (daypart = 'afternoon') AS afternoon,
       count(*) FILTER (daypart = 'primetime') AS primetime, count(*) FILTER (daypart = 'latenight') AS latenight
FROM who JOIN seen USING (device_id) GROUP BY 1""")
def reach_by_daypart(spark, sf):
    return sg.reach_by_daypart(members(spark, sf), d.viewership_enriched(spark, sf))


@query("segment_definition_checks", """WITH t AS (SELECT p_partkey, p_name AS name, p_size, p_retailprice FROM part)
SELECT p_partkey AS id, CASE WHEN length(substr(name, 1, 1 + CAST(p_partkey % 12 AS INT))) < 3 THEN 'name'
  WHEN p_size % 25 NOT BETWEEN 1 AND 20 THEN 'rule_count' WHEN p_partkey % 5 = 0 THEN 'logic'
  WHEN p_size * 2 NOT BETWEEN 1 AND 90 THEN 'lookback' WHEN p_partkey % 7 = 0 THEN 'cpm_floor'
  WHEN p_partkey % 11 = 0 THEN 'rule_type' END AS problem FROM t""")
def segment_definition_checks(spark, sf):
    """A definition per part, with every kind of mistake among them."""
    p = d.table(spark, sf, "part")
    key = F.col("p_partkey")
    kind = F.when(key % 11 == 0, "watched_moon").otherwise("dma")
    rules = F.when(F.col("p_size") % 25 == 0, F.array().cast("array<struct<type:string>>")).otherwise(
        F.array_repeat(F.struct(kind.alias("type")), F.col("p_size") % 25)
    )
    definitions = p.select(
        key.alias("id"),
        F.substring(F.col("p_name"), F.lit(1), (key % 12 + 1).cast("int")).alias("name"),
        rules.alias("rules"),
        F.when(key % 5 == 0, "XOR").otherwise("AND").alias("logic"),
        (F.col("p_size") * 2).alias("lookback_days"),
        F.when(key % 7 == 0, 0.05).otherwise(0.5).alias("minimum_cpm_floor"),
    )
    return definitions.select("id", sg.definition_problem().alias("problem"))


@query("nightly_summary", _M + """
SELECT segment_id, count(DISTINCT household_id) AS households FROM members GROUP BY ROLLUP (segment_id)""")
def nightly_summary(spark, sf):
    return sg.nightly_summary(members(spark, sf))


@query("segment_refresh_events", _M + f"""
SELECT segment_id, '{{"event_type":"segment.populated","timestamp":"{AS_OF}","data":{{"segment_id":"' || segment_id
  || '","estimated_size":' || count(DISTINCT device_id) || ',"updated_at":"{AS_OF}"}}}}' AS payload FROM members GROUP BY 1""")
def segment_refresh_events(spark, sf):
    return sg.refresh_events(sg.sizes(members(spark, sf)), F.lit(AS_OF))


@query("campaign_matches", _M + """
SELECT event_id, device_id, content_id, watch_start_utc FROM viewership_enriched
WHERE device_id IN (SELECT device_id FROM members WHERE segment_id = 'seg_income')
ORDER BY watch_start_utc DESC, event_id LIMIT 50""")
def campaign_matches(spark, sf):
    m = members(spark, sf)
    campaign = m.select("segment_id").filter(F.col("segment_id") == "seg_income").distinct()
    out = sg.matches_of_campaign(campaign, m, d.viewership_enriched(spark, sf), 50)
    return out.select("event_id", "device_id", "content_id", "watch_start_utc")


@query("active_segment_page", """SELECT id, name, created_at FROM (SELECT p_partkey AS id, p_name AS name,
    CASE WHEN p_size % 2 = 0 THEN 'active' ELSE 'pending' END AS status, p_size AS created_at FROM part)
WHERE status = 'active' ORDER BY created_at, id LIMIT 20 OFFSET 40""")
def active_segment_page(spark, sf):
    p = d.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 2 == 0, "active").otherwise("pending").alias("status"),
        F.col("p_size").alias("created_at"),
    )
    return sg.active_page(p, 20, 40).drop("status")


@query("queue_newest_per_device", d.views("fingerprints") + """
SELECT event_id, device_id, timestamp_utc FROM fingerprints
QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY timestamp_utc DESC, event_id DESC) <= 20""")
def queue_newest_per_device(spark, sf):
    f = d.fingerprints(spark, sf).select("event_id", "device_id", "timestamp_utc")
    return sg.keep_first(f, ["device_id"], [F.col("timestamp_utc").desc(), F.col("event_id").desc()], 20)


@query("queue_oldest_unsent", d.views("fingerprints") + """
SELECT event_id, device_id, timestamp_utc FROM fingerprints WHERE event_type <> 'click'
QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY timestamp_utc, event_id) <= 20""")
def queue_oldest_unsent(spark, sf):
    f = d.fingerprints(spark, sf).select(
        "event_id", "device_id", "timestamp_utc", (F.col("event_type") == "click").alias("transmitted")
    )
    unsent = f.filter(~F.col("transmitted")).drop("transmitted")
    return sg.keep_first(unsent, ["device_id"], [F.col("timestamp_utc"), F.col("event_id")], 20)


@query("match_confidences", d.views("reference_fingerprints") + """
SELECT content_id, CAST(least(coalesce(CASE WHEN CAST(substr(content_id, 3) AS BIGINT) % 3 = 0 THEN NULL ELSE CAST(substr(content_id, 3) AS DOUBLE) / 100 END, 0.95), 1.0) AS DOUBLE) AS confidence
FROM reference_fingerprints""")
def match_confidences(spark, sf):
    key = F.col("k").cast("bigint")
    raw = F.when(key % 3 != 0, key.cast("double") / 100)
    return d.content(spark, sf).select("content_id", scoring.match_confidence(raw).alias("confidence"))


_SKETCH_ENTRIES = 16  # exact up to 65,536 members
_LOOKBACKS = (3, 10, 30)
_SKETCHED = d.views("viewership_enriched") + f""", tagged AS (
  SELECT 'seg_or' AS segment_id, device_id, viewing_date FROM viewership_enriched WHERE genre IN ('promo', 'small') OR network IN ('Brand#1', 'Brand#2')
  UNION ALL SELECT 'seg_area', device_id, viewing_date FROM viewership_enriched WHERE dma_code IN ('100', '101', '102', '103', '104')),
spans AS (SELECT days, segment_id, device_id FROM tagged, (VALUES (3), (10), (30)) x(days)
  WHERE viewing_date BETWEEN DATE '{AS_OF}' - days::INT AND DATE '{AS_OF}')"""


def sketches(spark, sf):
    return sg.daily_sketches(
        d.viewership_enriched(spark, sf), [s for s in SEGMENTS if s.segment_id in ("seg_or", "seg_area")],
        _SKETCH_ENTRIES)


def _per_span(spark, sf, report):
    daily = sketches(spark, sf)
    parts = [report(sg.span_sketches(daily, as_of(), n, _SKETCH_ENTRIES)).withColumn("days", F.lit(n)) for n in _LOOKBACKS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("segment_sketch_sizes", _SKETCHED + """
SELECT days, segment_id, count(DISTINCT device_id) AS members FROM spans GROUP BY ALL""")
def segment_sketch_sizes(spark, sf):
    """Sizes over three lookbacks from one table of daily sketches."""
    return _per_span(spark, sf, sg.sketched_sizes)


@query("segment_sketch_overlap", _SKETCHED + """, held AS (SELECT days, device_id, count(DISTINCT segment_id) AS n FROM spans GROUP BY ALL)
SELECT days, count(*) AS union_size, count(*) FILTER (n = 2) AS overlap_size FROM held GROUP BY ALL""")
def segment_sketch_overlap(spark, sf):
    return _per_span(spark, sf, lambda s: sg.sketched_overlap(s, ("seg_or", "seg_area"), _SKETCH_ENTRIES))
