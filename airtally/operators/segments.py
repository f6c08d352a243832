"""Audience segments: rules as columns, populations, sizes, overlaps, lookups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from airtally.functions import identity, scoring

# Rule types with the column they speak of, and limits of a definition.
RULE_COLUMNS = {
    "watched_genre": "genre",
    "watched_network": "network",
    "household_income": "household_income",
    "dma": "dma_code",
    "daypart": "daypart",
}
EXTENDED_COLUMNS = {
    **RULE_COLUMNS,
    "genre": "genre",
    "income": "household_income",
    "behavior": "behavior",
    "device_type": "device_type",
    "network": "network",
}
OPERATORS = ("eq", "in", "gte", "lte", "between")
OPERATOR_NAMES = {"==": "eq", "=": "eq", ">=": "gte", "<=": "lte", "in": "in"}
DEVICE_CONFIDENCE = 0.95
HOUSEHOLD_CONFIDENCE = 0.75
FALLBACK_SEGMENTS = 5
MAX_OVERLAP_SEGMENTS = 5


@dataclass(frozen=True)
class Rule:
    type: str
    values: tuple[str, ...]
    op: str = "in"
    min_hours_week: float | None = None


@dataclass(frozen=True)
class Segment:
    segment_id: str
    name: str
    rules: tuple[Rule, ...]
    logic: str = "AND"
    lookback_days: int = 30
    minimum_cpm_floor: float = 0.50
    extended: bool = field(default=False)


def rule_from(raw: Mapping) -> Rule:
    """A rule from any of the four shapes in use: {type, value, operator},
    {type, values, operator}, {field, op, value}, {type, <type's own key>}."""
    kind = raw.get("type") or raw.get("field")
    value = raw.get("values", raw.get("value"))
    if value is None:
        own = {"watched_genre": "genre", "watched_network": "network"}.get(kind, kind)
        value = raw.get(own)
    if value is None:
        raise ValueError(f"rule {kind!r} has no value")
    values = tuple(str(v) for v in value) if isinstance(value, (list, tuple)) else (str(value),)
    op = raw.get("operator") or raw.get("op")
    op = OPERATOR_NAMES.get(op, op) or ("in" if len(values) > 1 else "eq")
    if len(values) > 1 and op == "eq":
        op = "in"
    return Rule(kind, values, op, raw.get("min_hours_week"))


def validate(segment: Segment) -> Segment:
    """Raises for a definition that would not be accepted."""
    known = EXTENDED_COLUMNS if segment.extended else RULE_COLUMNS
    problems = []
    if not 3 <= len(segment.name) <= 100:
        problems.append("name must have 3 to 100 characters")
    if not 1 <= len(segment.rules) <= 20:
        problems.append("there must be 1 to 20 rules")
    if segment.logic not in ("AND", "OR"):
        problems.append("logic must be AND or OR")
    if not 1 <= segment.lookback_days <= 90:
        problems.append("lookback must be 1 to 90 days")
    if segment.minimum_cpm_floor < 0.10:
        problems.append("the floor must be 0.10 or more")
    for rule in segment.rules:
        if rule.type not in known:
            problems.append(f"unknown rule type {rule.type!r}")
        if rule.op not in OPERATORS:
            problems.append(f"unknown operator {rule.op!r}")
    if problems:
        raise ValueError("; ".join(problems))
    return segment


def definition_problem() -> Column:
    """The same checks on a table of definitions (name, logic, lookback_days,
    minimum_cpm_floor, rules): the first problem, or null."""
    types = F.transform("rules", lambda r: r["type"])
    known = F.array(*[F.lit(t) for t in RULE_COLUMNS])
    return (
        F.when(~F.coalesce(F.length("name").between(3, 100), F.lit(False)), "name")
        .when(~F.coalesce(F.size("rules").between(1, 20), F.lit(False)), "rule_count")
        .when(~F.coalesce(F.col("logic").isin("AND", "OR"), F.lit(False)), "logic")
        .when(~F.coalesce(F.col("lookback_days").between(1, 90), F.lit(False)), "lookback")
        .when(~F.coalesce(F.col("minimum_cpm_floor") >= 0.10, F.lit(False)), "cpm_floor")
        .when(F.size(F.array_except(types, known)) > 0, "rule_type")
    )


def _is_number(value: object) -> bool:
    try:
        float(str(value))
    except ValueError:
        return False
    return True


def rule_condition(rule: Rule) -> Column:
    """A rule as a condition on a viewership row. Texts compare without case; bounds that
    are all numbers compare as numbers, as market codes do."""
    target = F.col(EXTENDED_COLUMNS[rule.type])
    bounded = rule.op in ("gte", "lte", "between") and all(_is_number(v) for v in rule.values)
    if EXTENDED_COLUMNS[rule.type] == "household_income" or bounded:
        target = target.try_cast("double")
        numbers = [float(v) for v in rule.values]
        if rule.op == "between":
            return target.between(numbers[0], numbers[1])
        if rule.op == "in":
            return target.isin(numbers)
        return {"gte": target >= numbers[0], "lte": target <= numbers[0]}.get(
            rule.op, target == numbers[0]
        )
    text = F.lower(target.cast("string"))
    values = [v.lower() for v in rule.values]
    if rule.op == "between":
        return text.between(values[0], values[1])
    if rule.op in ("gte", "lte"):
        return text >= values[0] if rule.op == "gte" else text <= values[0]
    return text.isin(values)


def segment_condition(segment: Segment, as_of: Column) -> Column:
    """All rules, or any of them, and within the lookback in either case."""
    joiner = (lambda a, b: a & b) if segment.logic == "AND" else (lambda a, b: a | b)
    rules = reduce(joiner, [rule_condition(r) for r in segment.rules])
    return rules & (F.col("viewing_date") >= F.date_sub(as_of, segment.lookback_days))


def literal_condition(segment: Segment, as_of: Column) -> Column:
    """The lookback bound to the last rule only, as unparenthesised SQL text reads."""
    lookback = F.col("viewing_date") >= F.date_sub(as_of, segment.lookback_days)
    conditions = [rule_condition(r) for r in segment.rules]
    if segment.logic == "AND":
        return reduce(lambda a, b: a & b, [*conditions, lookback])
    return reduce(lambda a, b: a | b, [*conditions[:-1], conditions[-1] & lookback])


def population(viewership: DataFrame, segment: Segment, as_of: Column) -> DataFrame:
    """Distinct members of one segment."""
    return populations(viewership, [segment], as_of).select("household_id", "device_id", "segment_id")


def populations(viewership: DataFrame, segments: Sequence[Segment], as_of: Column) -> DataFrame:
    """Distinct (segment_id, household_id, device_id) of many segments.

    Rows outside the longest lookback are dropped before anything else, which
    prunes partitions of a table laid out by date. Definitions without hours per week ask
    for one row that satisfies them, all in one scan. In a definition with hours a rule
    with hours is true for a device whose viewing of what the rule speaks of reaches them
    in some week of the lookback, any other rule for a device with one such row; AND and
    OR then combine what is true of the device. All those definitions share one aggregate.
    """
    checked = [validate(s) for s in segments]
    longest = max(s.lookback_days for s in checked)
    recent = viewership.filter(F.col("viewing_date") >= F.date_sub(as_of, longest))
    by_row = [s for s in checked if not any(r.min_hours_week for r in s.rules)]
    by_device = [s for s in checked if s not in by_row]
    parts = []
    if by_row:
        tags = [F.when(segment_condition(s, as_of), F.lit(s.segment_id)) for s in by_row]
        parts.append(recent.select(
            F.explode(F.array_compact(F.array(*tags))).alias("segment_id"), "household_id", "device_id",
        ).distinct())
    if by_device:
        parts.append(_members_by_hours(recent, by_device, as_of))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _members_by_hours(recent: DataFrame, segments: Sequence[Segment], as_of: Column) -> DataFrame:
    weekly, truths, tags = [], [], []
    for i, segment in enumerate(segments):
        names = []
        inside = F.col("viewing_date") >= F.date_sub(as_of, segment.lookback_days)
        for j, rule in enumerate(segment.rules):
            name = f"_{i}_{j}"
            applies = rule_condition(rule) & inside
            minutes = F.sum(F.when(applies, F.col("duration_minutes")).otherwise(0))
            true = minutes >= 60 * rule.min_hours_week if rule.min_hours_week else F.max(applies)
            weekly.append(F.coalesce(true, F.lit(False)).alias(name))
            truths.append(F.max(name).alias(name))
            names.append(F.col(name))
        joiner = (lambda a, b: a & b) if segment.logic == "AND" else (lambda a, b: a | b)
        tags.append(F.when(reduce(joiner, names), F.lit(segment.segment_id)))
    week = F.date_trunc("week", "viewing_date").alias("_week")
    devices = recent.groupBy("household_id", "device_id", week).agg(*weekly).groupBy(
        "household_id", "device_id").agg(*truths)
    return devices.select(
        F.explode(F.array_compact(F.array(*tags))).alias("segment_id"), "household_id", "device_id")


def engaged(viewership: DataFrame, min_hours: float) -> DataFrame:
    """Devices that reach `min_hours` in at least one week."""
    weekly = viewership.groupBy(
        "device_id", F.date_trunc("week", "viewing_date").cast("date").alias("week")
    ).agg((F.sum("duration_minutes") / 60).alias("week_hours"))
    return (
        weekly.filter(F.col("week_hours") >= min_hours)
        .groupBy("device_id").agg(F.count(F.lit(1)).alias("weeks"))
    )


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("segment_id").agg(
        F.count_distinct("device_id").alias("device_count"),
        F.count_distinct("household_id").alias("household_count"),
    )


def approximate_sizes(members: DataFrame, error: float = 0.02) -> DataFrame:
    return members.groupBy("segment_id").agg(
        F.approx_count_distinct("device_id", error).alias("device_count"),
        F.approx_count_distinct("household_id", error).alias("household_count"),
    )


def sampled_sizes(members: DataFrame, one_in: int = 8) -> DataFrame:
    """Size from a fixed sample of devices, with a 95 % interval.

    The sample is taken by the device's hash, so it is the same on every run and
    for every segment.
    """
    bucket = F.conv(F.substring(F.sha2(F.col("device_id"), 256), 1, 8), 16, 10).cast("bigint")
    sample = members.filter(bucket % one_in == 0).select("segment_id", "device_id").distinct()
    counted = sample.groupBy("segment_id").agg(F.count(F.lit(1)).alias("sample_size"))
    # Each device is in the sample with probability 1/one_in: a binomial estimate.
    spread = 1.96 * F.sqrt(F.col("sample_size") * (1 - 1.0 / one_in)) * one_in
    estimate = F.col("sample_size") * one_in
    return counted.select(
        "segment_id", "sample_size",
        estimate.alias("estimated_size"),
        F.greatest(F.lit(0.0), F.floor(estimate - spread).cast("double")).alias("low"),
        F.ceil(estimate + spread).cast("double").alias("high"),
    )


def daily_sketches(viewership: DataFrame, definitions: Sequence[Segment], lg_entries: int = 12,
                   member: str = "device_id") -> DataFrame:
    """(segment_id, viewing_date, sketch): a theta sketch of the members by day, without any lookback.

    Sizes, unions and intersections over any span of days come from these few rows, without another scan
    of the views; a new day only adds its own. A sketch holds at most 2^lg_entries hashes and is exact below
    that; beyond, the standard error of a size is 1 / sqrt(2^lg_entries), that of an intersection
    so many of the union. Definitions with hours per week do not follow from single rows and raise.
    """
    checked = [validate(s) for s in definitions]
    if any(r.min_hours_week for s in checked for r in s.rules):
        raise ValueError("definitions with hours per week have no daily members")
    tags = []
    for s in checked:
        joiner = (lambda a, b: a & b) if s.logic == "AND" else (lambda a, b: a | b)
        tags.append(F.when(reduce(joiner, [rule_condition(r) for r in s.rules]), F.lit(s.segment_id)))
    rows = viewership.select(F.explode(F.array_compact(F.array(*tags))).alias("segment_id"), "viewing_date", member)
    return rows.groupBy("segment_id", "viewing_date").agg(
        F.theta_sketch_agg(member, lg_entries).alias("sketch"))


def span_sketches(daily: DataFrame, as_of: Column, lookback_days: int, lg_entries: int = 12) -> DataFrame:
    """One sketch per segment: who was a member in the lookback up to a day."""
    inside = F.col("viewing_date").between(F.date_sub(as_of, lookback_days), as_of)
    return daily.filter(inside).groupBy("segment_id").agg(F.theta_union_agg("sketch", lg_entries).alias("sketch"))


def sketched_sizes(sketches: DataFrame) -> DataFrame:
    return sketches.select("segment_id", F.theta_sketch_estimate("sketch").cast("bigint").alias("members"))


def sketched_overlap(sketches: DataFrame, ids: Sequence[str], lg_entries: int = 12) -> DataFrame:
    """(union_size, overlap_size) of 2 to 5 segments; one that has no members makes the overlap empty."""
    if not 2 <= len(set(ids)) <= MAX_OVERLAP_SEGMENTS:
        raise ValueError("an overlap takes 2 to 5 segments")
    # A missing segment counts as one without members.
    one = sketches.filter(F.col("segment_id").isin(list(ids))).agg(
        F.count_distinct("segment_id").alias("n"),
        F.theta_union_agg("sketch", lg_entries).alias("any"), F.theta_intersection_agg("sketch").alias("all"))
    return one.select(
        F.coalesce(F.theta_sketch_estimate("any"), F.lit(0)).cast("bigint").alias("union_size"),
        F.when(F.col("n") == len(set(ids)), F.theta_sketch_estimate("all")).otherwise(0).cast("bigint").alias(
            "overlap_size"))


def device_index(members: DataFrame) -> DataFrame:
    """Sorted segment list per device. A list is as long as there are segments."""
    return members.groupBy("device_id").agg(
        F.array_sort(F.collect_set("segment_id")).alias("segment_ids")
    )


def set_sizes(members: DataFrame, first: str, second: str, member: str = "device_id") -> DataFrame:
    """Members of either segment, of both and of only one, from one grouping of flags per member."""
    a, b = (F.coalesce(F.bool_or(F.col("segment_id") == i), F.lit(False)) for i in (first, second))
    flags = members.filter(F.col("segment_id").isin(first, second)).groupBy(member).agg(a.alias("a"), b.alias("b"))
    return flags.agg(
        F.count(F.lit(1)).alias("union_size"), F.count_if(F.col("a") & F.col("b")).alias("common_size"),
        F.count_if(~F.col("b")).alias("only_first"), F.count_if(~F.col("a")).alias("only_second"))


def intersection_size(members: DataFrame, ids: Sequence[str], member: str = "device_id") -> DataFrame:
    """Members of all the named segments; one id gives its size, none gives 0."""
    wanted = sorted(set(ids))
    if not wanted:
        return members.agg(F.count_if(F.lit(False)).alias("members"))
    flags = [F.max((F.col("segment_id") == i).cast("int")) for i in wanted]
    together = reduce(lambda a, b: a + b, flags)
    per_member = members.filter(F.col("segment_id").isin(wanted)).groupBy(member).agg(
        together.alias("n")
    )
    return per_member.agg(F.count_if(F.col("n") == len(wanted)).alias("members"))


def overlap(members: DataFrame, ids: Sequence[str], member: str = "device_id") -> DataFrame:
    """Overlap report of 2 to 5 segments.

    One row per segment with its size and the members found in no other of them,
    beside the overlap, the union and the overlap as a percentage of the smallest
    segment. Members are brought together once; the counts are sums of flags.
    """
    if not 2 <= len(ids) <= MAX_OVERLAP_SEGMENTS:
        raise ValueError("an overlap report takes 2 to 5 segments")
    flags = [F.max((F.col("segment_id") == i).cast("int")).alias(f"f{n}") for n, i in enumerate(ids)]
    per_member = members.filter(F.col("segment_id").isin(list(ids))).groupBy(member).agg(*flags)
    names = [f"f{n}" for n in range(len(ids))]
    held = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    totals = per_member.select("*", held.alias("held")).agg(
        F.count_if(F.col("held") == len(ids)).alias("overlap_size"),
        F.count(F.lit(1)).alias("union_size"),
        *[F.count_if(F.col(n) == 1).alias(f"{n}_size") for n in names],
        *[F.count_if((F.col(n) == 1) & (F.col("held") == 1)).alias(f"{n}_only") for n in names],
    )
    smallest = F.least(*[F.col(f"{n}_size") for n in names])
    rows = [
        F.struct(
            F.lit(i).alias("segment_id"), F.col(f"{n}_size").alias("size"),
            F.col(f"{n}_only").alias("unique_size"),
        )
        for i, n in zip(ids, names)
    ]
    percent = scoring.ratio_or_zero(F.col("overlap_size") * 100.0, smallest)
    return totals.select(
        "overlap_size", "union_size", percent.alias("overlap_percentage"), F.inline(F.array(*rows))
    )


def add_members(members: DataFrame, more: DataFrame) -> DataFrame:
    return members.unionByName(more).distinct()


def remove_members(members: DataFrame, gone: DataFrame, on: Sequence[str]) -> DataFrame:
    return members.join(gone.select(*on).distinct(), list(on), "left_anti")


def contains(candidates: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    return candidates.join(members.select(*on), list(on), "left_semi")


def only_in(first: DataFrame, second: DataFrame, member: str = "device_id") -> DataFrame:
    return first.select(member).subtract(second.select(member))


def transitions(before: DataFrame, after: DataFrame, member: str = "device_id") -> DataFrame:
    """Entries and exits between two states of the membership.

    Both states go through a single aggregate, which replaces a full outer join.
    """
    tagged = before.select("segment_id", member, F.lit(-1).alias("side")).unionByName(
        after.select("segment_id", member, F.lit(1).alias("side"))
    )
    sides = tagged.groupBy("segment_id", member).agg(
        F.max("side").alias("newest"), F.min("side").alias("oldest")
    )
    changed = sides.filter(F.col("newest") == F.col("oldest"))
    event = F.when(F.col("newest") == 1, "segment_entry").otherwise("segment_exit")
    return changed.select("segment_id", member, event.alias("event_type"))


def subnet_index(members: DataFrame, ip_households: DataFrame,
                 limit: int = FALLBACK_SEGMENTS) -> DataFrame:
    """The first segments, by id, of the households of each subnet.

    The distinct pairs of subnet and segment are few however many households a
    subnet has, so a list never grows beyond the number of segments.
    """
    pairs = (
        ip_households.select("subnet", "household_id").distinct()
        .join(members.select("household_id", "segment_id").distinct(), "household_id")
        .select("subnet", "segment_id").distinct()
    )
    return pairs.groupBy("subnet").agg(
        F.slice(F.array_sort(F.collect_set("segment_id")), 1, limit).alias("fallback_ids")
    )


def lookup(requests: DataFrame, by_device: DataFrame, by_subnet: DataFrame) -> DataFrame:
    """Segments per request: those of the device, else those of its subnet.

    `requests` has device_id, ifa, ip_address and device_ip. A request without any
    hit stays, with an empty list.
    """
    device, ip = identity.device_and_ip("device_id", "ifa", "ip_address", "device_ip")
    asked = requests.select(
        "request_id", device.alias("device_id"), identity.subnet_network(ip).alias("subnet")
    )
    found = asked.join(by_device, "device_id", "left").join(by_subnet, "subnet", "left")
    own = F.size(F.coalesce("segment_ids", F.array().cast("array<string>"))) > 0
    fallback = F.size(F.coalesce("fallback_ids", F.array().cast("array<string>"))) > 0

    def matches(column: str, confidence: float, source: str) -> Column:
        return F.transform(
            column,
            lambda s: F.struct(
                s.alias("segment_id"), F.lit(confidence).alias("confidence"),
                F.lit(source).alias("source"),
            ),
        )

    none = F.array().cast("array<struct<segment_id:string,confidence:double,source:string>>")
    return found.select(
        "request_id",
        F.coalesce("device_id", F.lit("unknown")).alias("device_id"),
        F.when(own, matches("segment_ids", DEVICE_CONFIDENCE, "device_hash"))
        .when(fallback, matches("fallback_ids", HOUSEHOLD_CONFIDENCE, "ip_household"))
        .otherwise(none).alias("matched_segments"),
        (own | fallback).alias("cache_hit"),
    )


def reach_estimate(segment_sizes: DataFrame) -> DataFrame:
    return segment_sizes.select(
        "segment_id", "device_count",
        scoring.expected_impressions("device_count").alias("impressions"),
        scoring.reach_percent("device_count").alias("reach_percent"),
    )


def reach_model(definitions: DataFrame) -> DataFrame:
    """Modelled reach and price of definitions (segment_id, logic, rules); a rule is
    a struct with `field` and `values`. No rule means the whole base."""
    factors = F.transform("rules", lambda r: scoring.rule_factor(r["field"], r["values"]))
    empty = F.size("rules") == 0
    combined = scoring.combined_factor("factors", "logic")
    scored = definitions.withColumn("factors", factors).withColumn("combined", combined)
    return scored.select(
        "segment_id", "combined",
        F.when(empty, F.lit(scoring.TOTAL_HOUSEHOLDS).cast("bigint"))
        .otherwise(scoring.modelled_reach("combined")).alias("reach"),
        F.when(empty, F.lit(scoring.UNFILTERED_CPM))
        .otherwise(scoring.modelled_cpm("combined")).alias("cpm"),
    )


def reach_by_daypart(members: DataFrame, viewership: DataFrame) -> DataFrame:
    """Distinct devices of each segment seen in each daypart.

    Devices and dayparts are made distinct before the join, so a device that
    watches without end adds four rows at most.
    """
    seen = viewership.select("device_id", "daypart").distinct()
    who = members.select("segment_id", "device_id").distinct()
    joined = who.join(seen, "device_id")
    dayparts = ["morning", "afternoon", "primetime", "latenight"]
    return joined.groupBy("segment_id").agg(
        *[F.count_if(F.col("daypart") == d).alias(d) for d in dayparts]
    )


HISTORY_DAYS = 90


def definition_versions(changes: DataFrame, now: Column, history_days: int = HISTORY_DAYS) -> DataFrame:
    """Which version of a definition held when: `valid_from` on, up to but not on `valid_to` (null: still).

    `changes` has segment_id, changed_on (date), version, status and whatever the definition consists of. Of
    changes of one day that with the greatest version counts. A segment ends on the first day on which it was archived
    and cannot come back; `history_days` after that day its history is gone.
    """
    others = [c for c in changes.columns if c not in ("segment_id", "changed_on", "status")]
    gone = F.col("status") == "archived"
    # One row per segment and day reaches the window, however many changes there were.
    days = changes.groupBy("segment_id", "changed_on").agg(
        F.coalesce(F.bool_or(gone), F.lit(False)).alias("_gone"),
        F.max_by(F.struct(*others), "version").alias("_last"))
    segment = W.partitionBy("segment_id")
    ended = days.withColumn("archived_on", F.min(F.when(F.col("_gone"), F.col("changed_on"))).over(segment))
    held = ended.filter(
        F.col("archived_on").isNull()
        | ((F.col("changed_on") < F.col("archived_on")) & (F.date_add("archived_on", history_days) >= now)))
    until = F.lead("changed_on").over(segment.orderBy("changed_on"))
    return held.select(
        "segment_id", F.col("changed_on").alias("valid_from"),
        F.coalesce(until, "archived_on").alias("valid_to"), "_last.*")


def version_on(rows: DataFrame, versions: DataFrame, day: str) -> DataFrame:
    """Rows (segment_id, a date) with the `version` that held on their date, null where none did.

    The dates of a segment and the starts of its versions are put in one line, one row each a day, and
    the last start is carried along; the rows themselves only meet the outcome, by an equal join.
    """
    asked = rows.select("segment_id", F.col(day).alias("_day")).distinct().select(
        "segment_id", "_day", F.lit(None).cast(versions.schema["valid_from"].dataType).alias("valid_from"))
    starts = versions.select("segment_id", F.col("valid_from").alias("_day"), "valid_from")
    line = asked.withColumn("_asked", F.lit(True)).unionByName(starts.withColumn("_asked", F.lit(False)))
    order = W.partitionBy("segment_id").orderBy("_day", "_asked")
    found = line.withColumn("valid_from", F.last("valid_from", True).over(order)).filter("_asked").drop("_asked")
    held = found.join(versions.select("segment_id", "valid_from", "valid_to", "version"), ["segment_id", "valid_from"])
    held = held.filter(F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to")))
    joined = rows.withColumn("_day", F.col(day)).join(
        held.select("segment_id", "_day", "version"), ["segment_id", "_day"], "left")
    return joined.select(*rows.columns, "version")


def soft_delete(segments: DataFrame, ids: Iterable[str], at: Column) -> DataFrame:
    """Archive segments; their rows stay until the retention policy takes them."""
    gone = F.col("segment_id").isin(list(ids))
    return segments.withColumns(
        {
            "status": F.when(gone, "archived").otherwise(F.col("status")),
            "updated_at": F.when(gone, at).otherwise(F.col("updated_at")),
        }
    )


def active_page(segments: DataFrame, limit: int = 100, offset: int = 0,
                status: str = "active") -> DataFrame:
    """A page of at most 100 segments, oldest first; a larger page is refused."""
    if not 0 <= limit <= 100:
        raise ValueError("a page has at most 100 rows")
    return (
        segments.filter(F.col("status") == status)
        .orderBy("created_at", "id").offset(offset).limit(limit)
    )


def nightly_summary(members: DataFrame) -> DataFrame:
    """Households per segment and over all; the total has no segment id."""
    return members.rollup("segment_id").agg(F.count_distinct("household_id").alias("households"))


def refresh_events(segment_sizes: DataFrame, at: Column) -> DataFrame:
    """One JSON message per refreshed segment."""
    data = F.struct("segment_id", F.col("device_count").alias("estimated_size"), at.alias("updated_at"))
    return segment_sizes.select(
        "segment_id",
        F.to_json(
            F.struct(F.lit("segment.populated").alias("event_type"), at.alias("timestamp"),
                     data.alias("data"))
        ).alias("payload"),
    )


def matches_of_campaign(campaign: DataFrame, members: DataFrame, viewership: DataFrame,
                        limit: int) -> DataFrame:
    """Viewership of the members of a campaign's segment, newest first."""
    who = members.join(campaign.select("segment_id"), "segment_id", "left_semi")
    rows = viewership.join(who.select("device_id").distinct(), "device_id", "left_semi")
    return rows.orderBy(F.col("watch_start_utc").desc(), "event_id").limit(limit)


def keep_first(frame: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key. The rank limit is applied before the shuffle as well,
    so each task sends n rows per key at most."""
    line = W.partitionBy(*keys).orderBy(*order)
    ranked = frame.withColumn("_rank", F.row_number().over(line))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")
