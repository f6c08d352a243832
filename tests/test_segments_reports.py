import datetime

import pytest
from pyspark.sql import functions as F

from airtally.operators import alerts, household, quality, reports
from airtally.operators import segments as sg
from tests.conftest import rows

def as_of():
    return F.lit("2024-02-01").cast("date")
VIEWS = ("device_id string, household_id string, genre string, network string, daypart string, dma_code string, "
         "household_income bigint, viewing_date date, duration_minutes bigint")


@pytest.fixture(scope="module")
def views(spark):
    import datetime as dt

    day = dt.date(2024, 1, 30)
    old = dt.date(2023, 10, 1)
    return spark.createDataFrame(
        [
            ("d1", "h1", "Drama", "AMC", "primetime", "501", 90000, day, 60),
            ("d2", "h1", "sports", "ESPN", "morning", "502", 50000, day, 300),
            ("d3", "h2", "news", "CNN", "latenight", "501", None, day, 10),
            ("d4", "h3", "sports", "ESPN", "primetime", "0501", 20000, old, 500),
            ("d1", "h1", "drama", "AMC", "primetime", "501", 90000, day, 60),
        ], VIEWS)


def ids(frame):
    return sorted(r.device_id for r in frame.collect())


def seg(rules, logic="AND", days=30, **kw):
    return sg.Segment("s", "name", tuple(sg.rule_from(r) for r in rules), logic, days, **kw)


def test_four_rule_shapes_mean_the_same():
    shapes = [
        {"type": "dma", "value": ["501", "502"], "operator": "in"},
        {"type": "dma", "values": [501, 502], "operator": "in"},
        {"field": "dma", "op": "in", "value": ["501", "502"]},
        {"type": "dma", "dma": ["501", "502"], "threshold_days": 7},
    ]
    assert {sg.rule_from(s) for s in shapes} == {sg.Rule("dma", ("501", "502"), "in")}


def test_rules_and_logic(spark, views):
    genre = {"type": "watched_genre", "value": "drama"}
    area = {"type": "dma", "value": [501]}
    assert ids(sg.population(views, seg([genre]), as_of())) == ["d1"]
    assert ids(sg.population(views, seg([area]), as_of())) == ["d1", "d3"]
    assert ids(sg.population(views, seg([genre, area]), as_of())) == ["d1"]
    assert ids(sg.population(views, seg([genre, {"type": "daypart", "value": "latenight"}], "OR"), as_of())) == ["d1", "d3"]
    income = {"type": "household_income", "value": 50000, "operator": ">="}
    assert ids(sg.population(views, seg([income]), as_of())) == ["d1", "d2"]
    below = {"type": "household_income", "value": 50000, "operator": "<="}
    assert ids(sg.population(views, seg([below]), as_of())) == ["d2"]
    between = {"field": "income", "op": "between", "value": ["40000", "60000"]}
    assert ids(sg.population(views, seg([between], extended=True), as_of())) == ["d2"]


def test_hours_per_week(spark, views):
    area = {"type": "dma", "value": ["501", "502"], "min_hours_week": 2}
    assert ids(sg.population(views, seg([area]), as_of())) == ["d1", "d2"]
    assert ids(sg.population(views, seg([{**area, "min_hours_week": 4.5}]), as_of())) == ["d2"]
    assert ids(sg.populations(views, [seg([area])], as_of())) == ["d1", "d2"]


def test_lookback_binds_to_all_rules_or_only_the_last(spark, views):
    s = seg([{"type": "watched_genre", "value": "sports"}, {"type": "watched_network", "value": "AMC"}], "OR")
    assert ids(sg.population(views, s, as_of())) == ["d1", "d2"]
    literal = views.filter(sg.literal_condition(s, as_of())).select("device_id").distinct()
    assert ids(literal) == ["d1", "d2", "d4"]


@pytest.mark.parametrize("bad", [
    seg([]), seg([{"type": "moon", "value": "x"}]), seg([{"type": "dma", "value": 1}], "XOR"),
    seg([{"type": "dma", "value": 1}], days=91), seg([{"type": "dma", "value": 1}], days=0),
    seg([{"type": "dma", "value": 1}] * 21), seg([{"type": "dma", "value": 1}], minimum_cpm_floor=0.05),
    sg.Segment("s", "ab", (sg.Rule("dma", ("1",)),)), seg([{"type": "income", "value": 1}]),
])
def test_bad_definitions_are_rejected(bad):
    with pytest.raises(ValueError):
        sg.validate(bad)


def test_one_pass_equals_one_by_one(spark, views):
    defs = [
        sg.Segment("a", "aaa", (sg.Rule("watched_genre", ("drama", "news")),)),
        sg.Segment("b", "bbb", (sg.Rule("dma", ("501",)), sg.Rule("daypart", ("morning",))), "OR"),
        sg.Segment("c", "ccc", (sg.Rule("watched_genre", ("opera",)),), "AND", 5),
    ]
    once = rows(sg.populations(views, defs, as_of()).select("segment_id", "device_id"))
    each = sorted(((d.segment_id, i) for d in defs for i in ids(sg.population(views, d, as_of()))), key=repr)
    assert once == each


MEMBERS = "segment_id string, device_id string, household_id string"


@pytest.fixture(scope="module")
def members(spark):
    data = [("a", f"d{i}", f"h{i // 2}") for i in range(10)] + [("b", f"d{i}", f"h{i // 2}") for i in range(6, 14)]
    return spark.createDataFrame(data + [("c", "d6", "h3")], MEMBERS)


def test_sizes(members):
    assert rows(sg.sizes(members)) == [("a", 10, 5), ("b", 8, 4), ("c", 1, 1)]
    assert rows(sg.approximate_sizes(members)) == [("a", 10, 5), ("b", 8, 4), ("c", 1, 1)]


@pytest.mark.parametrize("ids_,n", [([], 0), (["a"], 10), (["a", "b"], 4), (["a", "b", "c"], 1), (["a", "zz"], 0)])
def test_intersections(members, ids_, n):
    assert sg.intersection_size(members, ids_).first().members == n


def test_overlap(members):
    got = {r.segment_id: r for r in sg.overlap(members, ["a", "b"]).collect()}
    assert (got["a"].overlap_size, got["a"].union_size, got["a"].overlap_percentage) == (4, 14, 50.0)
    assert (got["a"].unique_size, got["b"].unique_size) == (6, 4)
    for wrong in (["a"], list("abcdef")):
        with pytest.raises(ValueError):
            sg.overlap(members, wrong)


def test_sampled_size_covers_the_truth(spark):
    big = spark.range(8000).select(F.lit("s").alias("segment_id"), F.sha2(F.col("id").cast("string"), 256).alias("device_id"))
    r = sg.sampled_sizes(big, 8).first()
    assert r.low <= 8000 <= r.high and r.sample_size * 8 == r.estimated_size


def test_set_operations_and_transitions(spark, members):
    a, b = members.filter("segment_id = 'a'"), members.filter("segment_id = 'b'")
    assert sg.add_members(members, members).count() == members.count()
    assert sg.only_in(a, b).count() == 6
    assert sg.contains(a, b, ["device_id"]).count() == 4
    assert sg.remove_members(members, b.select("device_id"), ["device_id"]).count() == 6
    after = spark.createDataFrame([("a", "d0", "h"), ("a", "new", "h")], MEMBERS)
    got = rows(sg.transitions(a.filter("device_id in ('d0', 'd1')"), after))
    assert got == [("a", "d1", "segment_exit"), ("a", "new", "segment_entry")]


def test_lookup_falls_back_to_the_subnet(spark, members):
    subnets = spark.createDataFrame([("1.2.3.0", f"h{i}") for i in range(7)], "subnet string, household_id string")
    requests = spark.createDataFrame(
        [(1, "d0", None, "9.9.9.9", None), (2, None, "d6", None, "1.2.3.4"), (3, "nobody", None, None, "1.2.3.9"),
         (4, None, None, None, None), (5, "nobody", None, "8.8.8.8", "1.2.3.4")],
        "request_id int, device_id string, ifa string, ip_address string, device_ip string")
    got = {r.request_id: r for r in sg.lookup(requests, sg.device_index(members), sg.subnet_index(members, subnets, 2)).collect()}
    sources = {k: [(m.segment_id, m.confidence, m.source) for m in r.matched_segments] for k, r in got.items()}
    assert sources[1] == [("a", 0.95, "device_hash")]
    assert [s[0] for s in sources[2]] == ["a", "b", "c"]
    assert sources[3] == [("a", 0.75, "ip_household"), ("b", 0.75, "ip_household")]
    assert sources[4] == [] and got[4].device_id == "unknown" and not got[4].cache_hit
    assert sources[5] == []


def test_reach_model_without_rules(spark):
    frame = spark.createDataFrame([("x", "and", [])], "segment_id string, logic string, rules array<struct<field:string,values:array<string>>>")
    r = sg.reach_model(frame).first()
    assert (r.reach, r.cpm) == (120_000_000, 0.05)


def test_keep_first_limits_before_the_shuffle(spark):
    frame = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    out = sg.keep_first(frame, ["k"], [F.col("id").desc()], 3)
    assert rows(out) == [(0, 994), (0, 996), (0, 998), (1, 995), (1, 997), (1, 999)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_household_shares(spark):
    v = spark.createDataFrame(
        [("h1", "drama", 20, 30), ("h2", "drama", 9, 60), ("h2", "news", 23, 120), ("h2", None, 9, 600),
         ("h3", None, 9, 10), ("h4", "news", None, 10)],
        "household_id string, genre string, watch_hour int, duration_minutes bigint")
    got = {r.household_id: r for r in household.household_aggregates(v).collect()}
    assert set(got) == {"h1", "h2"}
    assert got["h1"].genre_scores == {"drama": 50} and got["h1"].total_hours_watched == 0.5
    assert got["h2"].genre_scores == {"drama": 33, "news": 66}
    assert got["h2"].daypart_scores == {"morning": 66, "latenight": 33}
    assert got["h1"].brand_affinity_signals == [] and got["h1"].affinity_note
    # The separate rollups agree.
    flat = {(r.household_id, r.genre): r.score for r in household.genre_affinity(v).collect()}
    assert flat[("h2", "news")] == 66 and flat[("h4", "news")] == 16


def test_standard_segments(spark):
    v = spark.createDataFrame([("h1", "news", 20, 3600), ("h2", "sports", 9, 60)], "household_id string, genre string, watch_hour int, duration_minutes bigint")
    got = rows(household.standard_segments(household.household_aggregates(v)))
    assert got == [("seg_high_engagement", "h1"), ("seg_news_watchers", "h1"), ("seg_primetime_viewers", "h1"), ("seg_sports_fans", "h2")]


def test_revenue_share(spark):
    counts = {"Samsung": 45000, "LG": 32000, "Sony": 28000, "Vizio": 22000, "TCL": 18000, "Philips": 15000, "Panasonic": 12000, "Others": 28000}
    frame = spark.createDataFrame(list(counts.items()), "manufacturer string, device_count bigint")
    shares = reports.revenue_shares(frame, 1_000_000)
    got = {r.manufacturer: (r.revenue_share_usd, r.percentage) for r in shares.collect()}
    assert got["Samsung"] == (67500.0, 22.5) and got["Philips"] == (22500.0, 7.5)
    assert reports.total_payout(shares).first()[0] == 300000.0


def test_payouts_roll_over(spark):
    frame = spark.createDataFrame([("a", "01", 300.0), ("a", "02", 100.0), ("a", "03", 200.0), ("a", "04", 50.0), ("b", "01", 500.0)], "manufacturer string, month string, earned double")
    got = [(r.manufacturer, r.month, r.paid, r.balance) for r in reports.payout_rollover(frame).orderBy("manufacturer", "month").collect()]
    assert got == [("a", "01", 0.0, 300.0), ("a", "02", 0.0, 400.0), ("a", "03", 600.0, 0.0), ("a", "04", 0.0, 50.0), ("b", "01", 500.0, 0.0)]
    low = reports.payout_rollover(frame, 100.0).filter("manufacturer = 'a' and month = '02'").first()
    assert low.paid == 100.0


def test_activation_status(spark):
    asked = spark.createDataFrame([("a", 0.5), ("a", 0.49), ("zz", 9.0)], "segment_id string, cpm_floor double")
    known = spark.createDataFrame([("a", 0.5)], "segment_id string, minimum_cpm_floor double")
    assert sorted(r.status for r in reports.activate(asked, known).collect()) == ["activated", "below_floor", "not_found"]


def test_empty_reports_give_zeros(spark):
    empty = spark.createDataFrame([], "activated_at date, segment_id string, device_count bigint, cpm_floor double")
    assert tuple(reports.delivery_stats(empty, as_of()).first()) == (0, 0, 0.0)
    series = spark.createDataFrame([], "unique_devices bigint, impressions bigint, spend_usd double")
    assert tuple(reports.report_totals(series).first()) == (0, 0, 0.0, 0.0, 0.0)


def test_histogram(spark):
    frame = spark.createDataFrame([(x,) for x in (0.005, 0.05, 0.2, 7.0)], "s double")
    got = {r.le: r.events for r in reports.latency_histogram(frame, "s").collect()}
    assert got == {"0.01": 1, "0.05": 2, "0.1": 2, "0.5": 3, "1.0": 3, "5.0": 3, "+Inf": 4}


RATE = "manufacturer string, {} double"


def test_alert_thresholds(spark):
    current = spark.createDataFrame([("a", 49.0), ("b", 50.0), ("c", 5.0), ("z", 0.0)], RATE.format("current"))
    base = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("z", 0.0)], RATE.format("baseline"))
    drop = alerts.ingest_rate_alerts(current, base)
    assert [(r.manufacturer, r.measure, r.severity) for r in drop.collect()] == [("a", 51.0, "critical")]
    now = spark.createDataFrame([("a", 2.6), ("b", 2.4), ("z", 9.0)], RATE.format("current"))
    was = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("z", 0.0)], RATE.format("baseline"))
    spikes = alerts.optout_alerts(now, was)
    assert [r.manufacturer for r in spikes.collect()] == ["a"]
    rates = dict(zip("Samsung LG Sony Vizio TCL Philips Panasonic Others".split(), (72, 68, 75, 62, 58, 70, 65, 61)))
    low = alerts.match_rate_alerts(spark.createDataFrame([(k, float(v)) for k, v in rates.items()], RATE.format("match_rate")))
    assert [r.manufacturer for r in low.collect()] == ["TCL"]
    counts = {r.type: r.alerts for r in alerts.alert_counts(alerts.consolidate(drop, spikes)).collect()}
    assert counts == {"ingest_rate_drop": 1, "low_match_rate": 0, "optout_spike": 1, "total": 2}


def test_held_conditions(spark):
    frame = spark.createDataFrame([("a", t, b) for t, b in ((0, True), (60, True), (120, False), (180, True), (240, True), (300, True), (420, True))], "k string, t bigint, breach boolean")
    got = rows(alerts.held(frame, "k", "t", 60, 2))
    assert got == [("a", 0, 60, 2), ("a", 180, 300, 3)]


def test_quality(spark):
    frame = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    got = {r.column: (r.share, r.passed) for r in quality.completeness(frame, ["a", "b"]).collect()}
    assert got == {"a": (1.0, True), "b": (0.5, False)}
    counts = spark.createDataFrame([(50000, 50)], "deleted bigint, archived bigint")
    checks = quality.in_range(counts, {"deleted": quality.DELETED_RANGE, "archived": quality.ARCHIVED_RANGE})
    assert [(r.check, r.passed) for r in checks.collect()] == [("deleted", True), ("archived", False)]
    assert quality.all_passed(checks).first().passed is False


def test_status_page_and_soft_delete(spark):
    frame = spark.createDataFrame([(i, "active" if i % 2 else "pending", i, 0) for i in range(10)], "id int, status string, created_at int, updated_at int")
    assert [r.id for r in sg.active_page(frame, 2, 1).collect()] == [3, 5]
    named = frame.withColumn("segment_id", F.col("id").cast("string"))
    gone = sg.soft_delete(named, ["1"], F.lit(7)).filter("status = 'archived'").collect()
    assert [(r.id, r.updated_at) for r in gone] == [(1, 7)]


def test_versions_of_definitions_on_a_date(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    edits = [("s", 0, 1, "active", "x"), ("s", 5, 2, "active", "y"), ("s", 5, 3, "active", "z"), ("s", 9, 4, "archived", None),
             ("s", 12, 5, "active", "back"), ("t", 0, 6, "active", "t"), ("t", 1, 7, "archived", None), ("u", 3, 8, None, "u")]
    changes = spark.createDataFrame(
        [(i, day(n), v, st, r) for i, n, v, st, r in edits],
        "segment_id string, changed_on date, version bigint, status string, rules string")
    versions = sg.definition_versions(changes, F.lit(day(95)).cast("date"))
    assert sorted((r.segment_id, r.valid_from, r.valid_to, r.version, r.rules) for r in versions.collect()) == [
        ("s", day(0), day(5), 1, "x"), ("s", day(5), day(9), 3, "z"), ("u", day(3), None, 8, "u")]
    views = [("s", -1), ("s", 0), ("s", 4), ("s", 5), ("s", 5), ("s", 8), ("s", 9), ("s", 13), ("t", 0), ("u", 2), ("u", 400), ("none", 1)]
    rows_ = spark.createDataFrame([(i, day(n)) for i, n in views] + [("s", None)], "segment_id string, day date")
    got = sorted(((r.segment_id, r.day, r.version) for r in sg.version_on(rows_, versions, "day").collect()), key=str)
    held = {("s", 0): 1, ("s", 4): 1, ("s", 5): 3, ("s", 8): 3, ("u", 400): 8}
    assert got == sorted([(i, day(n), held.get((i, n))) for i, n in views] + [("s", None, None)], key=str)


def test_sizes_of_two_sets(spark):
    m = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", "2"), ("b", "3"), ("c", "4")], "segment_id string, device_id string")
    assert tuple(sg.set_sizes(m, "a", "b").first()) == (3, 1, 1, 1)
    assert tuple(sg.set_sizes(m.limit(0), "a", "b").first()) == (0, 0, 0, 0)
