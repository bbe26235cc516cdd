import pytest
from pyspark.sql import functions as F

from logtrail.operators import explore as ex
from logtrail.operators.annotate import NO_ALERTS
from logtrail.operators.summary import risk, risk_level, top_attackers


def annotated(spark, n, alerted=()):
    hit = F.array(F.struct(F.lit("new_ip"), F.lit("high"), F.lit("t"), F.lit(1).cast("bigint"))).cast(NO_ALERTS)
    return spark.range(n).select(
        F.col("id").alias("event_idx"),
        F.timestamp_seconds("id").alias("timestamp"),
        F.concat(F.lit("E"), F.col("id") % 7).alias("event_id"),
        F.when(F.col("id") % 2 == 0, "network").otherwise("other").alias("category"),
        F.lit("info").alias("severity"),
        F.concat(F.lit("message "), F.col("id")).alias("message"),
        F.when(F.col("id").isin(*alerted), hit).otherwise(F.array().cast(NO_ALERTS)).alias("alerts"),
    )


def indices(df):
    return [r.event_idx for r in df.collect()]


def test_pages(spark):
    df = annotated(spark, 120)
    assert indices(ex.page(df, 2)) == list(range(50, 100))
    assert indices(ex.page(df, 99)) == list(range(100, 120))
    assert indices(ex.page(df, 0, size=3, ascending=False)) == [119, 118, 117]
    info = ex.page_info(df, 99).first()
    assert (info.total, info.pages, info.page, info.first_row, info.last_row) == (120, 3, 3, 101, 120)
    assert ex.page_info(df.filter("false")).first().first_row == 0


def test_deep_pages_equal_shallow_ones(spark, monkeypatch):
    df = annotated(spark, 300)
    shallow = indices(ex.page(df, 4, sort_by="event_id"))
    monkeypatch.setattr(ex, "_TOP_ROWS", 10)
    assert indices(ex.page(df, 4, sort_by="event_id")) == shallow


@pytest.mark.parametrize("size", [7, 50, 1000])
def test_pages_of_one_index(spark, size):
    df = annotated(spark, 300, (3, 41))
    index = ex.page_index(df.repartition(5), sort_by="event_id", ascending=False)
    ordered = indices(df.orderBy(*ex.sort_keys("event_id", False)))
    pages = [indices(index.page(k, size)) for k in range(1, -(-300 // size) + 1)]
    assert [i for p in pages for i in p] == ordered and index.total == 300
    assert indices(index.page(10**6, size)) == pages[-1]
    assert indices(ex.page_index(df.filter("false")).page(3)) == []


def test_a_page_opens_the_files_of_its_range_only(spark):
    df = spark.range(20_000).selectExpr("id AS event_idx", "timestamp_seconds(id) AS timestamp")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = ex.page_index(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(index.ranges) > 1 and index.page(10**6).count() == 50
    read = index.ordered.filter(F.col("_range") == index.ranges[-1][0]).select(F.col("_metadata.file_path").alias("f"))
    assert {r.f.split("_range=")[1].split("/")[0] for r in read.distinct().collect()} == {str(index.ranges[-1][0])}


def test_events_of_a_rule_and_totals(spark):
    df = annotated(spark, 20, (3, 4)).drop("alerts")
    alerts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "alert_id long, rule_name string")
    members = spark.createDataFrame([(1, 5), (1, 6), (3, 6), (2, 7), (2, 99)], "alert_id long, event_idx long")
    assert indices(ex.events_of_rule(df, alerts, members, "a").orderBy("event_idx")) == [5, 6]
    assert tuple(ex.alerted_totals(df, members).first()) == (20, 3)


@pytest.mark.parametrize(
    ("n", "alerted", "expected"),
    [
        (10, (3,), list(range(10))),
        (100, (3, 41), [3, 41, 0, 6, 12, 18, 24, 30, 36, 42, 48, 54, 60, 66, 72, 78, 84, 90, 96]),
        (100, tuple(range(25)), list(range(20))),
    ],
)
def test_timeline_sample(spark, n, alerted, expected):
    assert indices(ex.timeline_sample(annotated(spark, n, alerted), max_items=20)) == expected


def test_timeline_items(spark):
    df = annotated(spark, 3, (1,)).withColumn("timestamp", F.when(F.col("event_idx") < 2, F.col("timestamp")))
    items = ex.timeline_items(df).orderBy("event_idx").collect()
    assert [(r.lane, r.title, r.has_alert) for r in items] == [
        ("network", "E0: message 0", False),
        ("system", "E1: message 1", True),
    ]


def alerts(spark, rows):
    schema = "alert_id long, rule_name string, severity string, title string, process string, source_ip string"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    return df.withColumn("alert_seq", F.struct(F.lit(0), F.col("alert_id"), F.col("alert_id")))


def test_alert_views(spark):
    df = alerts(
        spark,
        [
            ("new_ip", "high", "A", "web", "1.1.1.1"),
            ("new_ip", "critical", "B", "web", "1.1.1.1"),
            ("brute_force", "critical", "A", "", "2.2.2.2"),
            ("odd_rule", "medium", "A", "", ""),
            ("new_ip", "low", "A", "web", "1.1.1.1"),
        ],
    )
    assert [r.alert_id for r in ex.alerts_by_severity(df).collect()] == [1, 2, 0, 3, 4]
    profiles = ex.attacker_profiles(df).collect()
    assert [(r.identity, r.total, r.kinds, r.max_severity) for r in profiles] == [
        ("web::1.1.1.1", 3, 2, "critical"),
        ("2.2.2.2", 1, 1, "critical"),
        ("Internal/Unknown", 1, 1, "medium"),
    ]
    titles = {(r.identity, r.title): r.alerts for r in ex.attacker_titles(df).collect()}
    assert titles["web::1.1.1.1", "A"] == 2 and len(titles) == 4
    assert [(r.attacker, r.alert_count) for r in top_attackers(df).collect()] == [("web", 3), ("2.2.2.2", 1)]
    labels = {r.rule_name: r.label for r in ex.rules_present(df).collect()}
    assert labels == {"new_ip": "New IP", "brute_force": "Brute Force", "odd_rule": "odd rule"}
    counts = df.groupBy("rule_name").agg(F.count("*").alias("alerts"))
    cards = ex.detection_cards(counts).orderBy("card_no").collect()
    assert [(r.label, r.alerts, r.active) for r in cards][:3] == [
        ("Brute Force", 1, True),
        ("New IP", 3, True),
        ("Priv Escalation", 0, False),
    ]


def test_risk(spark):
    df = alerts(spark, [("r", s, "t", "", "") for s in ("critical", "high", "medium", "low", "odd")])
    assert tuple(risk(df).first()) == (5, 52, "high")
    assert tuple(risk(df.filter("false")).first()) == (0, 0, "low")
    assert tuple(risk(df.unionByName(df)).first())[1:] == (100, "critical")
    assert spark.range(1).select(risk_level(F.lit(15)).alias("x")).first().x == "medium"
