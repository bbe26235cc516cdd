from pyspark.sql import functions as F

from logtrail.functions.times import generic_timestamp, iso_text, syslog_timestamp, windows_timestamp

NOW = "2026-05-01 00:00:00"


def parsed(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", fn(F.col("t"), F.lit(NOW).cast("timestamp")).cast("string").alias("v")).orderBy("i")
    return [r.v for r in out.collect()]


def test_generic_times(spark):
    cases = {
        "2026-04-10T08:00:05+00:00": "2026-04-10 08:00:05",
        "2026-04-10T08:00:05Z": "2026-04-10 08:00:05",
        "2026-04-10T08:00:05+02:00": "2026-04-10 06:00:05",
        "2026-04-10 08:00:05.25": "2026-04-10 08:00:05.25",
        "2026-04-10": "2026-04-10 00:00:00",
        "20260410": "2026-04-10 00:00:00",
        "04/10/2026 08:00:05": "2026-04-10 08:00:05",
        "13/04/2026 08:00:05": "2026-04-13 08:00:05",
        "2026/04/10 08:00:05": "2026-04-10 08:00:05",
        "1712011200": "2024-04-01 22:40:00",
        "1712011200123": "2024-04-01 22:40:00.123",
        "1712011200.5": "2024-04-01 22:40:00.5",
        "2024": "1970-01-01 00:33:44",
        "31/31/2026 08:00:05": NOW,
        "nan": NOW,
        "1e300": NOW,
        "soon": NOW,
    }
    assert parsed(spark, generic_timestamp, list(cases)) == list(cases.values())


def test_windows_times(spark):
    cases = {
        "2026-04-10T08:00:05.1234567Z": "2026-04-10 08:00:05.123456",
        "04/10/2026 08:00:05": "2026-04-10 08:00:05",
        "": NOW,
        "yesterday": None,
    }
    assert parsed(spark, windows_timestamp, list(cases)) == list(cases.values())


def test_syslog_times(spark):
    cases = {
        "Apr  9 08:00:05": "2026-04-09 08:00:05",
        "apr 10 08:00:05": "2026-04-10 08:00:05",
        "Feb 29 08:00:05": NOW,  # 2026 is no leap year
        "2026-04-10T08:00:05Z": "2026-04-10 08:00:05",
        "2026-04-10 08:00:05": "2026-04-10 08:00:05",
        "1712011200.123": "2024-04-01 22:40:00.123",
        "": NOW,
    }
    assert parsed(spark, lambda t, now: syslog_timestamp(t, 2026, now), list(cases)) == list(cases.values())


def test_iso_text(spark):
    row = spark.sql(
        "SELECT TIMESTAMP '2026-04-10 08:00:05' AS a, TIMESTAMP '2026-04-10 08:00:05.25' AS b, CAST(NULL AS TIMESTAMP) AS c"
    ).select(*[iso_text(F.col(c)).alias(c) for c in "abc"])
    assert tuple(row.first()) == ("2026-04-10T08:00:05+00:00", "2026-04-10T08:00:05.250000+00:00", "")
