"""Search, filter, sort, page and sample the annotated timeline; views of the alerts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtrail.functions.text import first_present
from logtrail.operators.ordering import staged_order

# Searched columns, rule labels, severity ranks and display limits.
SEARCH_COLUMNS = ("message", "event_id", "source_ip", "username", "source")
RULE_LABELS = {
    "brute_force": "Brute Force",
    "new_ip": "New IP",
    "privilege_escalation": "Privilege Escalation",
    "file_access_anomaly": "File Access Anomaly",
    "data_exfiltration": "Data Exfiltration",
}
CARD_RULES = (
    ("brute_force", "Brute Force"),
    ("new_ip", "New IP"),
    ("privilege_escalation", "Priv Escalation"),
    ("file_access_anomaly", "File Access"),
    ("data_exfiltration", "Data Exfil"),
)
SEVERITY_ORDER = ("critical", "high", "medium", "low")
LANES = ("authentication", "network", "system", "file_access")
PAGE_SIZE = 50
SAMPLE_ITEMS = 2000
TITLE_CHARS = 200

_TOP_ROWS = 10_000


def severity_rank(severity: Column) -> Column:
    """0 for critical to 3 for low, 9 for anything else."""
    rank = F.lit(9)
    for i, name in enumerate(SEVERITY_ORDER):
        rank = F.when(severity == name, F.lit(i)).otherwise(rank)
    return rank


def search(events: DataFrame, term: str) -> DataFrame:
    """Case-insensitive substring search."""
    needle = F.lit(term.lower())
    hits = [F.contains(F.lower(F.coalesce(c, F.lit(""))), needle) for c in SEARCH_COLUMNS]
    return events.filter(reduce(lambda a, b: a | b, hits))


def with_rule(events: DataFrame, rule: str) -> DataFrame:
    """Annotated events that an alert of the rule refers to."""
    return events.filter(F.exists("alerts", lambda a: a["rule_name"] == rule))


def events_of_rule(events: DataFrame, alerts: DataFrame, members: DataFrame, rule: str) -> DataFrame:
    """Events that an alert of the rule refers to; nothing is annotated for it."""
    wanted = members.join(alerts.filter(F.col("rule_name") == rule).select("alert_id"), "alert_id", "left_semi")
    return events.join(wanted.select("event_idx").distinct(), "event_idx", "left_semi")


def sort_keys(sort_by: str = "timestamp", ascending: bool = True) -> list[Column]:
    """Case-insensitive order of one column, missing values as ''; ties in timeline order."""
    key = F.col(sort_by) if sort_by == "timestamp" else F.lower(F.coalesce(sort_by, F.lit("")))
    return [key.asc_nulls_first() if ascending else key.desc_nulls_last(), F.col("event_idx").asc()]


def explore(
    events: DataFrame,
    search_term: str | None = None,
    rule: str | None = None,
    severity: str | None = None,
    category: str | None = None,
) -> DataFrame:
    """Filtered events: search, attack rule, severity and category."""
    out = search(events, search_term) if search_term else events
    out = with_rule(out, rule) if rule else out
    out = out.filter(F.col("severity") == severity) if severity else out
    return out.filter(F.col("category") == category) if category else out


def page(
    filtered: DataFrame,
    number: int = 1,
    size: int = PAGE_SIZE,
    sort_by: str = "timestamp",
    ascending: bool = True,
    total: int | None = None,
) -> DataFrame:
    """One page of the sorted rows; the page number is clamped to the pages there are.

    Early pages are a top-k. Deep ones are cut out of a staged order, since a top-k
    of that size would pass through one task; keep a ``page_index`` to read many of them.
    """
    total = filtered.count() if total is None else total
    last = max(1, -(-total // size))
    start = (max(1, min(number, last)) - 1) * size
    if start + size <= _TOP_ROWS:
        return filtered.orderBy(*sort_keys(sort_by, ascending)).offset(start).limit(size)
    return page_index(filtered, sort_by, ascending).page(number, size)


@dataclass(frozen=True)
class PageIndex:
    """Rows in one order as a table with a folder per range of it, and the ranges with their first places."""

    ordered: DataFrame
    ranges: list[tuple[int, int]]
    total: int

    def page(self, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
        """One page, read from the one or two folders that hold it; the number is clamped to the pages there are."""
        last = max(1, -(-self.total // size))
        start = (max(1, min(number, last)) - 1) * size
        ends = [first for _, first in self.ranges[1:]] + [self.total]
        wanted = [
            (F.col("_range") == part) & F.col("_pos").between(start - first, start + size - first - 1)
            for (part, first), end in zip(self.ranges, ends, strict=False)
            if first < start + size and start < end
        ]
        rows = self.ordered.filter(reduce(lambda a, b: a | b, wanted, F.lit(False)))
        return rows.orderBy("_range", "_pos").drop("_range", "_pos")


def page_index(filtered: DataFrame, sort_by: str = "timestamp", ascending: bool = True) -> PageIndex:
    """The order that all pages of a sorted view are cut from: one sort, whatever the number of pages read later."""
    return PageIndex(*staged_order(filtered, sort_keys(sort_by, ascending), "pages"))



def page_info(filtered: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One row: total, pages, clamped page, and the rows that the page shows."""
    counted = filtered.agg(F.count("*").alias("total")).withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint")
    )
    clamped = counted.withColumn("page", F.greatest(F.lit(1), F.least(F.lit(number), F.col("pages"))).cast("bigint"))
    start = (F.col("page") - 1) * size
    return clamped.withColumns(
        {
            "first_row": F.when(F.col("total") > 0, start + 1).otherwise(0).cast("bigint"),
            "last_row": F.least(start + size, F.col("total")).cast("bigint"),
        }
    )


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    """Alerts, most severe first, then in alert order."""
    return alerts.orderBy(severity_rank(F.col("severity")), "alert_seq")


def _attackers(alerts: DataFrame) -> DataFrame:
    process, ip = F.col("process"), F.col("source_ip")
    identity = (
        F.when(process != "", F.concat(process, F.lit("::"), ip)).when(ip != "", ip).otherwise("Internal/Unknown")
    )
    return alerts.select(
        identity.alias("identity"),
        first_present(process, ip, F.lit("Internal/Unknown")).alias("display_name"),
        F.when((process != "") & (ip != "-"), ip).otherwise("").alias("sub_name"),
        first_present(F.col("title"), F.col("rule_name")).alias("title"),
        F.least(severity_rank(F.col("severity")), F.lit(len(SEVERITY_ORDER) - 1)).alias("rank"),
        "alert_seq",
    )


def attacker_profiles(alerts: DataFrame) -> DataFrame:
    """One row per attacker identity, most alerts first: total, kinds and highest severity."""
    ranks = F.array(*[F.lit(s) for s in SEVERITY_ORDER])
    return (
        _attackers(alerts)
        .groupBy("identity", "display_name", "sub_name")
        .agg(
            F.count("*").alias("total"),
            F.count_distinct("title").alias("kinds"),
            F.get(ranks, F.min("rank")).alias("max_severity"),
            F.min("alert_seq").alias("first_seq"),
        )
        .orderBy(F.desc("total"), "first_seq")
        .drop("first_seq")
    )


def attacker_titles(alerts: DataFrame) -> DataFrame:
    """Alerts per attacker identity and title, one row each: titles can name any number of targets."""
    return _attackers(alerts).groupBy("identity", "title").agg(F.count("*").alias("alerts"))


def detection_cards(rule_counts: DataFrame) -> DataFrame:
    """Count per rule detector, zero where it found nothing."""
    rows = ", ".join(f"({i}, '{rule}', '{label}')" for i, (rule, label) in enumerate(CARD_RULES))
    rules = rule_counts.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS c(card_no, rule_name, label)")
    return rules.join(rule_counts, "rule_name", "left").select(
        "card_no",
        "rule_name",
        "label",
        F.coalesce("alerts", F.lit(0)).cast("bigint").alias("alerts"),
        (F.coalesce("alerts", F.lit(0)) > 0).alias("active"),
    )


def rules_present(alerts: DataFrame) -> DataFrame:
    """Rules that have alerts, with their labels."""
    labels = F.create_map(*[F.lit(x) for pair in RULE_LABELS.items() for x in pair])
    return (
        alerts.select("rule_name")
        .distinct()
        .withColumn(
            "label",
            F.coalesce(F.try_element_at(labels, F.col("rule_name")), F.replace("rule_name", F.lit("_"), F.lit(" "))),
        )
    )


def alerted_totals(events: DataFrame, members: DataFrame) -> DataFrame:
    """One row: ``n`` events and ``a`` of them alerted, counted without annotating any."""
    alerted = members.join(events.select("event_idx"), "event_idx", "left_semi").agg(F.count_distinct("event_idx"))
    return events.agg(F.count("*").alias("n")).withColumn("a", alerted.scalar())


def timeline_sample(events: DataFrame, max_items: int = SAMPLE_ITEMS, totals: DataFrame | None = None) -> DataFrame:
    """At most ``max_items`` annotated events for display: alerted ones first, then every k-th.

    All events are kept when they fit. When alerted events alone fill the display,
    no others are added. ``totals`` are from ``alerted_totals``; without them the annotated
    events are counted, and so made twice.
    """
    alerted = F.size("alerts") > 0
    totals = events.agg(F.count("*").alias("n"), F.count_if(alerted).alias("a")) if totals is None else totals
    step = totals.select(
        F.when(F.col("n") <= max_items, F.lit(0))
        .when(F.col("a") >= max_items, F.lit(-1))
        .otherwise(F.ceil(F.col("n") / (F.lit(max_items) - F.col("a"))))
        .cast("bigint")
    )
    stepped = events.withColumns({"_step": step.scalar(), "_alerted": alerted})
    every_kth = (F.col("_step") > 0) & (F.col("event_idx") % F.greatest(F.col("_step"), F.lit(1)) == 0)
    kept = stepped.filter((F.col("_step") == 0) | F.col("_alerted") | every_kth)
    return (
        kept.orderBy(F.when(F.col("_step") == 0, 0).when(F.col("_alerted"), 0).otherwise(1), "event_idx")
        .limit(max_items)
        .drop("_step", "_alerted")
    )


def timeline_items(sample: DataFrame) -> DataFrame:
    """Display items: lane, start, content and title; events without a time are left out."""
    return sample.filter("timestamp IS NOT NULL").select(
        "event_idx",
        F.when(F.col("category").isin(*LANES), F.col("category")).otherwise("system").alias("lane"),
        F.col("timestamp").alias("start"),
        F.col("event_id").alias("content"),
        F.left(F.concat("event_id", F.lit(": "), "message"), F.lit(TITLE_CHARS)).alias("title"),
        "severity",
        (F.size("alerts") > 0).alias("has_alert"),
    )
