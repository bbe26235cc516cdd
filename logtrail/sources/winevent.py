"""Windows events exported as XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.functions.text import last_wins_map, strip
from logtrail.sources.files import POSITION_BITS, chosen

EVENT_XML_SCHEMA = """
    System STRUCT<
        Provider: STRUCT<_Name: STRING>,
        EventID: STRUCT<_VALUE: STRING, _Qualifiers: STRING>,
        Level: STRING, Keywords: STRING,
        TimeCreated: STRUCT<_SystemTime: STRING>,
        Channel: STRING, Computer: STRING>,
    EventData STRUCT<Data: ARRAY<STRUCT<_VALUE: STRING, _Name: STRING>>>,
    UserData STRING,
    _corrupt_record STRING
"""
END_TAG = "</Event>"
# Leaf elements of the UserData fragment: tag without prefix, attributes, text.
_LEAF = r"<(?:[\w.\-]+:)?([\w.\-]+)(?:\s[^<>]*)?>([^<>]*[^<>\s][^<>]*)<"


def _event_data(data: Column) -> Column:
    """Named data items; an item without a name is ``field_<position>``."""
    entries = F.transform(
        F.coalesce(data, F.array()),
        lambda d, i: F.struct(
            F.coalesce(d["_Name"], F.concat(F.lit("field_"), i.cast("string"))).alias("key"),
            F.coalesce(d["_VALUE"], F.lit("")).alias("value"),
        ),
    )
    return last_wins_map(entries)


def _unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _user_data(fragment: Column) -> Column:
    """Text of every element in the UserData fragment, keyed by tag."""
    text = F.coalesce(fragment, F.lit(""))
    entries = F.zip_with(
        F.regexp_extract_all(text, F.lit(_LEAF), F.lit(1)),
        F.regexp_extract_all(text, F.lit(_LEAF), F.lit(2)),
        lambda tag, value: F.struct(tag.alias("key"), _unescape(strip(value)).alias("value")),
    )
    return last_wins_map(entries)


def _elements(text: DataFrame, identity: str) -> DataFrame:
    """One row per ``<Event>`` element of files read up to each end tag: ``xml`` and its origin.

    A reader of delimited text finds the end of the element that a split's end cuts, and the
    next split begins after it, so files of any size are read by many tasks. An element that
    lacks its end tag stands alone before the next one and fails to parse.
    """
    origin = [
        F.col(f"_metadata.{identity}").alias("source_file"),
        F.shiftright(F.col("_metadata.file_block_start"), 20).alias("_block"),
    ]
    # the outer form gives the same, as there is a piece at least; before the other the text would be split twice more, to test that
    pieces = text.select(F.split("value", r"(?=<Event[\s>])").alias("_pieces"), *origin)
    each = pieces.select("source_file", "_block", F.size("_pieces").alias("_n"), F.posexplode_outer("_pieces").alias("_k", "_piece"))
    events = each.filter(F.col("_piece").rlike(r"^<Event[\s>]"))
    whole = F.when(F.col("_k") == F.col("_n") - 1, F.concat("_piece", F.lit(END_TAG))).otherwise(F.col("_piece"))
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return events.select(whole.alias("xml"), "source_file", (F.shiftleft("_block", POSITION_BITS) + position).alias("row_no"))


def read_windows_events(
    spark: SparkSession,
    paths: str | list[str],
    file_seq: int = 0,
    identity: str = "file_name",
    keep: Column | None = None,
    **options,
) -> DataFrame:
    """Read ``<Event>`` elements; an unreadable one becomes a ``parse_error`` record.

    ``options`` go to the reader, ``keep`` is a predicate on ``_metadata`` that chooses among the
    files. Files are UTF-8, and the end tag is written ``</Event>``.
    """
    text = chosen(spark.read.options(lineSep=END_TAG, **options).text(paths), keep)
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    raw = _elements(text, identity).withColumn("_e", F.from_xml("xml", EVENT_XML_SCHEMA, how)).select("_e.*", "source_file", "row_no")
    bad = F.col("_corrupt_record").isNotNull()

    def text_of(path: str) -> Column:
        return F.when(~bad, F.coalesce(F.col(path), F.lit(""))).otherwise(F.lit(""))

    event_id = F.when(bad, F.lit("parse_error")).otherwise(F.coalesce("System.EventID._VALUE", F.lit("unknown")))
    return raw.select(
        strip(event_id).alias("event_id"),
        text_of("System.TimeCreated._SystemTime").alias("ts_raw"),
        text_of("System.Provider._Name").alias("provider"),
        text_of("System.Computer").alias("computer"),
        F.when(~bad, F.coalesce("System.Channel", F.lit(""))).alias("channel"),
        text_of("System.Level").alias("level"),
        text_of("System.Keywords").alias("keywords"),
        _event_data(F.when(~bad, F.col("EventData.Data"))).alias("event_data"),
        _user_data(F.when(~bad, F.col("UserData"))).alias("user_data"),
        F.when(bad, F.concat(F.lit("Failed to parse record: "), F.left("_corrupt_record", F.lit(200)))).alias("error"),
        "source_file",
        F.lit(file_seq).alias("file_seq"),
        "row_no",
    )
