"""Continuous ingest of a landing folder into an event table.

Files come as physical lines with their path and place. The file source gives all lines of a file to
one micro-batch, so records over several lines are whole there, whatever the file's size
and splits. Every batch overwrites its own folder of the table and its own part of a ledger of the
files it took; a file that an earlier batch has taken, or that lies twice in one batch,
is left out. Both are functions of the batch, so a batch that is run again adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logtrail.operators.normalize import normalize_csv, normalize_syslog
from logtrail.session import stage
from logtrail.sources.csv import cells_of, clean_header, stitch_records
from logtrail.sources.files import row_order
from logtrail.sources.syslog import parse_syslog

#: What makes two files the same delivery: their path, or their name and size wherever they lie.
SAME_FILE = {"path": ("file_path",), "name_and_size": ("file_name", "file_size")}
_LEDGER = "file_path string, file_name string, file_size long, batch long"


def _new_files(lines: DataFrame, ledger: str, batch_id: int, same: tuple[str, ...]) -> DataFrame:
    """The files of a batch that count, written to the ledger: the first by path of those that are the same, unless taken before."""
    spark = lines.sparkSession
    files = lines.select("file_path", "file_name", "file_size").distinct()
    first = F.row_number().over(Window.partitionBy(*same).orderBy("file_path")) == 1
    here = files.withColumn("_first", first).filter("_first").drop("_first")
    if batch_id > 0:
        # written by batches before this one; the parts of later ones are from a run that is being repeated
        before = spark.read.schema(_LEDGER).parquet(f"{ledger}/*").filter(F.col("batch") < batch_id)
        here = here.join(before.select(*same).distinct(), list(same), "left_anti")
    here.withColumn("batch", F.lit(batch_id).cast("long")).select("file_path", "file_name", "file_size", "batch").write.mode("overwrite").parquet(
        f"{ledger}/part-of-{batch_id}"
    )
    return spark.read.schema(_LEDGER).parquet(f"{ledger}/part-of-{batch_id}")


def ingest(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    assumed_year: int | None = None,
    csv_header: list[str] | None = None,
    delimiter: str = ",",
    ingest_ts: Column | None = None,
    models=None,
    trigger: dict | None = None,
    same_file: str = "path",
    **options,
) -> StreamingQuery:
    """Parse and normalise files as they arrive and add them to the event table.

    Syslog files by default, delimited files with a header line when ``csv_header`` names the
    columns. Every file is taken once: ``same_file`` tells whether files are told apart by ``path`` or
    by ``name_and_size``, for senders that deliver again into other folders. ``source_file`` is
    the full path. ``options`` go to the file source (``maxFilesPerTrigger``, ``recursiveFileLookup``).
    """
    ingest_ts = F.current_timestamp() if ingest_ts is None else ingest_ts
    if csv_header is None and assumed_year is None:
        raise ValueError("syslog lines carry no year: give assumed_year")
    same = SAME_FILE[same_file]
    hidden = {"file_path": "file_path", "file_name": "file_name", "file_size": "file_size", "file_block_start": "block_start"}
    origin = [F.col(f"_metadata.{c}").alias(name) for c, name in hidden.items()]
    stream = spark.readStream.format("text").options(**options).load(landing).select("value", *origin)

    def write(batch: DataFrame, batch_id: int) -> None:
        lines = stage(batch.withColumn("row_no", row_order(F.col("block_start"))), "landed")
        lines = lines.join(_new_files(lines, f"{table}/ledger", batch_id, same).select("file_path"), "file_path")
        placed = {"source_file": F.col("file_path"), "file_seq": F.lit(batch_id)}
        if csv_header is None:
            given = lines.withColumns(placed).select("value", "source_file", "file_seq", "row_no")
            made = normalize_syslog(parse_syslog(given, assumed_year, ingest_ts), models)
        else:
            records = stitch_records(lines.select("file_path", "file_name", "block_start", "row_no", "value")).filter("trim(value) <> ''")
            header = records.groupBy("file_path").agg(F.min("row_no").alias("header_no"))
            body = records.join(header, "file_path").filter("row_no <> header_no").withColumns(placed)
            made = normalize_csv(cells_of(body, [clean_header(c) for c in csv_header], delimiter), ingest_ts, models)
        made.write.mode("overwrite").parquet(f"{table}/events/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def ingested(spark: SparkSession, table: str) -> DataFrame:
    """The event table that ``ingest`` fills, with the number of the ``batch``."""
    return spark.read.option("basePath", f"{table}/events").parquet(f"{table}/events/batch=*")
