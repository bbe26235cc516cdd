"""Which reader takes which file, and reading a mixed set of files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrail.operators.normalize import (
    normalize_csv,
    normalize_packets,
    normalize_syslog,
    normalize_windows,
)
from logtrail.operators.ordering import with_ordinal
from logtrail.sources.csv import read_csv
from logtrail.sources.isolate import read_isolated
from logtrail.sources.packets import read_captures, read_packet_table, table_schema
from logtrail.sources.syslog import read_syslog
from logtrail.sources.winevent import read_windows_events

# File extensions and the kind of log they hold.
EXTENSION_KINDS = {
    ".csv": "csv",
    ".log": "syslog",
    ".txt": "syslog",
    ".syslog": "syslog",
    ".xml": "windows",
    ".pcap": "capture",
    ".parquet": "packets",
    ".json": "packets",
}
# Known log formats whose binary container Spark cannot read; they are rejected with a hint.
UNREADABLE = {".evtx": "export the events as XML", ".pcapng": "convert the capture to .pcap"}

# Compressions that Spark's text readers undo; the extension is the one before.
COMPRESSIONS = (".gz", ".bz2")
_TEXT_KINDS = ("csv", "syslog", "windows")

_EXTENSION = r"(\.[^./\\]+)$"
_COMPRESSED = r"(\.[^./\\]+)(?:" + "|".join(c.replace(".", r"\.") for c in COMPRESSIONS) + ")$"


def supported_extensions(spark: SparkSession) -> DataFrame:
    """The supported extensions, sorted."""
    values = ", ".join(f"('{e}')" for e in sorted(EXTENSION_KINDS))
    return spark.sql(f"SELECT extension FROM VALUES {values} AS t(extension) ORDER BY extension")


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Path, name and size of every file under the paths; contents are not read.

    ``path`` is how a reader names the file, ``file_path`` how the rows read from it do.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(paths)
        .select(
            "path",
            F.element_at(F.split("path", "/"), -1).alias("name"),
            F.col("length").alias("size"),
            F.col("_metadata.file_path").alias("file_path"),
        )
    )


def dedupe_inputs(files: DataFrame) -> DataFrame:
    """One file per (name, size), the first path: what an upload dialog takes for the same file.

    A folder scan must not use it unasked: logs of several hosts often agree in both.
    """
    others = [c for c in files.columns if c not in ("name", "size")]
    return files.groupBy("name", "size").agg(F.min_by(F.struct(*others), "path").alias("f")).select("name", "size", "f.*")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def route_inputs(files: DataFrame) -> DataFrame:
    """Add ``extension``, ``kind`` and, for files no reader takes, ``reason``."""
    inner = F.regexp_extract(F.lower("name"), _COMPRESSED, 1)
    text_inside = F.coalesce(_lookup(EXTENSION_KINDS, inner), F.lit("")).isin(*_TEXT_KINDS)
    extension = F.when(text_inside, inner).otherwise(F.lower(F.regexp_extract("name", _EXTENSION, 1)))
    routed = files.withColumn("extension", extension).withColumn("kind", _lookup(EXTENSION_KINDS, F.col("extension")))
    supported = ", ".join(sorted(EXTENSION_KINDS))
    why = F.concat(
        F.lit("Unsupported file type: '"),
        F.col("extension"),
        F.lit("'. "),
        F.coalesce(
            F.concat(_lookup(UNREADABLE, F.col("extension")), F.lit(".")), F.lit(f"Supported types: {supported}")
        ),
    )
    return routed.withColumn("reason", F.when(F.col("kind").isNull(), why))


def plan_inputs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files with their kind, and rejected files with the reason."""
    routed = route_inputs(files)
    return (
        routed.filter("kind IS NOT NULL").drop("reason"),
        routed.filter("kind IS NULL").drop("kind"),
    )


@dataclass
class LogInputs:
    """Normalised events per input group, the files left out with the reason, and the failed groups."""

    frames: list[DataFrame] = field(default_factory=list)
    rejected: DataFrame | None = None
    failed: list[tuple[str, str]] = field(default_factory=list)
    files: DataFrame | None = None

    def file_counts(self) -> DataFrame:
        """``path, source_file, records`` of every file that was read; files of one name stay apart."""
        counts = self.union().groupBy("file_seq").agg(F.count("*").alias("records"))
        found = self.files.withColumn("file_seq", F.col("place").cast("int")).join(counts, "file_seq", "left")
        return found.select("path", F.col("name").alias("source_file"), F.coalesce("records", F.lit(0).cast("long")).alias("records"))

    def union(self) -> DataFrame:
        if not self.frames:
            raise ValueError("No records could be read from the input files")
        out = self.frames[0]
        for frame in self.frames[1:]:
            out = out.unionByName(frame)
        return out


def file_counts(events: DataFrame) -> DataFrame:
    """Number of records per source file."""
    return events.groupBy("source_file").agg(F.count("*").alias("records"))


def read_logs(
    spark: SparkSession,
    paths: str | list[str],
    assumed_year: int,
    ingest_ts: Column | None = None,
    models=None,
    skip_same_name_and_size: bool = False,
    isolate: bool = True,
) -> LogInputs:
    """Read and normalise every supported file under ``paths``.

    Files are grouped by extension and each group is one scan by name pattern, so plan and
    driver grow with the number of formats, not of files. Every file is read; only
    with ``skip_same_name_and_size`` are later files of the same name and size left out, and then
    listed in ``rejected``. A file's place decides ties in time: the position of the argument it
    lies under, then kind, extension and path, by one rule for any number of files.

    A file that cannot be read (a broken archive, a table without a footer) gives no event
    but a row of ``rejected`` with the reason, and the others go on; for this each group is read
    once and staged. With ``isolate=False`` the frames stay lazy and such a file fails the run that
    reads them. A group that cannot be planned at all is reported in ``failed``.
    """
    ingest_ts = F.current_timestamp() if ingest_ts is None else ingest_ts
    accepted, rejected = plan_inputs(list_files(spark, paths))
    out = LogInputs(rejected=rejected.select("path", "reason"))
    skipped = None
    if skip_same_name_and_size:
        skipped = accepted.join(dedupe_inputs(accepted).select("path"), "path", "left_anti")
        accepted = accepted.join(skipped.select("path"), "path", "left_anti")
        out.rejected = out.rejected.union(skipped.select("path", F.lit("Same name and size as another file").alias("reason")))
    places = _file_places(accepted, paths)
    # One row per extension.
    unreadable: list[tuple[str, str]] = []
    groups = sorted((r.kind, r.extension) for r in accepted.select("kind", "extension").distinct().collect())
    for kind, extension in groups:

        def read(keep: Column | None, kind: str = kind, extension: str = extension) -> list[DataFrame]:
            frames = _read_group(spark, paths, kind, extension, keep, assumed_year, ingest_ts, models)
            return [_placed(f, places) for f in frames]

        try:
            if isolate:
                mine = accepted.filter((F.col("kind") == kind) & (F.col("extension") == extension))
                found = read_isolated(mine, read, f"events-{kind}")
                out.frames += found.frames
                unreadable += found.rejected
            else:
                out.frames += read(None)
        except Exception as exc:  # noqa: BLE001  one bad group must not stop the others
            out.failed.append((f"{kind}: {extension} file(s)", str(exc)))
    if unreadable:
        rows = spark.createDataFrame(sorted(unreadable), "path string, reason string")
        out.rejected = out.rejected.union(rows)
        places = places.join(rows, "path", "left_anti")
    out.files = places
    if not out.frames:
        reasons = [tuple(r) for r in out.rejected.limit(10).collect()]
        raise ValueError(f"No records could be read; rejected: {reasons}, failed: {out.failed}")
    return out


def _qualified(spark: SparkSession, path: str) -> str:
    """An argument as the file listing writes paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def _file_places(files: DataFrame, paths: str | list[str]) -> DataFrame:
    """``path, file_path, name, place``: a dense rank of every file, by the argument it lies under and its path."""
    spark = files.sparkSession
    listed = [paths] if isinstance(paths, str) else paths
    places = [(_qualified(spark, p), k) for k, p in enumerate(listed) if not set(p) & set("*?[{")]
    arguments = spark.createDataFrame(places, "above string, position long").groupBy("above").agg(F.min("position").alias("position"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    under = files.select("path", F.explode(above).alias("above")).join(arguments, "above").groupBy("path").agg(F.min("position").alias("position"))
    order = [F.asc_nulls_last("position"), F.col("kind"), F.col("extension"), F.col("path")]
    wide = files.select("path", "file_path", "name", "kind", "extension").join(under, "path", "left")
    return with_ordinal(wide, order, "place", "files").select("path", "file_path", "name", "place")


def _placed(events: DataFrame, places: DataFrame) -> DataFrame:
    """Events whose ``source_file`` is a path, with the file's place as ``file_seq`` and its name for display.

    The place tells files of one name apart in the order; files that were left out have none.
    """
    found = events.withColumnRenamed("source_file", "_path").join(places.drop("path"), F.col("_path") == F.col("file_path"))
    named = {"source": F.when(F.col("source") == F.col("_path"), F.col("name")).otherwise(F.col("source")), "source_file": F.col("name")}
    return found.withColumns(named | {"file_seq": F.col("place").cast("int")}).select(events.columns)


def _read_group(
    spark,
    paths: str | list[str],
    kind: str,
    extension: str,
    keep: Column | None,
    assumed_year: int,
    ingest_ts: Column,
    models,
) -> list[DataFrame]:
    pattern = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in extension)
    if kind in _TEXT_KINDS:
        pattern += "{,%s}" % ",".join(COMPRESSIONS)
    options = {"recursiveFileLookup": True, "pathGlobFilter": f"*{pattern}"}
    how = {"identity": "file_path", "keep": keep, **options}
    if kind == "csv":
        return [normalize_csv(f, ingest_ts, models) for f in read_csv(spark, paths, **how)]
    if kind == "syslog":
        return [normalize_syslog(read_syslog(spark, paths, assumed_year, ingest_ts, **how), models)]
    if kind == "windows":
        return [normalize_windows(read_windows_events(spark, paths, **how), ingest_ts)]
    if kind == "capture":
        return [normalize_packets(read_captures(spark, paths, **how), ingest_ts)]
    schema = table_schema(spark, paths, extension[1:], **options)
    return [normalize_packets(read_packet_table(spark, paths, extension[1:], schema=schema, **how), ingest_ts)]
