"""Delimited files: delimiter detection, header cleaning, scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtrail.functions.text import strip
from logtrail.session import stage
from logtrail.sources.files import chosen, row_order

# Candidate delimiters in order of preference.
DELIMITERS = (",", "\t", ";", "|")

_HEAD_LINES = 20
ORIGIN_COLUMNS = ("source_file", "file_seq", "row_no")


def clean_header(name: str) -> str:
    """Header cell to column name: stripped, lower case, blanks to underscores."""
    return name.strip().lower().replace(" ", "_")


def _delimiter_counts(line: Column) -> list[Column]:
    """Occurrences of each candidate outside double quotes."""
    bare = F.regexp_replace(line, r'"[^"]*"', "")
    return [F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))) for d in DELIMITERS]


def _with_place(text: DataFrame) -> DataFrame:
    """Physical lines just read with their file, the split they begin in and their place in it."""
    return text.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block_start"),
        row_order().alias("row_no"),
    )


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def inspect_files(spark: SparkSession, paths: str | list[str], keep: Column | None = None, **options) -> DataFrame:
    """One row per file: path, header line, delimiter, and whether records span lines.

    The delimiter is the candidate of the header line whose number of occurrences
    most of the first lines share; among several the most frequent, comma if none.
    A physical line with an odd number of quotes shows that fields span lines.
    """
    lines = _with_place(chosen(spark.read.options(**options).text(paths), keep))
    ordered = Window.partitionBy("file_path").orderBy("row_no")
    head = (
        lines.filter("block_start = 0 AND trim(value) <> ''")
        .select("file_path", "value", "row_no", F.row_number().over(ordered).alias("n"))
        .filter(F.col("n") <= _HEAD_LINES)
    )
    counts = {f"count_{i}": c for i, c in enumerate(_delimiter_counts(F.col("value")))}
    in_header = {f"header_{i}": F.first(f"count_{i}").over(Window.partitionBy("file_path").orderBy("n")) for i in range(4)}
    like_header = [F.avg((F.col(f"count_{i}") == F.col(f"header_{i}")).cast("int")) for i in range(4)]
    scores = [
        F.when(F.max(f"header_{i}") > 0, F.struct(like_header[i].alias("share"), F.max(f"header_{i}").alias("cells")))
        for i in range(4)
    ]
    stats = (
        head.withColumns(counts)
        .withColumns(in_header)
        .groupBy("file_path")
        .agg(
            F.min_by("value", "n").alias("header"),
            *[s.alias(f"score_{i}") for i, s in enumerate(scores)],
        )
    )
    best = F.greatest(*[F.col(f"score_{i}") for i in range(4)])
    delimiter = reduce(
        lambda rest, i: F.when(F.col(f"score_{i}") == best, F.lit(DELIMITERS[i])).otherwise(rest),
        reversed(range(4)),
        F.lit(DELIMITERS[0]),
    )
    spanning = lines.groupBy("file_path").agg(F.bool_or(_quotes(F.col("value")) % 2 == 1).alias("multi_line"))
    return stats.join(spanning, "file_path").select(
        "file_path", F.regexp_replace("header", r"^\uFEFF", "").alias("header"), delimiter.alias("delimiter"), "multi_line"
    )


def stitch_records(lines: DataFrame) -> DataFrame:
    """Physical lines to records, whose quoted cells may hold line ends: ``value`` is the record, its place that of its first line."""
    return _joined(_marked(lines))


def _marked(lines: DataFrame) -> DataFrame:
    """Staged lines with the place of the record that begins last in their split, and whether they begin one.

    ``lines`` has ``file_path, file_name, block_start, row_no, value``. Within a split, sums of quotes tell
    which lines begin a record, given whether the split begins inside quotes; and that is the
    parity of all quotes in the splits before it, of which each is one number. So splits
    are worked on apart, and only the lines of records over several lines are shuffled again.
    """
    split = ["file_path", "block_start"]
    counted = lines.withColumn("_q", _quotes(F.col("value")))
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    parity = counted.groupBy(*split).agg(F.sum("_q").alias("_all")).select(*split, F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_carry"))
    in_split = Window.partitionBy(*split).orderBy("row_no")
    so_far = F.col("_carry") + F.sum("_q").over(in_split) - F.col("_q")
    marked = counted.join(parity, split).withColumn("_starts", so_far % 2 == 0)
    begun = F.last(F.when(F.col("_starts"), F.col("row_no")), ignorenulls=True).over(in_split)
    return stage(marked.withColumn("_record", begun).drop("_carry"), "csv-lines")


def _joined(flagged: DataFrame) -> DataFrame:
    """Records of marked lines."""
    split = ["file_path", "block_start"]
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    alone = F.col("_starts") & (F.col("_q") % 2 == 0)
    kept = ["file_path", "file_name", "row_no", "value"]
    pieces = flagged.filter(~alone)
    # lines before the first start of a split go on with the last record begun before it
    last = flagged.groupBy(*split).agg(F.max("_record").alias("_last")).select(*split, F.last("_last", ignorenulls=True).over(before).alias("_earlier"))
    owned = pieces.join(last, split).withColumn("_record", F.coalesce("_record", "_earlier"))
    parts = F.array_sort(F.collect_list(F.struct("row_no", "value")))
    whole = owned.groupBy("file_path", "file_name", F.col("_record").alias("row_no")).agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    return flagged.filter(alone).select(*kept).unionByName(whole.select(*kept))


def cells_of(rows: DataFrame, names: list[str], delimiter: str, parsed: bool = False) -> DataFrame:
    """Trimmed cells under cleaned ``names``, with ``source_file, file_seq, row_no``.

    ``rows`` has the record as text in ``value``, or its cells ``_c0, ...`` if ``parsed``.
    """
    names = [f"{name}_" if name in ORIGIN_COLUMNS else name for name in names]
    if not parsed:
        record = F.from_csv("value", F.lit(_schema(names)), _dialect(delimiter))
        rows = rows.withColumn("_r", record).select("_r.*", *ORIGIN_COLUMNS)
    # A repeated header name keeps its last column, as in a record keyed by name.
    position = {name: i for i, name in enumerate(names)}
    cells = [F.coalesce(strip(F.col(f"_c{i}")), F.lit("")).alias(name) for name, i in position.items() if name]
    return rows.select(*cells, *ORIGIN_COLUMNS)


def _schema(names: list[str]) -> str:
    return ", ".join(f"_c{i} STRING" for i in range(len(names)))


def _dialect(delimiter: str) -> dict[str, str]:
    return {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _read_group(opened, delimiter: str, header: str, multi_line: bool, file_seq: int, identity: str) -> DataFrame:
    """Records of the files that ``opened`` reads with a reader, without their headers."""
    names = [clean_header(cell) for cell in _header_cells(header, delimiter)]
    seq = F.lit(file_seq).alias("file_seq")
    if not multi_line:
        how = {"header": True, "enforceSchema": True, **_dialect(delimiter)}
        raw = opened(lambda reader, paths: reader.schema(_schema(names)).options(**how).csv(paths))
        rows = raw.select("*", F.col(f"_metadata.{identity}").alias("source_file"), seq, row_order().alias("row_no"))
        return cells_of(rows, names, delimiter, parsed=True)
    lines = _marked(_with_place(opened(lambda reader, paths: reader.text(paths))))
    # a task may read several files, and which ones differs from scan to scan: places are of the scan at hand
    headers = lines.filter("block_start = 0 AND trim(value) <> ''").groupBy("file_path").agg(F.min("row_no").alias("header_no"))
    body = _joined(lines).join(headers, "file_path").filter("row_no <> header_no AND trim(value) <> ''")
    return cells_of(body.select("value", F.col(identity).alias("source_file"), seq, "row_no"), names, delimiter)


def _header_cells(header: str, delimiter: str) -> list[str]:
    """Cells of one header line; quotes around a cell are dropped."""
    cells, cell, quoted = [], "", False
    for ch in header:
        if ch == '"':
            quoted = not quoted
        elif ch == delimiter and not quoted:
            cells.append(cell)
            cell = ""
        else:
            cell += ch
    return [*cells, cell]


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    file_seq: int = 0,
    delimiter: str | None = None,
    identity: str = "file_name",
    keep: Column | None = None,
    **options,
) -> list[DataFrame]:
    """Read delimited files; one frame per distinct header and delimiter.

    Cells are trimmed, missing cells are '', surplus cells are dropped. Frames
    stay apart because the column order of a record matters to its message
    fallback. Files of any size are read by many tasks, also where records span lines.
    ``keep`` is a predicate on ``_metadata`` that chooses among the files. Header lines pass
    through the driver, and names of files only where headers differ.
    """
    inspected = stage(inspect_files(spark, paths, keep, **options), "csv-headers")
    if delimiter is not None:
        inspected = inspected.withColumn("delimiter", F.lit(delimiter))
    kinds = ["header", "delimiter", "multi_line"]
    groups = inspected.groupBy(*kinds).agg(F.min("file_path").alias("first")).orderBy("first").collect()

    def opener(group):
        mine = keep
        if len(groups) > 1:
            # the files of a group are chosen among those listed; with one group no path comes to the driver
            files = inspected.filter(reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(group[k]) for k in kinds])).select("file_path").toArrow()
            within = F.col("_metadata.file_path").isin(files.column(0).to_pylist())
            mine = within if keep is None else keep & within
        return lambda load: chosen(load(spark.read.options(**options), paths), mine)

    return [_read_group(opener(g), g.delimiter, g.header, g.multi_line, file_seq, identity) for g in groups]
