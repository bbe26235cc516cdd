"""File origin columns and row order within a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITION_BITS = 33


def row_order(block_start: Column | None = None) -> Column:
    """A number that grows with the position of a row in its file.

    A split knows its byte offset in the file but not its line numbers, so the
    order is (offset of the split in MiB, position in the task). Splits are at
    least 1 MiB apart and a file is below 1 PiB, so both fit in one long. ``block_start``
    is the offset, by default that of a frame just read.
    """
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    block = F.shiftright(F.col("_metadata.file_block_start") if block_start is None else block_start, 20)
    return F.shiftleft(block, POSITION_BITS) + position


def chosen(df: DataFrame, keep: Column | None) -> DataFrame:
    """A frame just read, of the files for which ``keep`` holds; a predicate on the path alone prunes files."""
    return df if keep is None else df.filter(keep)


def with_origin(df: DataFrame, file_seq: int = 0, identity: str = "file_name") -> DataFrame:
    """Add ``source_file``, ``file_seq`` and ``row_no`` to a frame just read from files.

    ``identity`` is what ``source_file`` holds: ``file_name``, or ``file_path`` where files
    of several folders are told apart.
    """
    return df.select(
        "*",
        F.col(f"_metadata.{identity}").alias("source_file"),
        F.lit(file_seq).alias("file_seq"),
        row_order().alias("row_no"),
    )
