"""Reading a set of files so that an unreadable one is reported and the others go on.

A scan fails as a whole when one of its files cannot be read. The failed set is then split by a
hash of the path and each part is read again as a scan of its own, until the unreadable file is
alone. The parts are predicates on the path that Spark uses to prune files before it
opens them; no list of paths passes through the driver, and work grows with the number of
unreadable files, not with that of all. Only errors that Spark itself lays to a file's
content or absence are isolated; anything else (an executor lost for good, a full disk) is raised.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtrail.session import stage

#: Parts that a failed set is split into; they are read at the same time.
PARTS = 16

FILE_PATH = "_metadata.file_path"
_AT_FAULT = re.compile(r"\[FAILED_READ_FILE[.\w]*\]|\[CANNOT_READ_FILE_FOOTER\]|UnreadableCapture")
_NAMED = re.compile(r"(?:reading file|footer for file:?|file status of file) (\S+?)[.,]?(?:\s|$)")
_CAUSE = re.compile(r"^(?:Caused by: (?:[\w$]+\.)*|[\w.]*(?=UnreadableCapture))([\w$]+(?:: .*)?)$", re.MULTILINE)


@dataclass
class Isolated:
    """What could be read, as staged tables, and (path, reason) of the files that could not."""

    frames: list[DataFrame] = field(default_factory=list)
    rejected: list[tuple[str, str]] = field(default_factory=list)

    def add(self, other: Isolated) -> None:
        self.frames += other.frames
        self.rejected += other.rejected


def _part(level: int, number: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.col(FILE_PATH)), F.lit(PARTS)) == number


def _reason(error: Exception) -> str:
    text = str(error)
    causes = _CAUSE.findall(text)
    return (causes[-1] if causes else text.strip().splitlines()[0])[:300]


def read_isolated(files: DataFrame, read: Callable[[Column], list[DataFrame]], label: str) -> Isolated:
    """Stage what ``read`` gives for the files that can be read.

    ``files`` has ``path`` and ``file_path`` of the whole set. ``read`` takes a predicate on
    ``_metadata.file_path`` that its scans have to apply before anything else, and returns frames.
    A file counts as unreadable when a scan of it alone fails; no row of it is kept.
    """
    listed = stage(files.select("path", "file_path"), f"{label}-files")
    return _read(listed, read, label, F.lit(True), 0)


def _within(files: DataFrame, keep: Column) -> DataFrame:
    """The files for which a predicate on the hidden path holds."""
    return files.select("path", F.struct("file_path").alias("_metadata")).filter(keep).select("path", FILE_PATH)


def _read(files: DataFrame, read: Callable[[Column], list[DataFrame]], label: str, keep: Column, level: int) -> Isolated:
    try:
        return Isolated([stage(frame, label) for frame in read(keep)])
    except Exception as error:  # noqa: BLE001  the JVM's errors come under several types
        if not _AT_FAULT.search(str(error)):
            raise
        here = _within(files, keep).limit(2).collect()
        if len(here) < 2:
            return Isolated(rejected=[(r.path, _reason(error)) for r in here])
        named = _NAMED.search(str(error))
    parts = []
    if named is not None:
        # the file that the error names is tried alone, so the rest is split without it
        alone = keep & (F.col(FILE_PATH) == named[1])
        if _within(files, alone).limit(1).count():
            parts.append(alone)
            keep = keep & (F.col(FILE_PATH) != named[1])
    spark = files.sparkSession
    numbers = _within(files, keep).select(F.pmod(F.xxhash64(F.lit(level), F.col("file_path")), F.lit(PARTS)).alias("n")).distinct()
    parts += [keep & _part(level, r.n) for r in numbers.collect()]
    out = Isolated()
    with ThreadPoolExecutor(PARTS) as pool:
        job = inheritable_thread_target(spark)(lambda part: _read(files, read, label, part, level + 1))
        for found in pool.map(job, parts):
            out.add(found)
    return out
