"""Partition folders of a table on shared storage: list, remove, swap in. Only names pass through the driver."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

EMPTY_DAY = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name for a null partition value
AT_ONCE = 8  # folders moved side by side; on shared storage each waits for the answer


def checked(name: str) -> str:
    """A batch or run name that is its own folder name."""
    if not re.fullmatch(r"[\w.-]+", name):
        raise ValueError(f"a batch or run name may hold letters, digits, '_', '.' and '-' only: {name!r}")
    return name


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _system(spark, path)
    return system.exists(place)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    place, system = _system(spark, pattern)
    return [str(found.getPath()) for found in system.globStatus(place) or []]


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        place, system = _system(spark, path)
        system.delete(place, True)


def make(spark: SparkSession, path: str) -> None:
    place, system = _system(spark, path)
    system.mkdirs(place)


def rename(spark: SparkSession, source: str, target: str) -> None:
    place, system = _system(spark, source)
    if not system.rename(place, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"can't rename {source} to {target}")


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder in the place of another; one that is not there is in place already."""
    place, system = _system(spark, source)
    if system.exists(place):
        to = spark._jvm.org.apache.hadoop.fs.Path(target)
        if not system.delete(to, True):
            system.mkdirs(to.getParent())
        if not system.rename(place, to):
            raise OSError(f"can't rename {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    place, system = _system(spark, path)
    stream = system.create(place, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    place, system = _system(spark, path)
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the outer partition column, as folder names have them."""
    return sorted(p.rpartition("=")[2] for p in matching(spark, f"{path}/{column}=*"))


# A swap replaces some values of a table's outer partition by staged folders. The note says what belongs to it; it is there
# from the end of staging to the end of the swap, so a swap that was cut off is finished from it.


def staging_of(path: str) -> str:
    return f"{path.rstrip('/')}__rewrite"


def swap(spark: SparkSession, path: str, column: str, values: list[str]) -> None:
    """Put the staged folders in place of those of ``values``; values without a staged folder are removed."""
    staging = staging_of(path)
    staged = set(partition_values(spark, f"{staging}/data", column))
    note = [("filled" if v in staged else "emptied", column, v) for v in values]
    lines = io.StringIO()
    csv.writer(lines).writerows(note)
    make(spark, f"{staging}/noted")
    write_text(spark, f"{staging}/noted/note.csv", lines.getvalue())
    rename(spark, f"{staging}/noted", f"{staging}/note")
    finish(spark, path)


def finish(spark: SparkSession, path: str) -> None:
    """Finish a swap that was cut off, or drop staging that was."""
    staging = staging_of(path)
    if not exists(spark, staging):
        return

    def move(state: str, column: str, value: str) -> None:
        source, target = f"{staging}/data/{column}={value}", f"{path}/{column}={value}"
        if state == "emptied":
            remove(spark, [target])
        else:
            replace(spark, source, target)

    if exists(spark, f"{staging}/note"):
        note = "".join(read_text(spark, part) for part in matching(spark, f"{staging}/note/*.csv"))
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for moved in [pool.submit(move, *line) for line in csv.reader(io.StringIO(note))]:
                moved.result()
    remove(spark, [staging])
