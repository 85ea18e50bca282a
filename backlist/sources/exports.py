"""Dated exports that appear whole or not at all.

Every run writes its tables to a folder of its own, ``<root>/runs/<run>/``.
``commit`` then publishes one small marker that names them; readers follow the
newest marker.  A run that fails before leaves the former export as it was,
and a reader never sees half of one.

Marker names ascend; each is written aside and renamed, never overwritten.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from backlist.sources import sinks

MARKERS, RUNS = "_published", "runs"


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def _published(spark: SparkSession, root: str) -> list[str]:
    """Paths of all markers, oldest first."""
    fs, path = _file_system(spark, root)
    folder = path(f"{root}/{MARKERS}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().toString() for s in fs.listStatus(folder)]
    return sorted(n for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, root: str) -> dict[str, dict]:
    """``{name: {path, format, schema}}`` of the newest published run; empty if
    none was ever published."""
    found = _published(spark, root)
    if not found:
        return {}
    return json.loads("".join(r[0] for r in spark.read.option("wholetext", "true").text(found[-1]).collect()))


def read_export(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest published run, with the columns and types that it
    was written with."""
    entry = manifest(spark, root).get(name)
    if entry is None:
        raise FileNotFoundError(f"{root} has no published export {name!r}")
    r = spark.read.schema(StructType.fromJson(entry["schema"]))
    if entry["format"] == "csv":
        # an empty cell is a missing value, an empty text is quoted; no text is the null value
        r = r.options(**sinks.CSV, multiLine="true", emptyValue="", nullValue="\u0001")
    return r.format(entry["format"]).load(entry["path"])


class Export:
    """One run's tables under ``root``; ``paths`` has where each one lies."""

    def __init__(self, spark: SparkSession, root: str, run_date: dt.date) -> None:
        self.spark, self.root, self.run_date = spark, root.rstrip("/"), run_date
        # ascending by time, so that the newest run's marker sorts last
        self.run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        self.paths: dict[str, str] = {}
        self.entries: dict[str, dict] = {}

    def path(self, name: str, stamped: bool = True) -> str:
        return f"{self.root}/{RUNS}/{self.run}/{sinks.stamped(name, self.run_date) if stamped else name}"

    def note(self, name: str, path: str, fmt: str, df: DataFrame) -> str:
        """Counts a table that lies at ``path`` already among the run's."""
        self.paths[name] = path
        self.entries[name] = {"path": path, "format": fmt, "schema": json.loads(df.schema.json())}
        return path

    def small(self, name: str, df: DataFrame, stamped: bool = True) -> str:
        """A report of few rows, as one CSV file."""
        return self.note(name, sinks.write_small_csv(df, self.path(name, stamped)), "csv", df)

    def dataset(self, name: str, df: DataFrame, fmt: str = "parquet", drop_columns: Sequence[str] = (), stamped: bool = True) -> str:
        """A table of any size, written by all tasks."""
        df = df.drop(*drop_columns)
        return self.note(name, sinks.write_dataset(df, self.path(name, stamped), fmt), fmt, df)

    def commit(self) -> str:
        """Publishes the run: from now on readers see its tables."""
        fs, path = _file_system(self.spark, self.root)
        folder = f"{self.root}/{MARKERS}"
        fs.mkdirs(path(folder))
        aside, marker = path(f"{folder}/.{self.run}.tmp"), path(f"{folder}/{self.run}.json")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(self.entries).encode()))
        finally:
            out.close()
        if not fs.rename(aside, marker):
            raise OSError(f"can't publish {marker.toString()}")
        return marker.toString()
