"""A catalog of files from what stands at their ends: Parquet footers and the first and last lines of CSV, without reading rows."""

import csv
import datetime as dt
import os

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "path string, format string, bytes long, rows long, columns array<string>, start timestamp_ntz, end timestamp_ntz"
#: Bytes at either end of a CSV file that are read; a line may not be longer.
END_BYTES = 1 << 16
#: Files that a task looks at, about.
FILES_A_TASK = 64


def opened(path: str):
    """A file by its address, so that any part of it can be read."""
    system, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inside)


def _moment(value) -> dt.datetime | None:
    """A date or time as a time without zone (in UTC if it has one)."""
    if isinstance(value, dt.datetime):
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    return dt.datetime(value.year, value.month, value.day) if isinstance(value, dt.date) else None


def parquet_footer(path: str, time: str) -> tuple:
    """Rows, columns and the first and last time of a Parquet file. NULL times if a row group has values but no statistics of them."""
    with opened(path) as source:
        meta = pq.ParquetFile(source).metadata
    names, found, certain = meta.schema.to_arrow_schema().names, [], True
    leaves = [meta.schema.column(i).path for i in range(meta.num_columns)]
    if time in leaves:
        at = leaves.index(time)
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            if stats is not None and stats.has_min_max:
                found += [_moment(stats.min), _moment(stats.max)]
            elif meta.row_group(g).num_rows and not (stats is not None and stats.has_null_count and stats.null_count == meta.row_group(g).num_rows):
                certain = False
    known = [x for x in found if x is not None] if certain else []
    return meta.num_rows, names, min(known, default=None), max(known, default=None)


def csv_ends(path: str, time: str) -> tuple:
    """Columns of a CSV file with a header, and the times of its first and last row; rows are not counted."""
    with opened(path) as source:
        size = source.size()
        head = source.read(END_BYTES)
        source.seek(max(0, size - END_BYTES))
        tail = source.read(END_BYTES)
    lines = head.decode("utf-8", "replace").splitlines()
    names = next(csv.reader(lines[:1]), [])
    last = [x for x in tail.decode("utf-8", "replace").splitlines() if x.strip()]
    rows = [lines[1], last[-1]] if len(lines) > 1 else []
    if time not in names or not rows:
        return None, names, None, None
    times = pd.to_datetime([dict(zip(names, r)).get(time) for r in csv.reader(rows)], errors="coerce")
    return None, names, *[None if pd.isna(t) else t.to_pydatetime() for t in (times[0], times[-1])]


def file_catalog(spark: SparkSession, path: str | list[str], time: str = "ts") -> DataFrame:
    """A row for each Parquet or CSV file under path (a folder, a pattern or a list): path, format, bytes, rows, columns, and the first and last value of its time column.

    Files are listed by Spark and looked at by many tasks; only footers, or the
    ends of CSV files, are read. rows is NULL for CSV (whose rows are taken to be
    in order of time); start and end are NULL without a time column or values, or
    where a footer has no statistics. A damaged file raises.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    listed = listed.where(F.col("path").rlike(r"\.(parquet|csv)$"))
    many = listed.count()

    def look(batches):
        for batch in batches:
            rows = []
            for name, size in zip(batch["path"], batch["length"]):
                kind = os.path.splitext(name)[1][1:]
                count, columns, start, end = (parquet_footer if kind == "parquet" else csv_ends)(name, time)
                rows.append((name, kind, size, count, columns, start, end))
            frame = pd.DataFrame(rows, columns=["path", "format", "bytes", "rows", "columns", "start", "end"])
            frame["rows"] = frame["rows"].astype("Int64")
            frame[["start", "end"]] = frame[["start", "end"]].astype("datetime64[us]")
            yield frame

    return listed.repartition(max(1, -(-many // FILES_A_TASK))).mapInPandas(look, FILE)


def source_catalog(files: DataFrame, source=None) -> DataFrame:
    """(source, files, bytes, rows, start, end, columns) of a file_catalog, by a column that names the source (the folder, if none is given); columns are those that all its files have."""
    source = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1) if source is None else source
    g = files.withColumn("source", source).groupBy("source").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set("columns").alias("_columns"))
    shared = F.aggregate("_columns", F.get("_columns", F.lit(0)), lambda a, c: F.array_intersect(a, c))
    return g.select("source", "files", "bytes", "rows", "start", "end", shared.alias("columns"))
