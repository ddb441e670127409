"""Scan of acceleration snapshots: header-less text files, one folder per experiment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from tremorline.functions.scalars import assemble_time, clean
from tremorline.session import stage

# Field order of a snapshot line.
FIELDS = ("hour", "minute", "second", "millisecond", "x", "y")
FILE_PATTERN = "acc*.csv"


def even_lines(line_number: Column) -> Column:
    """The 2:1 downsample of the scan: lines 0, 2, 4, ... of every file."""
    return line_number % 2 == 0


def scan_acceleration(
    spark: SparkSession,
    root: str,
    folders: list[str],
    keep_line=even_lines,
    pattern: str = FILE_PATTERN,
) -> DataFrame:
    """Six numeric fields and ``id``, the 1-based position of the folder in ``folders``.

    Fields are separated by ``;`` or ``,``; lines end with LF, CR LF or CR. Line numbers
    restart in every file and count blank lines; ``keep_line`` decides on them. A kept line
    with other than six fields, or a field that is not a number, fails; an empty field is
    missing.
    """
    if not folders:
        raise ValueError("no experiment folders")
    paths = [f"{root.rstrip('/')}/{folder.strip('/')}" for folder in folders]
    depth = max(folder.strip("/").count("/") + 1 for folder in folders)
    scan = _Scan(spark, list(dict.fromkeys(paths)), pattern, depth)
    listed = scan.reader("binaryFile").load(scan.paths)  # lists the files, reads none
    if listed.select("path").isEmpty():
        raise ValueError("no acceleration files in the given folders")
    lines = scan.lines()
    fields = F.split(F.col("line"), "[;,]")
    rows = lines.filter(keep_line(F.col("line_number")) & (F.trim("line") != "")).select("folder", fields.alias("f"))
    wrong = F.raise_error(F.concat(F.lit("line without six fields: "), F.array_join("f", ";")))
    rows = rows.withColumn("f", F.when(F.size("f") == len(FIELDS), F.col("f")).otherwise(wrong.cast("array<string>")))
    # a folder listed twice yields its rows under both positions
    positions = spark.createDataFrame(
        [("/".join(path.split("/")[-depth:]), i) for i, path in enumerate(paths, start=1)], "folder string, id int"
    )
    numbers = [
        clean(F.expr(f"CAST(nullif(trim(get(f, {i})), '') AS double)")).alias(name) for i, name in enumerate(FIELDS)
    ]
    return rows.join(positions, "folder").select(*numbers, "id")


@dataclass(frozen=True)
class _Scan:
    spark: SparkSession
    paths: list[str]
    pattern: str
    depth: int  # trailing parts of a folder path that tell the folders apart

    def reader(self, form: str) -> DataFrameReader:
        return self.spark.read.format(form).option("pathGlobFilter", self.pattern)

    def folder(self) -> Column:
        plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        parts = F.split(plain, "/")
        return F.concat_ws("/", F.slice(parts, F.size(parts) - self.depth, self.depth))

    def lines(self) -> DataFrame:
        """Numbered lines of all files, which Spark may read in several splits.

        Rows of a split arrive in file order, so a line's number is its rank in the split
        plus the lines of the splits before it. The lines are staged first: row ids must
        not change between counting the splits and numbering their lines.
        """
        text = self.reader("text").load(self.paths)
        lines = stage(
            text.select(
                self.folder().alias("folder"),
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("rid"),
                F.col("value").alias("line"),
            ),
            "lines",
        )
        split = ["file", "block"]
        counts = lines.groupBy(*split).agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("len"))
        earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*split, "first", F.coalesce(F.sum("len").over(earlier), F.lit(0)).alias("before"))
        number = F.col("rid") - F.col("first") + F.col("before")
        return lines.join(stage(offsets, "splits"), split).select("folder", number.alias("line_number"), "line")


def with_time(raw: DataFrame) -> DataFrame:
    """(id, time, x, y): clock parts assembled on the fixed recording date."""
    clock = [F.col(c) for c in ("hour", "minute", "second", "millisecond")]
    return raw.select(F.col("id").cast("int").alias("id"), assemble_time(*clock).alias("time"), "x", "y")


