"""Training logs and GPU telemetry as tables of lines."""

from __future__ import annotations

import itertools
import os
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.plans.ordered import row_index

# The telemetry fields in the order the GPU tool prints them.
GPU_FIELDS = ("gpu_util", "mem_used", "mem_total", "temp", "power")
GPU_SEPARATOR = ", "


def _run_of(path: str) -> Column:
    """The run of a line: the path of its file below ``path``, without the extension.

    ``path`` may be a folder, a pattern or a file; a file's run is its name.
    """
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "", path).rstrip("/")
    if not root.startswith("/"):
        root = os.path.abspath(root)
    fixed = list(itertools.takewhile(lambda part: not re.search(r"[*?\[{]", part), root.split("/")))
    folder = "/".join(fixed) + "/"
    # The metadata writes a path as a URI.
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    whole = F.regexp_replace(decoded, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    below = F.when(F.startswith(whole, F.lit(folder)), F.substring(whole, len(folder) + 1, 2**31 - 1)).otherwise(
        F.regexp_extract(whole, r"([^/]*)$", 1))
    return F.regexp_replace(below, r"\.[^./]*$", "")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``(run, line_no, line)`` of one log file per run, in file order.

    Files in folders below are read too; a run is its path there without the extension, so logs
    of one name in different folders are different runs. A large file is read in several blocks.
    Lines are ordered by block offset and then by their position in the block, so numbering needs
    no task that sees a whole file. A missing path gives an empty table.
    """
    try:
        lines = spark.read.option("recursiveFileLookup", "true").text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], "run string, line_no bigint, line string")
        raise
    placed = lines.select(
        _run_of(path).alias("run"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    return (row_index(placed, ["_row"], "line_no", ["_file"], bucket=F.col("_block"))
            .select("run", "line_no", "line"))


def read_telemetry(lines: DataFrame, column: str = "line") -> DataFrame:
    """GPU records of at least five numbers; lines that fail anywhere are dropped.

    The numbers are parsed as one array, so that the filter and the output columns share
    a single split of the line.
    """
    parts = F.slice(F.split(F.trim(column), GPU_SEPARATOR), 1, len(GPU_FIELDS))
    numbers = F.array_compact(F.transform(parts, lambda p: p.try_cast("double")))
    others = [c for c in lines.columns if c != column]
    return (lines.select(*others, numbers.alias("_numbers"))
            .where(F.size("_numbers") == len(GPU_FIELDS))
            .select(*others, *[F.get("_numbers", F.lit(i)).alias(name) for i, name in enumerate(GPU_FIELDS)]))
