"""Raw inputs: dataset splits, text files, the built-in test corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the snippet of the synthetic test corpus.
SYNTHETIC_SNIPPET = "def hello_world():\n    print('Hello, World!')\n    return True\n"


def read_split(spark: SparkSession, path: str, config: str | None = None,
               split: str | None = "train", fmt: str = "parquet") -> DataFrame:
    """One split of a landed dataset laid out as ``config=…/split=…`` partitions.

    The filters are on partition columns, so other splits are never listed as input. A split
    that the dataset does not have is an error.
    """
    df = spark.read.format(fmt).load(path)
    if config is not None:
        df = df.where(F.col("config") == config)
    if split is not None:
        if "split" not in df.columns:
            raise ValueError(f"the dataset has no splits, so there is no split {split!r}")
        df = df.where(F.col("split") == split)
        if df.isEmpty():
            raise ValueError(f"the dataset has no split {split!r}")
    return df


def read_text_files(spark: SparkSession, path: str, max_chars: int | None = None) -> DataFrame:
    """Each file as one row of text.

    Invalid UTF-8 becomes replacement characters and all line ends become ``\\n``. The
    limit counts characters.
    """
    raw = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    if max_chars is not None:
        text = F.left(text, F.lit(max_chars))
    return raw.select(F.col("path").alias("source_file"), text.alias("text"))


def synthetic_corpus(spark: SparkSession, n: int = 1000) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit(SYNTHETIC_SNIPPET).alias("text"))


def spread_few_files(df: DataFrame, *key: str) -> DataFrame:
    """Spread a table with fewer input splits than cores by its key, for heavy work per row.

    A large table has more splits than that and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *key) if df.rdd.getNumPartitions() < cores else df
