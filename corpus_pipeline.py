"""A corpus from raw documents to token ids, as stages that each read what the one before kept.

Each stage applies one operator to all rows it gets; its result is stored as Parquet and read again
by the next. All stages but the last return the columns they are given, whatever their names; a table
needs ``doc_id``, ``text``, ``source``, ``lang`` and ``n_chars``, and any of them may be null. An empty
table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import forced_bpe, mixing, near_dedup, queries, secrets, toxicity
from tokenloom.session import ship_package, written

#: A document is rejected from this score on.
REJECTED = 0.5


def _named(docs: DataFrame) -> list[Column]:
    """All columns; names may hold dots."""
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labelled ones among them, does not hold for toxic.

    A text without words (null, empty) has the intercept's score: how common toxic labels are. It
    stays unless they are the majority. Rows are judged each, so repeated ones share one fate.
    """
    ship_package(spark)
    model = toxicity.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    packed = docs.select(F.struct(*_named(docs)).alias("row"), F.col("text").alias("text"))
    return toxicity.score(packed, "text", model, out="toxicity").where(F.col("toxicity") < REJECTED).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that shares four fifths of its five-word shingles, the one with the smallest id.

    Rows equal in id and text count once. Texts without words are in no group and stay.
    """
    ship_package(spark)
    return near_dedup.deduplicated(docs, "doc_id", "text")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced; ``n_chars`` is the length of the text that is left (null: null)."""
    ship_package(spark)
    ledger = secrets.update_ledger(docs, "text", secrets.new_ledger(spark))
    clean = secrets.redact(docs, "text", ledger)
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return clean.select(*[length if c == "n_chars" else kept for c, kept in zip(docs.columns, _named(docs))])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares of sources, languages and topics are tempered.

    Null is a source and a language like any other; texts without words weigh nothing and stay.
    """
    ship_package(spark)
    return mixing.mix(docs, "doc_id", queries.margins(), mixing.word_count(F.col("text")), queries.TEMPER)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian, 32 bits each), and a digest of the decoded text.

    A null or empty text has no ids.
    """
    ship_package(spark)
    coded = forced_bpe.encode_texts(docs, "text", queries.vocabulary("word_bpe_49k.json"), decoded="decoded")
    return coded.select("doc_id", "source", "lang", "n_tokens", "ids",
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("tokens", encode),
]

#: No SQL: scores, sketches and merges are beyond it. A brute-force version tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
