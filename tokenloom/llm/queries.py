"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import cross_align, forced_bpe, lattice_lm, manifest, merkle, mixing, near_dedup, pivot_index, secrets, sharding, sql, suffix_match, token_rollup, toxicity

SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards; law ``key``."""
    return sharding.shard_manifest(_table(spark, sf_dir, "documents"), "doc_id", "text", SHARDS)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, found through a fresh ledger."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = secrets.update_ledger(docs, "text", secrets.new_ledger(spark))
    found = secrets.findings_by_path(docs, "doc_id", "text", ledger)

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    text = secrets.span_text(F.col("spans"))
    return found.select("doc_id", *[number(r.kind) for r in secrets.RULES],
                        F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"))


#: Found token shares are raised to this power to make the targets of the mixture.
TEMPER = 0.9


def margins() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic(F.col("text"))}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, token count, rate of being kept and whether it is."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), "doc_id",
                       margins(), mixing.word_count(F.col("text")), TEMPER, keep_all=True)
    return mixed.select("doc_id", "_cell.source", "_cell.lang", "_cell.topic", F.col("_tokens").alias("n_tokens"),
                        F.round("_rate", 6).alias("rate"), F.col("_kept").alias("kept"))


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the operators take any other path."""
    return public_tokenizers.path(name)


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginal probabilities of all documents; every seventh fold is held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lattice_lm.score_documents(docs, "doc_id", "text", fold("doc_id", 7) != 2, vocabulary("piece_bpe_32k.model"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    coded = forced_bpe.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text",
                                    vocabulary("word_bpe_49k.json"), decoded="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors for every hundredth one."""
    return pivot_index.top_k(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited form."""
    return merkle.fingerprints_with_edits(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents; toxic ones leave; poor ones are counted anew, by words
    with a letter; and bytes are counted as a second tokenizer. The second batch is sent twice.
    """
    text = F.col("text")
    lettered = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]*[A-Za-z][^\x20\x09-\x0D]*"))
    # Counts are taken where the texts are read; the joins carry numbers only.
    counts = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", mixing.word_count(text).alias("words"), lettered.alias("lettered"),
        F.octet_length(text).alias("bytes"))
    marks = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    gone, bad = (marks.where(rule).select("doc_id") for rule in ("toxic = 1", "quality = 0"))
    staying = counts.join(gone, "doc_id", "left_anti")
    store = scratch_path(spark, "rollup")
    batches = {
        "1-all": token_rollup.changes(counts, "insert", "doc_id", "words-1", F.col("words")),
        "2-toxic": token_rollup.changes(counts.join(gone, "doc_id", "left_semi"), "delete", "doc_id", "words-1", F.lit(0)),
        "3-poor": token_rollup.changes(staying.join(bad, "doc_id", "left_semi"), "revise", "doc_id", "words-1", F.col("lettered")),
        "4-bytes": token_rollup.changes(staying, "insert", "doc_id", "bytes-1", F.col("bytes")),
    }
    for name, changed in batches.items():
        token_rollup.apply_batch(spark, store, name, changed)
    token_rollup.apply_batch(spark, store, "2-toxic", batches["2-toxic"])
    return token_rollup.totals(spark, store)


def fold(key: str, folds: int) -> Column:
    """CRC-32 of the key as text, modulo ``folds``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model learned outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.toxicity_model(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, "text", model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share four fifths of their four-word shingles."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text", words=4)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; every third one is checked after its text was lower-cased.

    A document without an id is not tampered with.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    seen = F.when(changed, manifest.leaf([*fields, lower]))
    rows = manifest.manifest(_table(spark, sf_dir, "documents"), "doc_id", "lang",
                             {"leaf": manifest.leaf([*fields, F.col("text")]), "seen": seen})
    folded = manifest.folded(F.coalesce("seen", "leaf"), F.col("witness"))
    return rows.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("witness")).alias("proof_sha256"),
                       folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items, and those items."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = suffix_match.marked(docs, "text", _table(spark, sf_dir, "benchmark"))
    return rows.select("_row.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens that end together in two tokenizers, and counts of the id pairs that overlap."""
    return cross_align.link_counts(_table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary("byte_bpe_50k.json"),
                                   public_tokenizers.PATTERN, vocabulary("piece_bpe_32k.model"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_secrets": op2_secrets,
    "op3_mixing": op3_mixing,
    "op4_lattice_lm": op4_lattice_lm,
    "op5_bpe": op5_bpe,
    "op6_top_k": op6_top_k,
    "op7_merkle": op7_merkle,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_near_dedup": op10_near_dedup,
    "op11_manifest": op11_manifest,
    "op12_decontamination": op12_decontamination,
    "op13_alignment": op13_alignment,
}
SQL = sql.statements(TEMPER, mixing.SWEEPS, mixing.TOLERANCE, mixing.SPARE)
