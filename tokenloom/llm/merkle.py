"""Merkle fingerprints of texts: sections of paragraphs, and phrases below each paragraph.

A section ends after a blank line, a paragraph after a line end; both keep their ends, so the
parts of a text joined are the text and equal roots mean equal texts. A paragraph's digest is
the SHA-256 of its bytes, a section's that of its paragraphs' digests, the root's that of the
sections'. Comparing digests from the root down leads to the paragraphs that were edited.
Phrases, cut where a word ends in one of a few letters or, in text without such ends, behind pairs
of characters whose hash says so, carry 40-bit digests; an edit changes the phrases that it touches
and no others, in any script, so shared phrases measure how much two texts have in common even
when every paragraph differs. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import MAX_BUCKETS, with_buckets

SECTION = r"(?<=\n\n)(?=[^\n])"
PARAGRAPH = r"(?<=\n)"
#: Phrase ends in long paragraphs, and in those shorter than ``SHORT`` characters.
PHRASE = r"(?<=[^\p{L}\p{N}\s][ \t]|s[ \t])(?=[^ \t])"
FINE = r"(?<=[^\p{L}\p{N}\s][ \t]|[sdnrtyeéhl][ \t])(?=[^ \t])"
SHORT = 200
#: A phrase of more characters is cut behind every pair of them whose hash has its low bits clear.
LONGEST, CUT_BITS = 96, 4
#: Stands between the blocks of such a phrase; where a text has this character itself, it cuts too.
_MARK = "\u0001"
DIGEST_BITS = 40


def _joined_digest(nodes: Column) -> Column:
    return F.sha2(F.array_join(F.transform(nodes, lambda n: n["digest"]), "").cast("binary"), 256)


def _phrases(paragraph: Column) -> Column:
    pieces = F.when(F.char_length(paragraph) < SHORT, F.split(paragraph, FINE, -1)).otherwise(
        F.split(paragraph, PHRASE, -1))
    blocks = F.transform(pieces, lambda p: F.when(F.char_length(p) <= LONGEST, F.array(p)).otherwise(_blocks(p)))
    return F.transform(F.filter(F.flatten(blocks), lambda p: p != ""),
                       lambda p: F.xxhash64(p).bitwiseAND(F.lit((1 << DIGEST_BITS) - 1)))


def _blocks(phrase: Column) -> Column:
    """Blocks whose borders depend on the two characters before them alone, so they move with the text."""
    def marked(chars: Column) -> Column:
        ends = F.transform(chars, lambda c, i: F.when(
            F.xxhash64(F.get(chars, i - 1), c).bitwiseAND(F.lit((1 << CUT_BITS) - 1)) == 0, F.concat(c, F.lit(_MARK))).otherwise(c))
        return F.split(F.array_join(ends, ""), _MARK, -1)

    # The characters are made once and then looked up by their place.
    return F.transform(F.array(F.split(phrase, "")), marked)[0]


def tree(text: Column) -> Column:
    """The tree of one text: ``digest`` of the root, and ``sections`` of paragraphs with phrases."""
    def paragraph(p: Column) -> Column:
        return F.struct(F.sha2(p.cast("binary"), 256).alias("digest"), _phrases(p).alias("phrases"))

    def section(s: Column) -> Column:
        return F.transform(F.filter(F.split(s, PARAGRAPH, -1), lambda p: p != ""), paragraph)

    sections = F.transform(
        F.transform(F.split(F.coalesce(text, F.lit("")), SECTION, -1), section),
        lambda ps: F.struct(_joined_digest(ps).alias("digest"), ps.alias("paragraphs")))
    return F.transform(F.array(sections), lambda ss: F.struct(_joined_digest(ss).alias("digest"), ss.alias("sections")))[0]


def fingerprint(of: Column) -> Column:
    """The tree as a string: root; ``/`` and each section's paragraphs: ``;``, digest, ``:``, phrases.

    The root is written in full, a paragraph with 8 hexadecimal digits, a phrase with 10.
    """
    def paragraph(p: Column) -> Column:
        phrases = F.transform(p["phrases"], lambda h: F.lpad(F.lower(F.hex(h)), DIGEST_BITS // 4, "0"))
        return F.concat(F.lit(";"), F.substring(p["digest"], 1, 8), F.lit(":"), F.array_join(phrases, ""))

    sections = F.transform(of["sections"], lambda s: F.array_join(F.transform(s["paragraphs"], paragraph), ""))
    return F.concat(of["digest"], F.lit("/"), F.array_join(sections, "/"))


def phrases(of: Column) -> Column:
    """Phrase digests of a tree in their order."""
    return F.flatten(F.transform(
        of["sections"], lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["phrases"]))))


def _common_head(a: Column, b: Column) -> Column:
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    return F.coalesce(F.nullif(F.array_position(differs, True), F.lit(0)) - 1, F.least(F.size(a), F.size(b)))


def likeness(a: Column, b: Column) -> Column:
    """How much two phrase sequences have in common, from 0 to 1; 1 if both are empty.

    Twice the shared distinct phrases over all distinct phrases or, if that is more, twice the
    common head and tail over all phrases: a text that repeats itself has few distinct ones.
    """
    distinct = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    both = F.size(a) + F.size(b)
    ends = F.least(_common_head(a, b) + _common_head(F.reverse(a), F.reverse(b)), F.size(a), F.size(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.greatest(
        2.0 * F.size(F.array_intersect(a, b)) / F.greatest(distinct, F.lit(1)), 2.0 * ends / F.greatest(both, F.lit(1))))


def edited_paragraphs(before: Column, after: Column) -> Column:
    """Section and paragraph numbers (from 0) in ``after`` that ``before`` does not hold.

    Equal roots and equal sections end the descent; only differing branches are looked at.
    """
    known = F.transform(before["sections"], lambda s: s["digest"])
    paragraphs = F.flatten(F.transform(before["sections"], lambda s: F.transform(s["paragraphs"], lambda p: p["digest"])))

    def inside(s: Column, i: Column) -> Column:
        places = F.transform(s["paragraphs"], lambda p, j: F.when(
            ~F.array_contains(paragraphs, p["digest"]), F.struct(i.alias("section"), j.alias("paragraph"))))
        return F.when(F.array_contains(known, s["digest"]), F.slice(places, 1, 0)).otherwise(F.array_compact(places))

    branches = F.flatten(F.transform(after["sections"], inside))
    return F.when(before["digest"] == after["digest"], F.slice(branches, 1, 0)).otherwise(branches)


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every document with the phrases and the text of the next one in ascending order of the key.

    Null keys come first; rows with one key are in order of their text's hash; after the last comes
    the first. Keys are of any type that can be sorted, and are compared as they are. Each text is
    shuffled once, to a bucket of neighbouring keys; the first row of a bucket is copied to the end of
    the bucket before it.
    """
    spark = docs.sparkSession
    parts = min(16 * int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    placed = with_buckets(rows.withColumn("hash", F.xxhash64("text")), ["key", "hash"], parts)
    firsts = placed.groupBy("_bucket").agg(F.min(F.struct("key", "hash")).alias("first"))
    # One row per bucket, whatever the table's size.
    ring = Window.orderBy("_bucket")
    last = F.last("_bucket").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    borders = firsts.select("_bucket", "first", F.coalesce(F.lag("_bucket").over(ring), last).alias("_before"))
    copied = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("hash") == F.col("first.hash"))
    targets = F.array_compact(F.array(
        F.struct(F.col("_bucket").alias("to"), F.lit(0).alias("copy")),
        F.when(copied, F.struct(F.col("_before").alias("to"), F.lit(1).alias("copy")))))
    sent = (placed.join(F.broadcast(borders), "_bucket").withColumn("_to", F.explode(targets))
            .select("key", "hash", "text", F.col("_to.to").alias("bucket"), F.col("_to.copy").alias("copy"))
            .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket"))
    grown = sent.withColumn("tree", tree(F.col("text"))).withColumn("phrases", phrases(F.col("tree")))
    order = Window.partitionBy("bucket").orderBy("copy", "key", "hash")
    following = F.lead(F.struct("text", "phrases")).over(order)
    return grown.withColumn("next", following).where("copy = 0").select("key", "text", "tree", "phrases", "next")


def fingerprints_with_edits(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they and the next text are.

    The edited form replaces the last quarter of the code points (rounded down) by the first as
    many, or all, of the next document. A null text is empty; the fingerprint of an empty text is
    that of no sections' content. Repeated rows are documents of their own; the next of a row may
    be its repetition. Other columns are not read. An empty table gives an empty result.
    """
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = (with_next(docs, key, text).withColumn("n", n.cast("bigint")).withColumn("edited", edited)
            .withColumn("edited_tree", tree(F.col("edited")))
            .withColumn("edited_phrases", phrases(F.col("edited_tree"))))
    return rows.select(
        F.col("key").alias(key), F.col("n").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("tree")).alias("fingerprint"), fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        likeness(F.col("phrases"), F.col("edited_phrases")).alias("near_edited"),
        likeness(F.col("phrases"), F.col("next.phrases")).alias("near_next"))


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, tree and fingerprint of every text. Narrow; null texts are empty."""
    built = docs.select(F.col(f"`{key}`").alias(key), tree(F.col(f"`{text}`")).alias("tree"))
    return built.withColumn("fingerprint", fingerprint(F.col("tree")))
