"""Secret scans over content-addressed blobs with a ledger of what was scanned.

Every text version is a blob, named by the SHA-256 of its bytes. The ledger holds, for each
blob and rule version, the spans that the rule found. A scan looks only at pairs of blob and
rule version that the ledger lacks, appends what it found, and joins the findings back to
every path that holds the blob. Only built-in functions run on the texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

LEDGER = "blob string, rule string, version int, found array<struct<start:bigint, end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` count if the group has at least ``least`` characters.

    ``hints``: strings of which a text must hold one, lower-cased for ``any_case``, or a short
    pattern (``probe``) that every counting match contains. They save work and decide nothing.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hints: tuple[str, ...] = ()
    any_case: bool = False
    probe: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


#: The base rules, in the order in which spans with one start are listed (fixed values).
RULES = (
    Rule("assign", 1,
         r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8,
         hints=("password", "passwd", "secret", "token", "apikey", "api_key"), any_case=True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, hints=("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32, probe=r"[0-9a-f]{32}"),
)


def match_spans(text: Column, rule: Rule) -> Column:
    """Start and end, in code points, of the counting matches of a rule in one text.

    The pieces between the matches and the matches alternate; their lengths give the places.
    """
    between = F.transform(F.split(text, rule.pattern, -1), lambda p: F.char_length(p))
    matched = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.char_length(m))
    counted = (matched if rule.group == 0 else F.transform(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda m: F.char_length(m)))
    steps = F.arrays_zip(F.slice(between, F.lit(1), F.size(matched)).alias("gap"), matched.alias("size"), counted.alias("count"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    walked = F.aggregate(
        steps, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("found")),
        lambda s, m: F.struct(
            (s["at"] + m["gap"] + m["size"]).alias("at"),
            F.when(m["count"] >= rule.least, F.concat(s["found"], F.array(F.struct(
                (s["at"] + m["gap"]).alias("start"), (s["at"] + m["gap"] + m["size"]).alias("end")))))
            .otherwise(s["found"]).alias("found")),
        lambda s: s["found"])
    return F.when(_possible(text, rule), walked).otherwise(empty)


def _possible(text: Column, rule: Rule) -> Column:
    if rule.probe:
        return text.rlike(rule.probe)
    place = F.lower(text) if rule.any_case else text
    found = F.lit(not rule.hints)
    for hint in rule.hints:
        found = found | F.contains(place, F.lit(hint))
    return found


def blob_name(text: Column) -> Column:
    """The SHA-256 of the UTF-8 bytes; a null text is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; before the first scan there are none."""
    empty = spark.createDataFrame([], LEDGER)
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location):
        return empty
    return spark.read.schema(LEDGER).parquet(path)


def scan_unseen(versions: DataFrame, text: str, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Ledger rows for the blob and rule-version pairs that ``ledger`` lacks.

    Each distinct blob is scanned once, whatever the number of paths and versions that hold it:
    equal texts meet before the shuffle and after it. Null texts are the empty blob.
    """
    seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("seen"))
    blobs = (versions.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
             .select(blob_name(F.col("text")).alias("blob"), "text").dropDuplicates(["blob"]))
    todo = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    results = F.array(*[
        F.when(~F.array_contains("seen", rule.key), F.struct(
            F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"),
            match_spans(F.col("text"), rule).alias("found")))
        for rule in rules])
    return (todo.select("blob", F.explode(F.array_compact(results)).alias("result"))
            .select("blob", "result.rule", "result.version", "result.found"))


def update_ledger(versions: DataFrame, text: str, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what is new, append it to the ledger at ``path`` and return the whole ledger.

    A second call with the same rows and rules scans and appends nothing. A writer that stops
    half way leaves no committed rows; the next call scans those blobs again.
    """
    spark = versions.sparkSession
    scan_unseen(versions, text, read_ledger(spark, path), rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def blob_findings(ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per blob with findings of the given rule versions: the spans in listing order.

    Two scans that ran at once may both have recorded a pair; equal spans count once.
    """
    wanted = F.lit(False)
    for rule in rules:
        wanted = wanted | ((F.col("rule") == rule.kind) & (F.col("version") == rule.version))
    place = F.create_map(*[x for i, rule in enumerate(rules) for x in (F.lit(rule.kind), F.lit(i))])
    spans = ledger.where(wanted & (F.size("found") > 0)).select(
        "blob", F.col("rule").alias("kind"), place[F.col("rule")].alias("turn"), F.explode("found").alias("span"))
    return (spans.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct(
        F.col("span.start").alias("start"), "turn", F.col("span.end").alias("end"), "kind"))).alias("spans")))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def findings_by_path(versions: DataFrame, key: str, text: str, ledger: DataFrame,
                     rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every path with the spans found in its blob: key, blob, ``spans`` (empty if none).

    One row per row of ``versions``; null keys stay. Other columns are not read.
    """
    paths = versions.select(F.col(f"`{key}`").alias("path"), blob_name(F.col(f"`{text}`")).alias("blob"))
    found = paths.join(blob_findings(ledger, rules), "blob", "left")
    empty = F.array().cast("array<struct<start:bigint,turn:int,end:bigint,kind:string>>")
    return found.select(F.col("path").alias(key), "blob", F.coalesce("spans", empty).alias("spans"))


def merged_spans(spans: Column) -> Column:
    """Spans without overlaps, in order."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        overlaps = (F.size(done) > 0) & (span["start"] <= F.try_element_at(done, F.lit(-1))["end"])
        longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end")))
        return F.when(overlaps, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), longer)).otherwise(
            F.concat(done, F.array(F.struct(span["start"].alias("start"), span["end"].alias("end")))))

    return F.aggregate(spans, empty, step)


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by ``mark``."""
    cuts = merged_spans(spans)
    done = F.aggregate(
        cuts, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda s, c: F.struct(c["end"].alias("at"), F.concat(s["parts"], F.array(
            F.substring(text, (s["at"] + 1).cast("int"), (c["start"] - s["at"]).cast("int"))))),
        lambda s: F.concat(s["parts"], F.array(F.substring(text, (s["at"] + 1).cast("int"), F.lit(2**31 - 1)))))
    return F.when(F.size(cuts) == 0, text).otherwise(F.array_join(done, mark))


def redact(df: DataFrame, text: str, ledger: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "[secret]") -> DataFrame:
    """All rows and columns of ``df`` with the secrets in ``text`` replaced by ``mark``.

    Rows whose blob has no findings come back as they are; a null text stays null.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                       blob_name(F.col(f"`{text}`")).alias("blob"))
    joined = packed.join(blob_findings(ledger, rules), "blob", "left")
    whole = F.col("_row")[text]
    clean = F.when(F.col("spans").isNull() | whole.isNull(), whole).otherwise(redacted(whole, F.col("spans"), mark))
    return joined.select(*[(clean if c == text else F.col("_row")[c]).alias(c) for c in df.columns])


def new_ledger(spark: SparkSession) -> str:
    """A path for a ledger of its own below the shared folder."""
    return scratch_path(spark, "ledger")
