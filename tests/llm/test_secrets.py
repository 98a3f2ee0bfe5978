import random
import re

from tokenloom.llm import secrets

PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
]
PARTS = ["token", "PassWord", "api_key", "APIKEY", "=", ":", " ", '"', "'", "é", "\U0001F600", "abcdef12", "AKIA",
         "ABCDEFGHJKLM", "12345678", "deadbeefdeadbeef", "\n", "K", "token=token:abcdefgh"]


def brute(text):
    found = []
    for turn, (kind, pattern, group, least) in enumerate(PATTERNS):
        found += [(m.start(), turn, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(found)


def masked(text, spans):
    merged = []
    for start, _, end, _ in spans:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    for start, end in reversed(merged):
        text = text[:start] + "[secret]" + text[end:]
    return text


def test_spans_and_redaction_match_plain_matching(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 40))) for _ in range(150)] + [None, "", "x" * 30_000 + " token=abcdefgh"]
    table = spark.createDataFrame(list(enumerate(texts)), "p int, text string")
    ledger = secrets.update_ledger(table, "text", secrets.new_ledger(spark))
    found = {r.p: [tuple(s) for s in r.spans] for r in secrets.findings_by_path(table, "p", "text", ledger).collect()}
    assert found == {i: brute(t) for i, t in enumerate(texts)}
    clean = {r.p: r.text for r in secrets.redact(table, "text", ledger).collect()}
    assert clean == {i: None if t is None else masked(t, found[i]) for i, t in enumerate(texts)}


def test_the_ledger_scans_only_what_is_new(spark):
    first = spark.createDataFrame([("a", "token=abcdefgh"), ("b", "token=abcdefgh"), ("c", None)], "path string, text string")
    path = secrets.new_ledger(spark)
    assert secrets.update_ledger(first, "text", path).count() == 2 * len(secrets.RULES)
    assert secrets.update_ledger(first, "text", path).count() == 2 * len(secrets.RULES)
    more = spark.createDataFrame([("d", "token=abcdefgh"), ("e", "new")], "path string, text string")
    assert secrets.scan_unseen(more, "text", secrets.read_ledger(spark, path)).count() == len(secrets.RULES)
    rules = (*secrets.RULES, secrets.Rule("mail", 1, "[a-z]+@[a-z]+", 0, 3), secrets.Rule("hex", 2, "[0-9a-f]+", 0, 8))
    again = secrets.scan_unseen(first, "text", secrets.read_ledger(spark, path), rules).collect()
    assert {(r.rule, r.version) for r in again} == {("mail", 1), ("hex", 2)} and len(again) == 4


def test_hard_rows_keep_rows_and_columns(hard, spark):
    ledger = secrets.update_ledger(hard, "text", secrets.new_ledger(spark))
    found = secrets.findings_by_path(hard, "doc_id", "text", ledger)
    assert found.count() == hard.count()
    clean = secrets.redact(hard, "text", ledger)
    assert clean.columns == hard.columns and clean.count() == hard.count()
    assert clean.where("doc_id IS NULL").first().text == "A text without an id, [secret] and more."
    assert secrets.redact(hard.limit(0), "text", ledger).count() == 0
    assert secrets.scan_unseen(hard.limit(0), "text", secrets.read_ledger(spark, secrets.new_ledger(spark))).count() == 0
