import base64

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.functions import codecs, numeric, text
from tokenloom.functions.sql import register_sql
from tokenloom.catalog.inputs import TOY_RANKS


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_byte_ids(spark):
    got = one(spark, [("Hié",), ("",), (None,), ("a" * 70000,)], "t string", codecs.encode_bytes("t"))
    assert got[0][0] == [72, 105, 195, 169]
    assert got[1][0] == [] and got[2][0] is None and len(got[3][0]) == 70000


def test_byte_ids_are_clamped(spark):
    assert one(spark, [("é",)], "t string", codecs.encode_bytes("t", 100))[0][0] == [99, 99]
    assert one(spark, [("éa",)], "t string", codecs.encode_bytes_expr("t", 100))[0][0] == [99, 99, 97]


def test_nulls_inside_a_batch(spark):
    df = spark.createDataFrame([("ab",), (None,), ("c",), ("",), (None,), ("é",)], "t string").coalesce(1)
    got = [r[0] for r in df.select(codecs.encode_bytes("t")).collect()]
    assert got == [[97, 98], None, [99], [], None, [195, 169]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=1, max_size=20))
def test_byte_codecs_match_python(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string").withColumns(
        {"a": codecs.encode_bytes("t"), "b": codecs.encode_bytes_expr("t")})
    back = df.withColumns({"back": codecs.decode_bytes("a"), "plain": codecs.decode_bytes_expr("a")})
    for r in back.collect():
        assert r["a"] == r["b"] == list(texts[r["i"]].encode())
        assert r["back"] == r["plain"] == texts[r["i"]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.binary(max_size=12)), min_size=1, max_size=20))
def test_decoding_broken_bytes_matches_python(spark, blobs):
    rows = [(i, None if b is None else list(b)) for i, b in enumerate(blobs)]
    df = spark.createDataFrame(rows, "i int, ids array<int>").coalesce(1)
    for r in df.select("i", codecs.decode_bytes("ids").alias("t")).collect():
        b = blobs[r["i"]]
        assert r["t"] == (None if b is None else b.decode("utf-8", "replace"))


def test_decode_bytes_replaces_and_wraps(spark):
    for decode in (codecs.decode_bytes, codecs.decode_bytes_expr):
        got = one(spark, [([255, 65],), ([320],), ([],)], "i array<int>", decode("i"))
        assert [g[0] for g in got] == ["�A", "@", ""]


def test_codepoints(spark):
    ids = one(spark, [("aé😀ÿĀ",), ("",)], "t string", codecs.encode_codepoints("t"))
    assert ids[0][0] == [97, 233, 255, 255, 255] and ids[1][0] == []
    assert one(spark, [([97, 233, 255, 999],)], "i array<int>", codecs.decode_codepoints("i"))[0][0] == "aéÿÿ"


def test_bpe_round_trip_and_merges(spark):
    got = one(spark, [("the thing",), ("x's the",), ("é 😀",), (None,)], "t string",
              codecs.encode_bpe(spark, "t", TOY_RANKS))
    names = {i: t for t, i in TOY_RANKS.items()}
    assert [names[i] for i in got[0][0]] == [b"the", b" ", b"th", b"ing"]
    assert b"".join(names[i] for i in got[2][0]).decode() == "é 😀" and got[3][0] is None
    back = spark.createDataFrame([("the nation's ÿ",)], "t string").select(
        codecs.decode_bpe(spark, codecs.encode_bpe(spark, "t", TOY_RANKS), TOY_RANKS))
    assert back.first()[0] == "the nation's ÿ"
    rows = one(spark, [([261, 32, 195, 169],), (None,), ([],), ([265, 195],)], "i array<int>",
               codecs.decode_bpe(spark, "i", TOY_RANKS))
    assert [r[0] for r in rows] == ["the é", None, "", "tion�"]
    with pytest.raises(Exception, match="no entry"):
        one(spark, [([999],)], "i array<int>", codecs.decode_bpe(spark, "i", TOY_RANKS))


def test_bpe_needs_a_vocabulary(spark, tmp_path):
    with pytest.raises(ValueError):
        codecs.encode_bpe(spark, "t", {})
    file = tmp_path / "ranks"
    file.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in TOY_RANKS.items()))
    assert codecs.load_ranks(str(file)) == TOY_RANKS


def test_token_labels(spark):
    got = one(spark, [(10, "\n"), (5, "x" * 30), (7, None), (92, "\\")], "i int, t string",
              codecs.token_label("i", F.col("t")))
    assert [g[0] for g in got] == ["\\n", "x" * 20, "<token_7>", "\\\\"]


def test_field_order_and_non_strings(spark):
    df = spark.createDataFrame(
        [("", "b", "c", 0), (None, "", "c", 0), ("a", "b", "c", 0), (None, None, None, 5), (None, "b", "c", 5)],
        "text string, func_code_string string, content string, code int")
    got = [r[0] for r in text.resolve_text(df, text.PREPARER_FIELDS, "out").select("out").collect()]
    # The number in `code` hides what comes after it.
    assert got == ["c", "c", "a", None, None]
    assert [r[0] for r in text.resolve_text(df.drop("code"), text.LOADER_FIELDS, "out").select("out").collect()][3] is None


def test_perplexity_golden(spark):
    got = one(spark, [(2.8453,), (25.0,)], "l double", numeric.perplexity("l"), numeric.perplexity("l", base=2))
    assert round(got[0][0], 2) == 17.21 and round(got[0][1], 2) == 7.19
    assert round(got[1][0]) == 485165195


def test_schedule_golden(spark):
    steps = [0, 225, 450, 15000]
    got = one(spark, [(s,) for s in steps], "s int", numeric.lr_multiplier("s", 450, 15000, 0.1) * 1.5e-4)
    assert [round(g[0], 10) for g in got] == [0.0, 7.5e-5, 1.5e-4, 1.5e-5]
    flat = one(spark, [(0,), (5,)], "s int", numeric.lr_multiplier("s", 0, 0))
    assert [f[0] for f in flat] == [1.0, 1.0]


def test_duration_borders(spark):
    got = one(spark, [(float(s),) for s in (59, 60, 3599, 3600, 86399, 86400, 16932)], "s double",
              numeric.format_duration("s"))
    assert [g[0] for g in got] == ["59s", "1m", "60m", "1.0h", "24.0h", "1.0d", "4.7h"]


def test_bars_and_status(spark):
    got = one(spark, [(0.0,), (50.0,), (120.0,)], "v double", numeric.progress_bar("v", 100, 4))
    assert [g[0] for g in got] == ["░░░░", "██░░", "████"]
    got = one(spark, [(69.9,), (70.0,), (84.9,), (85.0,)], "v double", numeric.temp_status("v"))
    assert [g[0] for g in got] == ["green", "amber", "amber", "red"]


def test_registered_functions(spark):
    assert "perplexity" in register_sql(spark)
    row = spark.sql("SELECT decode_bytes(encode_bytes('Hié')), format_duration(16932D), perplexity(30D), "
                    "decode_codepoints(encode_codepoints('aé'))").first()
    assert row[0] == "Hié" and row[1] == "4.7h" and round(row[2]) == 485165195 and row[3] == "aé"
