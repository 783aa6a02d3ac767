import html
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimlens.functions import text as T


def py_clean(t):
    for a, b in T.BRACKETS:
        t = t.replace(a, b)
    t = re.sub(r"-([A-Z])-(?!\w)", r"\1", html.unescape(t))
    return re.sub(r"\s+", " ", t).strip()


def test_clean_fixtures(spark):
    cases = {
        "x -A- y -B-c": "x A y -B-c",
        "-A-é": "-A-é",
        "&amp;lt;": "&lt;",
        "a \tb": "a b",
        "Ada -LRB- born 1815 -RRB- wrote notes . She met Bob &amp; Eve .": "Ada ( born 1815 ) wrote notes . She met Bob & Eve .",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    for r in df.select("want", T.clean(F.col("t")).alias("got")).collect():
        assert r["got"] == r["want"]
    assert spark.sql("SELECT '-LCB-' AS t").select(T.validate(F.col("t"))).first()[0]


def test_clean_like_python(spark):
    seen = []

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.sampled_from(["-LRB-", "-A-", "&amp;", "&eacute;", " ", "\n", "\t", " ", "\x1c", "é", "a", "B", "-", "&", ";", "1"]), max_size=12))
    def collect(parts):
        seen.append("".join(parts))

    collect()
    df = spark.createDataFrame([(s,) for s in seen], "t string")
    for r in df.select("t", T.clean(F.col("t")).alias("got")).collect():
        assert r["got"] == py_clean(r["t"]), repr(r["t"])


def test_lines(spark):
    lines = "0\tAda -LRB- born 1815 -RRB- wrote notes .\tnotes\tNote\n1\t\n2\tShe met Bob &amp; Eve .\tBob"
    df = spark.createDataFrame([(lines,), ("0 no tab here",), ("",), (None,)], "lines string")
    got = [r[0] for r in df.select(T.annotated_sentences(F.col("lines"))).collect()]
    assert got == [["Ada ( born 1815 ) wrote notes .", "She met Bob & Eve ."], [], [], []]
    kept = df.select(T.annotated_lines(F.col("lines")).alias("l")).first()["l"]
    assert [(x["line_num"], x["sentence"], x["entities"]) for x in kept] == [("0", "Ada -LRB- born 1815 -RRB- wrote notes .", ["notes", "Note"]), ("1", "", []), ("2", "She met Bob &amp; Eve .", ["Bob"])]


def test_evidence_and_labels(spark):
    ev = [[["10", "11", "Ada_Page", "0"], ["10", "12", "Bob_Page", "2"]], [["13", "14", "Ada_Page", "2"]], [["15", None, None, None]], [["Bob_Page", "1"]]]
    df = spark.createDataFrame([(ev,), ([],), (None,)], "e array<array<array<string>>>")
    rows = df.select(T.evidence_articles(F.col("e")).alias("a"), T.evidence_ids(F.col("e")).alias("i")).collect()
    assert rows[0]["a"] == ["Ada_Page", "Bob_Page"] and rows[0]["i"] == ["ada_page", "bob_page", "ada_page"]
    assert rows[1]["a"] == [] and rows[2]["a"] == []
    said = spark.createDataFrame([("it refutes, not supports",), ("maybe",), (None,)], "t string")
    assert [r[0] for r in said.select(T.parse_label(F.col("t"))).collect()] == ["SUPPORTS", "NOT ENOUGH INFO", "NOT ENOUGH INFO"]
