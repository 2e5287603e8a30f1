"""Expressions against plain Python."""

import re

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import chunking as K


def clip(t, n):
    if n >= len(t):
        return t
    if n <= 3:
        return t[:n]
    cut = t[: n - 3]
    at = cut.rfind(" ")
    return (cut[:at] if at > (n - 3) / 2 else cut).rstrip() + "..."


def pack(t, most=4000):
    if len(t) <= most:
        return [t]
    out, cur = [], None
    for p in re.split(r"\n\n+", t):
        if cur and len(cur) + len(p) + 2 <= most:
            cur += "\n\n" + p
        else:
            out += [cur] if cur else []
            cur = p
    return [x.strip() for x in [*out, cur]]


def test_clip(spark):
    texts = ["one two three four five", "abcdefghijklmnopqrst", "a b", "", "é è ê ë ē ĕ ė ę ě", "    spaces      here"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in range(1, 20):
        got = [r[0] for r in df.select(X.clip_words(F.col("t"), n)).collect()]
        assert got == [clip(t, n) for t in texts]
        assert all(len(g) <= n for g in got)


def test_pack(spark):
    texts = ["x" * 9000, "a" * 3000 + "\n\n" + "b" * 3000, "\n\n".join("p%d " % k * 200 for k in range(12)), "short", "", "  " + "c" * 3000 + " \n\n\t" + "d" * 3000 + "\n\n  \n\n" + "e" * 3990 + "  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(K.pack_paragraphs(F.col("t"))).collect()] == [pack(t) for t in texts]


def test_sections(spark):
    md = "intro\n# One\nbody 1\n## Two\n\nbody 2\n### Three\nbody 3\n# Four\n#### five is body\n"
    df = spark.createDataFrame([("a", md), ("b", "# only\n## headings"), ("c", "#\n\nfoo\nbar"), ("d", "")], "path string, text string")
    rows = {(r["file_path"], r["chunk_index"]): (r["heading"], r["content"]) for r in K.markdown_chunks(df).collect()}
    assert [rows[("a", k)] for k in range(5)] == [("", "intro"), ("One", "body 1"), ("One > Two", "body 2"), ("One > Two > Three", "body 3"), ("Four", "#### five is body")]
    assert rows[("b", 0)] == ("", "# only\n## headings")
    assert rows[("c", 0)] == ("foo", "bar")
    assert not any(p == "d" for p, _ in rows)


def test_embed_text(spark):
    df = spark.createDataFrame([("h", "body", "previous"), ("", "body", None), ("h", "x" * 9000, "")], "h string, c string, p string")
    got = [r[0] for r in df.select(X.embed_text(F.col("h"), F.col("c"), F.col("p"), 4)).collect()]
    assert got == ["h: ...ious\n\nbody", "body", ("h: " + "x" * 9000)[:8000]]


def test_small_functions(spark):
    df = spark.range(1)
    one = lambda c: df.select(c).first()[0]
    assert one(X.tokens(F.lit("Ünïcode_Wörd 42!"))) == ["unicode", "word", "42"]
    assert one(X.suffix(F.lit("/a/b.c/file.TXT"))) == ".txt" and one(X.suffix(F.lit("/a/b.c/file"))) == ""
    assert one(X.iso_time(F.lit(1700000000123456789))) == "2023-11-14T22:13:20+00:00" and one(X.iso_time(F.lit(-1))) is None
    assert one(X.has_text(F.lit("![a long alternative text](x.png) few"))) is False
    assert one(X.strip_tags(F.lit("a <b class='x'>c</b> 1 < 2"))) == "a c 1 < 2"
