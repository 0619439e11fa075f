"""Text functions, the wikitext cleaner and the chunker against fixed cases and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.wikitext import clean_wikitext
from textloom.operators.chunking import split_chunks
from textloom.operators.ranking import rrf, sign_test

WIKI = [
    ("a<!-- x\ny -->b<ref name='n'/>c<ref>z</ref>d", "abcd"),
    ("x {| class\n| cell\n|} y", "x y"),
    ("[[Category:Cats]]text[[分类:猫]]", "text"),
    ("-{zh-hans:电脑; zh-hant:電腦}-好", "电脑好"),
    ("-{plain}-", "plain"),
    ("{{lang|en|Foo}} {{cite|{{nested|x}}|y}}bar", "Foo bar"),
    ("[[A|B]] and [[C]] [[File:x.png|thumb|see [[D]]]]", "B and C"),
    ("[http://x.org label] <b>bold</b> '''it''' __TOC__", "label bold it"),
    ("前（，）后，。；结束", "前后。结束"),
    ("a  b\n\n\n\nc ", "a b\n\nc"),
    (None, ""),
    ("a{| x {| y |} z |}b", "a z |}b"),  # T3 takes the outer opening up to the first end
    ("[[ Category : x]]y", "y"),
    ("a<gallery mode=x>\nFile:a.jpg|b\n</gallery >c", "ac"),
    ("-{于}--{}-x", "于x"),
    ("-{zh-hant:[[File:A.svg]]; zh-hans:[[File:B.svg]]}-x", "x"),
    ("{{ lang | en | Foo }}", "Foo"),
    ("a{{x{{y}}z}}b", "ab"),
    ("[[圖片:a.jpg|thumb]]x", "x"),
    ("[[File:X.jpg|thumb|[[A|B]]c]]d", "d"),
    ("[[LIVE 2025|LIVE 2025 [THE CULTURE]]] e", "LIVE 2025 [THE CULTURE] e"),
    ("[[A [b] c]]", "A [b] c"),
    ("[http://a.b] x", "x"),
    ("[https://a.b lab] x", "lab x"),
    ("'" * 4 + "a" + "'" * 4, "'a'"),  # three are a mark, the fourth is text
    ("他（...）說（-）了《》。", "他（...）說了。"),
    ("（（））x", "x"),
    ("a、、b，。c", "a、b。c"),
    ("a\tb\u3000", "a\tb"),
    ("<b>x</b> 1 < 2", "x 1 < 2"),
]


def test_clean_wikitext(spark):
    rows = spark.createDataFrame(WIKI, "raw string, want string").select("raw", "want", clean_wikitext(F.col("raw")).alias("got")).collect()
    assert [(r.raw, r.got) for r in rows] == [(r.raw, r.want) for r in rows]


def test_text_functions(spark):
    df = spark.createDataFrame([("",), ("aab",), ("張國x",), ("abcd efgh",)], "t string")
    t = F.col("t")
    rows = df.select(
        F.round(T.max_char_share(t), 4), F.round(T.letter_ratio(t), 4), T.to_simplified(t), F.round(T.traditional_ratio(t), 4), F.size(T.grams(t, 4))
    ).collect()
    assert [tuple(r) for r in rows] == [(1.0, 0.0, "", 0.0, 0), (0.6667, 1.0, "aab", 0.0, 0), (0.3333, 0.3333, "张国x", 0.6667, 0), (0.1111, 0.8889, "abcd efgh", 0.0, 6)]


def test_answers(spark):
    df = spark.createDataFrame([("see [2][1] and [2], 3.5 of 7", False), ("I can not answer.", False), ("I cannot answer", True)], "a string, r boolean")
    rows = df.select(T.citations(F.col("a")), T.numbers(F.col("a")), T.is_refusal(F.col("a")), "r").collect()
    assert rows[0][0] == [1, 2] and rows[0][1] == ["3.5", "7"]
    assert [r[2] for r in rows] == [False, True, True]  # spacing does not hide a marker


def test_leak_and_coverage_edges(spark):
    row = spark.createDataFrame([("abc", "", "xyz")], "q string, a string, t string").select(T.leak_ratio(F.col("q"), F.col("t")), T.answer_coverage(F.col("a"), F.col("t"))).first()
    assert tuple(row) == (0.0, 1.0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n=", max_size=1200), max_size=4))
def test_chunks_keep_their_bounds(parts):
    for _, _, body in split_chunks("\n\n".join(parts)):
        assert 50 <= len(body) <= 800


def test_chunk_sections_and_short_buffers():
    text = "x" * 60 + "\n== Head ==\n" + "y" * 30 + "\n\n" + "z" * 790 + "\n\n" + "w" * 900
    got = [(s, len(b)) for _, s, b in split_chunks(text)]
    assert got == [("", 60), ("Head", 790), ("Head", 800), ("Head", 200)]  # the 30 letters are lost
    assert split_chunks(None) == []


def test_rrf_worked_example(spark):
    rows = [("q", "a", 1, 1), ("q", "b", 1, 2), ("q", "a", 2, 2), ("q", "b", 2, 1), ("q", "a", 3, 3)]
    df = spark.createDataFrame(rows, "item_id string, path string, doc_id int, rank int")
    got = [(r.doc_id, r.fused) for r in rrf(df, k=60).orderBy("rank").collect()]
    assert got[0] == (1, pytest.approx(1 / 61 + 1 / 62, abs=1e-9)) and got[1][0] == 2 and got[2][0] == 3


def test_sign_test(spark):
    rows = spark.createDataFrame([(0, 0), (5, 0), (0, 5), (3, 3)], "w int, l int").select(sign_test(F.col("w"), F.col("l"))).collect()
    assert [round(r[0], 6) for r in rows] == [1.0, 0.0625, 0.0625, 1.0]
