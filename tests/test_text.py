import html
import random
import time

import pytest
from pyspark.sql import functions as F

from quillmere.functions import scalars as sc, text as tx


def one(spark, expression, *values):
    columns = [f"c{i}" for i in range(len(values))]
    frame = spark.createDataFrame([values], ", ".join(f"{c} string" for c in columns))
    return frame.select(expression(*[F.col(c) for c in columns])).first()[0]


@pytest.mark.parametrize(
    ("raw", "cleaned"),
    [
        ("  a\tb\n\nc  ", "a b c"),
        ("Wait...!? Yes!!", "Wait? Yes!"),
        ("“q” ‘r’ `s`", "\"q\" 'r' \"s\""),
        ("Ünï–x © 5€ [a](b)", "Ünïx 5 [a](b)"),
        ("a!#!b", "a!b"),
        ("x  y\x1cz", "x y z"),
        ("", ""),
        (None, ""),
    ],
)
def test_clean(spark, raw, cleaned):
    assert one(spark, tx.clean_text, raw) == cleaned


def test_profile(spark):
    text = "The cat. And?! \n\n  \n\nПривет 中 é"
    got = {n: one(spark, lambda c, e=n: tx.profile(c)[e], text) for n in tx.profile(F.lit(""))}
    assert got == {
        "word_count": 6, "char_count": len(text), "paragraph_count": 2, "sentence_count": 3,
        "english_word_count": 3, "has_accented_chars": True, "has_cyrillic": True, "has_chinese": True,
    }


def test_english_words_also_inside_words(spark):
    assert one(spark, tx.english_word_count, "bother") == 1  # "the" inside


@pytest.mark.parametrize("text", ["&amp;lt;", "&#233;&#x1F600;", "&lt;b&gt; &copy; &nosuch;", "a & b", "&#38;lt;"])
def test_unescape(spark, text):
    assert one(spark, tx.unescape, text) == html.unescape(text)


@pytest.mark.parametrize("text", ["&#55296;", "&#9999999;"])
def test_impossible_code_points_stay(spark, text):
    assert one(spark, tx.unescape, text) == text


def test_html(spark):
    page = (
        "<html><head><title>T</title></head><body><!-- x --><script>var a='<p>';</script>"
        "<h1>Head</h1><p>One <b>two</b>&nbsp;three<br>four</p><ul><li>a</li><li> b </li></ul></body></html>"
    )
    assert one(spark, tx.html_to_text, page) == "Head\nOne two three\nfour\na\nb"


@pytest.mark.parametrize(("page", "text"), [
    ("2 < 3 and 5 > 4", "2 < 3 and 5 > 4"),
    ("a<b <i>c</i> d>e", "ac d>e"), ("1 <2 <i>c</i> d>e", "1 <2 c d>e"), ("a <b never closed", "a <b never closed"),
    ("<p title=\"a > b\">x</p><a href='>'>y</a>", "x\ny"),
    ("<p data-x=a>b</p>c", "b\nc"),
    ("<a title='it\"s > 1' b = \"it's > 2\">z</a>", "z"),
    ("<q a=\"open>shown</q>", "shown"),
    ("a<!-- x > y --> b<!-- open <p>c", "a b"),
    ("a<!-->b<!--->c<!-- x --!>d", "abcd"),
    ("<!DOCTYPE html><?xml v='>'?>e", "e"),
    ("<script>if (a<b) '</scripty>'</script >f<STYLE>p>q{}</style>g", "fg"),
    ("h<script>never closed <p>i", "h"),
    ("<head><title>t</title></head ><body>k", "k"),
    ("<head>l<p>m", "l\nm"), ("<head>l<!-- </head> -->m", "lm"),
    ("<header>n</header><br/>o<hr>p", "n\no\np"),
    ("&copy;&notin;&#x1F600;&CounterClockwiseContourIntegral;&amp;lt;&nosuch; &lt;b&gt;", "©∉😀∳&lt;&nosuch; <b>"),
    ("</ 3> <3 <", "</ 3> <3 <"), ("", ""), ("\n \t", ""),
    ("<p>" * 5000 + "deep" + "</p>" * 5000, "deep"), ("<a " + "x " * 20000 + ">q", "q"), ("<" * 20000, "<" * 20000),
])
def test_html_tokens(spark, page, text):
    assert one(spark, tx.html_to_text, page) == text


def test_html_of_nothing(spark):
    assert one(spark, tx.html_to_text, None) is None


def test_odd_markup_is_read_in_one_pass():
    """The work grows with the page, also where quotes and tags stay open."""
    import time

    from quillmere.functions.markup import visible

    for part in ('<a b="', "<a b='c\" ", "<!", "<!-", "<head>", "<script", "a=\"'>"):
        began = time.process_time()
        visible(part * 20_000)
        assert time.process_time() - began < 5


@pytest.mark.parametrize(("source", "text"), [
    ("Title\n=====\n\nPart\n---\nx", "Title\n\nPart\nx"),
    ("~~~py\na < b\n~~~\nend", "a < b\nend"),
    ("- a\n  - b\n    * c\n      1. d", "a\nb\nc\nd"),
    ("[shown][ref] and ![pic][ref]\n\n[ref]: http://x 'T'\nend", "shown and \n\nend"),
    ("an _em_ word, (_two words_), snake_case_name and __init__", "an em word, (two words), snake_case_name and init"),
    ("2 < 3 and 5 > 4", "2 < 3 and 5 > 4"),
    ("<http://x.y/z> <b>bold</b> a <- b <br/>", "http://x.y/z bold a <- b"),
    ("x <!-- note --> y", "x  y"),
    ("> > quoted\n\n* * *\nend", "quoted\n\n\nend"),
])
def test_markdown_forms(spark, source, text):
    assert one(spark, tx.markdown_to_text, source) == text


def test_markdown(spark):
    source = "# Title #\n\n- **bold** and *it*\n1. [link](http://x) ![i](y)\n> `code`\n\n```py\nx = 1\n```\n***\nend<br>"
    assert one(spark, tx.markdown_to_text, source) == "Title\n\nbold and it\nlink \ncode\n\nx = 1\n\nend"


def test_csv_keeps_quoted_breaks_together(spark):
    body = 'a,"b c"\r\n1,"x, y\nz"\r\n2,"q""q"\r\n'
    got = one(spark, tx.csv_digest_text, "f.csv", body)
    assert got == 'CSV Data from f.csv:\n\nColumns: a, b c\nTotal rows: 2\n\nSample data:\n1,"x, y\nz"\n2,"q""q"'


@pytest.mark.parametrize(
    ("path", "kind"),
    [("a/b.PDF", "pdf"), ("x.markdown", "md"), ("x.htm", "html"), ("x.xls", "xlsx"), ("x", "txt"), (".csv", "txt"),
     ("a.b/c", "txt"), ("x.tar.gz", "txt")],
)
def test_file_type(spark, path, kind):
    assert one(spark, tx.file_type, path) == kind


@pytest.mark.parametrize(("length", "chunks"), [(0, 0), (1, 1), (800, 1), (801, 2), (1000, 2), (1601, 3)])
def test_estimated_chunks(spark, length, chunks):
    assert one(spark, lambda c: tx.estimated_chunks(c.cast("int")), str(length)) == chunks


def test_decode_falls_back_to_latin_1(spark):
    rows = spark.createDataFrame([(1, bytearray("né".encode())), (2, bytearray("né ".encode("latin-1")))], "i int, b binary")
    assert [r[0] for r in rows.orderBy("i").select(tx.decode_bytes(F.col("b"))).collect()] == ["né", "né"]


def test_tags_and_merge(spark):
    assert one(spark, sc.split_tags, "") == []
    assert one(spark, sc.split_tags, "a,b") == ["a", "b"]
    merged = one(
        spark, lambda a: sc.merge_maps(F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")), F.create_map(F.lit("y"), a)), "3"
    )
    assert merged == {"x": "1", "y": "3"}


def test_cache_key(spark):
    import hashlib

    assert one(spark, sc.cache_key, "q") == "rag_query:" + hashlib.md5(b"q").hexdigest()
    assert one(spark, lambda c: sc.cache_key(c, F.lit(5)), "q") != one(spark, lambda c: sc.cache_key(c, F.lit(6)), "q")


def test_markdown_of_long_lines_is_linear(spark):
    """A line of 600,000 characters, and a comment of as many; the square of a line took minutes."""
    line = "word " * 120_000
    source = f"{line}\nTitle\n===\n{line}<!-- {line}-->end"
    began = time.monotonic()
    assert one(spark, tx.markdown_to_text, source) == f"{line}\nTitle\n{line}end"
    assert time.monotonic() - began < 30


def test_markdown_in_possessive_form_gives_the_rules_results(spark):
    dice = random.Random(5)
    signs = ["=", "-", "--", "\n", "\n", " ", "\t", "\r", "\x0b", "a", "b", ">", "#", "*", "+", "<!--", "-->", "<!", "<a ", ">", " "]
    rows = [("".join(dice.choices(signs, k=dice.randrange(30))),) for _ in range(5000)]
    text = ruled = F.col("t")
    for pattern, kept in tx.MARKDOWN_RULES:
        ruled = F.regexp_replace(ruled, pattern.replace("(?m)", "(?md)"), kept)
    found = spark.createDataFrame(rows, "t string").select(
        F.count_if(tx.markdown_to_text(text) != tx.strip(ruled)), F.count_if(tx.strip(ruled) != tx.strip(text)))
    differing, changed = found.first()
    assert differing == 0 and changed > 1000
