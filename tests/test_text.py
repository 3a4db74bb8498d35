import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T

from .helpers import values

@pytest.fixture(autouse=True)
def columns(spark):
    globals().update(A=F.col("a"))


def test_charset_names(spark):
    headers = ["text/html; charset=Shift_JIS", "text/html;CHARSET = utf-8;x", "text/html", None, 'a; charset="utf-8"']
    assert values(spark, T.charset_of_header(A), headers) == ["Shift_JIS", "utf-8", None, None, None]
    bodies = ["<meta charset='EUC-JP'>", '<meta content="text/html; charset=Shift-JIS">', "<p>", " " * 5000 + "charset=x"]
    assert values(spark, T.charset_of_bytes(A.cast("binary")), bodies) == ["EUC-JP", "Shift-JIS", None, None]
    assert values(spark, T.encoding_name(A), ["Shift_JIS", "x-sjis", "MS_Kanji", "utf-8", "EUC-JP"]) == ["cp932", "cp932", "cp932", "utf-8", "EUC-JP"]


def test_decode(spark):
    word = "阿部寛"
    rows = [
        (0, word.encode("cp932"), "text/html; charset=Shift_JIS"), (1, b"<meta charset=sjis>" + word.encode("cp932"), "text/html"), (2, word.encode(), None),
        (3, b"\xff\xfe", "text/html"), (4, word.encode(), "text/html; charset=ascii"), (5, None, "text/html"), (6, "é".encode("latin-1"), "text/html; charset=nonsense"), (7, b"", None),
    ]
    df = spark.createDataFrame(rows, "i int, body binary, ct string").select("i", T.decode_body(F.col("body"), F.col("ct")).alias("t"))
    assert [r.t for r in df.orderBy("i").collect()] == [word, "<meta charset=sjis>" + word, word, "��", word, None, "�", ""]


def test_declare_utf8(spark):
    texts = [
        '<meta charset="shift_jis">', "<meta charset='EUC-JP'>x", '<meta http-equiv="Content-Type" content="text/html; charset=Shift_JIS">', '<meta http-equiv=content-type content="text/html">',
        "<title>タイトル</title>", None, '<meta http-equiv="Content-Type" content="">',
    ]
    assert values(spark, T.declare_utf8(A), texts) == [
        '<meta charset="UTF-8">', "<meta charset='UTF-8'>x", '<meta http-equiv="Content-Type" content="text/html; charset=UTF-8">',
        '<meta http-equiv=content-type content="text/html; charset=UTF-8">', "<title>タイトル</title>", None, '<meta http-equiv="Content-Type" content=" charset=UTF-8">']


def test_srcset_and_kinds(spark):
    assert values(spark, T.srcset_urls(A), ["a.png 1x, b.png 2x", " , x", ""]) == [["a.png", "b.png"], ["x"], []]
    assert values(spark, T.guess_kind(A), ["/a.PNG", "/f.woff2", "/a.png?x", "/a"]) == ["image", "font", "other", "other"]
    assert values(spark, T.wanted_kind(A, "images"), ["icon", "script"]) == [True, False]
    assert values(spark, T.wanted_kind(A, "css_js"), ["stylesheet", "image"]) == [True, False]
    assert values(spark, T.wanted_kind(A, "none"), ["image"]) == [False]


def test_titles_lines_progress(spark):
    assert values(spark, T.page_title(A), ["<TITLE lang=x> A &amp; B &lt;&#39; </TITLE>", "<title></title>", "<p>"]) == ["A & B <'", None, None]
    assert values(spark, T.lines(A), ["a\r\n  b \n\n c\r", ""]) == [["a", "b", "c"], []]
    assert values(spark, T.progress_percent(A.cast("int"), F.lit(3)), ["2", "3"]) == [66, 100]
    assert values(spark, T.progress_percent(A.cast("int"), F.lit(0)), ["2"]) == [None]
