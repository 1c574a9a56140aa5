from pyspark.sql import functions as F

from tracewell.functions import text as T


def one(spark, value, *cols):
    return tuple(spark.createDataFrame([(value,)], "x string").select(*cols).first())


def test_tokenize_drops_stop_words_and_keeps_repeats(spark):
    assert one(spark, "The Door-lock is a door LOCK, and v2!", T.tokenize(F.col("x")))[0] == ["door", "lock", "door", "lock", "v2"]


def test_tokenize_of_null_is_null(spark):
    assert one(spark, None, T.tokenize(F.col("x")))[0] is None


def test_stems(spark):
    assert one(spark, "policies", T.stem_variants(F.col("x")))[0] == ["polici", "policie", "policies", "policy"]
    assert "provide" in one(spark, "provides", T.stem_variants(F.col("x")))[0]
    assert one(spark, "ring", T.stem_variants(F.col("x")))[0] == ["ring"]


def test_headings(spark):
    h = T.heading(F.col("x"))
    assert tuple(one(spark, "4.10 Signal Dictionary", h)[0]) == ("4.10", "Signal Dictionary")
    assert one(spark, "500 kbit/s bus", h)[0] is None
    assert one(spark, "5 lists the signals", h)[0] is None
    assert one(spark, "1. " + "A" * 121, h)[0] is None


def test_page_text_rejoins_broken_words(spark):
    assert spark.sql("select array('informa-', 'tion  is', '', '', '', 'here') as l").select(T.page_text(F.col("l"))).first()[0] == "information is\n\nhere"


def test_tables(spark):
    df = spark.sql("select array('id', 'name') as h, array(array('1', null), array('', ''), array('2', 'b\nc')) as r")
    rows = T.normalize_rows(F.col("r"))
    assert df.select(T.linearize_table(F.col("h"), rows)).first()[0] == "Table columns: id | name\nid: 1\nid: 2 | name: b c"
    assert one(spark, "x\na | b\n1 | 2\nragged | 1 | 2", T.parse_table(F.col("x")))[0] == [["a", "b"], ["1", "2"]]


def test_names_and_versions(spark):
    assert one(spark, "../../etc/pass wd?", T.safe_filename(F.col("x")))[0] == "pass wd_.pdf"
    assert one(spark, None, T.safe_filename(F.col("x")))[0] == "upload.pdf"
    assert one(spark, "Version 1.2 of 3.4.5", T.guess_version(F.col("x")))[0] == "1.2"
    assert one(spark, "a<b>&\"'", T.escape_html(F.col("x")))[0] == "a&lt;b&gt;&amp;&quot;&#x27;"
