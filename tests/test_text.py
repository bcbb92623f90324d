from pyspark.sql import functions as F

from textloom.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_words_and_folding(spark):
    assert one(spark, T.words(F.col("t")), t="Don't stop_me, Élan 3x") == ["don", "t", "stop", "me", "élan", "3x"]
    assert one(spark, T.ascii_fold(F.col("t")), t="Élan für ça") == "Elan fur ca"
    assert one(spark, T.words(F.col("t")), t=None) is None


def test_case_pattern_is_kept(spark):
    for word, expected in (("Knowlege", "Knowledge"), ("goverment", "government"), ("GOVERMENT", "GOVERNMENT")):
        by = "knowledge" if word.lower().startswith("k") else "government"
        assert one(spark, T.reapply_case(F.col("w"), F.col("b")), w=word, b=by) == expected


def test_predicates(spark):
    for text, numeric in (("3", True), ("3.5", True), (".5", True), ("3a", False), ("", False)):
        assert one(spark, T.is_numeric(F.col("t")), t=text) is numeric
    assert one(spark, T.is_email(F.col("t")), t="john.doe@mail.com") is True
    assert one(spark, T.is_email(F.col("t")), t="nothing") is False
    for text, truth in (("yes", True), ("T", True), ("0", False), (None, False)):
        assert one(spark, T.to_bool(F.col("t")), t=text) is truth


def test_sentences_and_pages(spark):
    assert one(spark, T.sentences(F.col("t")), t=" One two.  Three?\nFour ") == ["One two.", "Three?", "Four"]
    page = "<html><head><title> A b </title></head><nav>x</nav><h2>Head <b>one</b></h2><p>Body</p><script>1</script></html>"
    assert one(spark, T.html_title(F.col("t")), t=page) == "A b"
    assert one(spark, T.html_headings(F.col("t")), t=page) == ["Head one"]
    assert one(spark, T.strip_tags(F.col("t")), t=page) == "A b Head one Body"


def test_escapes_and_stems(spark):
    assert one(spark, T.unescape_unicode(F.col("t")), t=r"café €") == "café €"
    row = spark.createDataFrame([(["running", "ponies", "hopped", "is"],)], "w array<string>")
    assert row.select(T.stemmer()(F.col("w"))).first()[0] == ["run", "poni", "hop", "is"]


def test_mean_pool(spark):
    row = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    assert row.select(T.mean_pool(F.col("v"), F.col("m"))).first()[0] == [2.0, 3.0]
