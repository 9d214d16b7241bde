import pytest
from pyspark.sql import functions as F

from clausewise.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,value", [("十二", 12), ("二百零三", 203), ("一万二千", 12000), ("三", 3), ("15", 15), ("甲", 0), ("", 0), (None, 0), ("两千零五", 2005), ("一百一十", 110)])
def test_numeral_value(spark, text, value):
    assert one(spark, text, X.numeral_value) == value


@pytest.mark.parametrize("number,text", [(1, "一"), (10, "十"), (12, "十二"), (20, "二十"), (101, "一百零一"), (2005, "二千零五"), (110, "一百十"), (117, "一百十七"), (210, "二百十"), (1010, "一千零十"), (1110, "一千一百十"), (0, ""), (10000, "")])
def test_numeral_text(spark, number, text):
    assert one(spark, str(number), X.numeral_text) == text


def test_numerals_round_trip(spark):
    d = spark.range(1, 10000).select("id", X.numeral_value(X.numeral_text(F.col("id"))).alias("back"))
    assert d.where("id <> back").count() == 0


@pytest.mark.parametrize("section,sub,parent", [("1", "3", "1"), ("1", "1", ""), (None, "2.4", "2"), ("1", None, ""), (None, "4", "")])
def test_parent_section(spark, section, sub, parent):
    assert spark.createDataFrame([(section, sub)], "a string, b string").select(X.parent_section(F.col("a"), F.col("b"))).first()[0] == parent


def test_cleaning(spark):
    assert one(spark, "a.....b\n 12 \n34\n\n\n\nc ", X.document_text) == "ab\n 12 \n\nc" or one(spark, "a.....b\n34\n\n\n\nc", X.document_text) == "ab\n\nc"
    assert one(spark, "　a \t b　", X.collapsed) == "a b"
    assert one(spark, "第 三 章和第三章，第五条", X.section_refs) == ["第三章", "第五条"]
    assert one(spark, None, X.collapsed) == "" and one(spark, "", X.content_hash) == "" and one(spark, None, X.content_hash) is None
    assert one(spark, "x" * 5, lambda c: X.shortened(c, 3)) == "xxx..."
    assert one(spark, "应当办理", X.modality) == 1 and one(spark, "不得办理", X.modality) == 3 and one(spark, "可以办理", X.modality) == 2
    assert one(spark, "中国移动集团有限公司-合规手册", X.title_aliases)[0] == "中国移动集团有限公司"


def test_similar(spark):
    d = spark.createDataFrame([("合规管理办法", "合规管理办法。", True), ("合规", "合规管理办法", False), ("", "", False), (None, "x", False)], "a string, b string, r boolean")
    assert d.where(X.similar(F.col("a"), F.col("b")) != F.col("r")).count() == 0
